"""Connected components by alternating large and small stars, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.runtime import dropped, hot_keys, salted_join, settled


def components(links: DataFrame) -> DataFrame:
    """class_id, root: every node that has a link, with the least node of its component.

    links: (left, right). Each step moves links towards the least neighbour, as grouped minima and
    equi-joins that spread nodes of many links, and writes them once; the tables of earlier steps are emptied; steps grow with the logarithm of the longest path. Self-links
    and repeated links are allowed; an empty table gives an empty result."""
    # Number of links and a sum of their hashes: equal when a step changed nothing.
    state = F.count(F.lit(1)).alias("links"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
    edges, now = settled(links.select(F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v")).filter("u <> v").distinct(), *state)
    before = None
    while before != now:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        hot = hot_keys(both, ["u"], total=2 * now["links"])[0]
        large, seen = settled(salted_join(both.filter("v > u"), least, ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), F.count(F.lit(1)).alias("links"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hot = hot_keys(large, ["u"], total=seen["links"])[0]
        small = salted_join(large, least, ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last = edges
        edges, now = settled(small.filter("u <> v").distinct(), *state)
        dropped(last, large)
    roots = edges.select(F.col("u").alias("class_id"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("class_id"), F.col("v").alias("root")).distinct())

