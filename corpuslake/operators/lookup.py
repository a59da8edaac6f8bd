"""Names looked up by what users type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import card_slug


def prefixes(column: str) -> Column:
    """All beginnings of a short text, once each."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(column)), lambda n: F.substring(F.col(column), F.lit(1), n)))


def cascade(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked, found: the name that equals what was asked, else the one whose slug does, else the first (by pos) that begins with it.

    asked: (asked); index: (name, pos), names in lower case, once each. Three equi-joins: names are met by
    themselves, by slug and by their beginnings, of which only those that were asked for are kept before
    the least of them is taken. Blank words find nothing."""
    keys = asked.select("asked", F.lower(F.trim("asked")).alias("key")).distinct()
    wanted = keys.filter("key <> ''").select("key").distinct()
    exact = index.select(F.col("name").alias("key"), F.col("name").alias("by_name"))
    slugs = index.groupBy(card_slug("name").alias("key")).agg(F.min_by("name", "pos").alias("by_slug"))
    cuts = index.withColumn("slug", card_slug("name"))
    cuts = cuts.select("name", "pos", F.explode(F.array_union(prefixes("name"), prefixes("slug"))).alias("key"))
    begun = cuts.join(wanted, "key", "left_semi").groupBy("key").agg(F.min_by("name", "pos").alias("by_prefix"))
    found = keys
    for table in (exact, slugs, begun):
        found = found.join(table, "key", "left")
    return found.select("asked", F.coalesce("by_name", "by_slug", "by_prefix").alias("found"))
