"""Evaluation: coverage of references, recall, rollups, gates, stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ancestors(code: Column) -> Column:
    """A dotted code and all its prefixes: what it covers. `383.3.d` gives 383, 383.3 and itself."""
    parts = F.split(code, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def first_covering(refs: DataFrame, codes: DataFrame) -> DataFrame:
    """question_id, ref, rank: least rank of a chunk that holds the reference or a deeper code; null if none.

    refs: (question_id, ref); codes: (question_id, rank, code). Codes are exploded into what they
    cover, so that the prefix condition becomes an equi-join."""
    covered = codes.select("question_id", "rank", F.explode(ancestors(F.col("code"))).alias("ref"))
    best = covered.groupBy("question_id", "ref").agg(F.min("rank").alias("rank"))
    return refs.join(best, ["question_id", "ref"], "left")


def recall_at(rank: Column, k: int) -> Column:
    """Share of ranks up to k; nulls are misses, no rows give 0."""
    return F.coalesce(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def strict_hit(rank: Column, k: int) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(rank <= k, F.lit(False))), F.lit(False))


def miss_kind(covered: Column, same_base: Column) -> Column:
    return F.when(covered, "C:ranking").when(same_base, "A:granularity").otherwise("B:semantic_gap")


def verdict_rollup(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Counts of each verdict by every dimension in one pass; null values are `unknown`."""
    filled = rows.withColumns({d: F.coalesce(d, F.lit("unknown")) for d in dimensions}).withColumn("verdict", F.coalesce("verdict", F.lit("error")))
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "partial", "wrong", "error")]
    return filled.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(*counts, F.count(F.lit(1)).alias("total"))


def verdict(reply: Column) -> Column:
    """(verdict, justification) of a judge's reply: the JSON object in it, a known verdict, a justification cut at 500 characters; else an error."""
    body = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "verdict string, justification string")
    ok = F.coalesce(body["verdict"].isin("correct", "partial", "wrong"), F.lit(False))
    return F.struct(F.when(ok, body["verdict"]).otherwise("error").alias("verdict"), F.when(ok, F.substring(F.coalesce(body["justification"], F.lit("")), 1, 500)).otherwise("").alias("justification"))


def persistent(hits: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys of `hits` that are missing from both runs: the intersection of two differences. Tables of keys, joined by shuffle."""
    return hits.select(key).distinct().join(first, key, "left_anti").join(second, key, "left_anti")


def stratified(rows: DataFrame, limit: int, key: str, id_column: str) -> DataFrame:
    """`limit` rows in proportion to the strata, by largest remainders; picked by hash of the id, so the same each time."""
    strata = rows.groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    total = strata.agg(F.sum("members").alias("all"))
    sized = strata.crossJoin(F.broadcast(total)).withColumn("raw", F.least(F.lit(limit), F.col("all")) * F.col("members") / F.col("all"))
    sized = sized.withColumn("base", F.floor(F.round("raw", 9))).withColumn("rest", F.round(F.col("raw") - F.col("base"), 9))
    everything = Window.partitionBy(F.lit(1))  # one row per stratum
    spare = F.least(F.lit(limit), F.first("all").over(everything)) - F.sum("base").over(everything)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), F.col(key).cast("string"))
    alloc = sized.withColumn("n", F.col("base") + (F.row_number().over(order) <= spare).cast("int")).select(F.col(key).alias("__key"), "n")
    pick = Window.partitionBy(key).orderBy(F.md5(F.col(id_column).cast("string")), id_column)
    # No stratum takes more than the limit: each task sends that many rows of it at most.
    ranked = rows.withColumn("__r", F.row_number().over(pick)).filter(F.col("__r") <= limit).join(F.broadcast(alloc), F.col(key).eqNullSafe(F.col("__key")))
    return ranked.filter(F.col("__r") <= F.col("n")).drop("__r", "__key", "n")
