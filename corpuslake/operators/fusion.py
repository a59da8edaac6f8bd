"""Ranked lists: reciprocal rank fusion, re-ranking, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
#: How much an authoritative source type counts over others.
BOOSTS = {"errata": 1.02, "patch_notes": 1.01}


def boost(source_type: str | Column, errata: float = BOOSTS["errata"], patch_notes: float = BOOSTS["patch_notes"]) -> Column:
    column = F.col(source_type) if isinstance(source_type, str) else source_type
    return F.when(column == "errata", errata).when(column == "patch_notes", patch_notes).otherwise(F.lit(1.0))


def fuse(first: DataFrame, second: DataFrame, k: int, first_weight: float = 1.0, second_weight: float = 1.0, boosted: bool = True) -> DataFrame:
    """query_id, chunk_id, score, rank from two arms of (query_id, chunk_id, rank, source_type).

    Each arm adds weight * boost / (60 + rank); equal scores go to chunks of the first arm, then by
    the ranks in the arms, then by id."""
    arms = first.withColumn("arm", F.lit(0)).withColumn("weight", F.lit(first_weight)).unionByName(
        second.withColumn("arm", F.lit(1)).withColumn("weight", F.lit(second_weight))
    )
    gain = F.col("weight") * (boost("source_type") if boosted else F.lit(1.0)) / (RRF_K + F.col("rank"))
    scored = arms.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(gain), 9).alias("score"),
        F.min("arm").alias("arm"),
        F.min(F.when(F.col("arm") == 0, F.col("rank"))).alias("rank_0"),
        F.min(F.when(F.col("arm") == 1, F.col("rank"))).alias("rank_1"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "arm", F.asc_nulls_last("rank_0"), F.asc_nulls_last("rank_1"), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "score", "rank")


def keep_first(rows: DataFrame, within: list[str], key: str | Column, order: list[str]) -> DataFrame:
    """The first row of each key, per group."""
    keyed = rows.withColumn("__key", F.col(key) if isinstance(key, str) else key)
    by = Window.partitionBy(*within, "__key").orderBy(*order)
    return keyed.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n", "__key")


def rerank(rows: DataFrame, score: Column, k: int) -> DataFrame:
    """Order by a model's score where there is one, else keep the order; the first k of each query."""
    by = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(score, -F.col("rank").cast("double"))), "rank")
    return rows.withColumn("new_rank", F.row_number().over(by)).filter(F.col("new_rank") <= k)
