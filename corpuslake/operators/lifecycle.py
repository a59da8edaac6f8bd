"""Versions of a corpus: upserts, copies, incremental filters, latest-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPDATED = ("content", "embedding", "corpus_version", "metadata", "ingested_at")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", updated: tuple[str, ...] = UPDATED) -> DataFrame:
    """New rows added; of rows that exist, only the `updated` columns take the new value."""
    o, n = old.alias("o"), new.alias("n")
    both = F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull()
    columns = []
    for c in old.columns:
        fresh, known = F.col(f"n.{c}"), F.col(f"o.{c}")
        value = F.when(both, fresh if c in updated else known).otherwise(F.coalesce(known, fresh))
        columns.append(value.alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def copy_version(rows: DataFrame, source: str, target: str, key: str, without_type: str | None = None) -> DataFrame:
    """Rows of one version under another's name, less those whose key it has."""
    chosen = rows.filter(F.col("corpus_version") == source)
    if without_type is not None:
        chosen = chosen.filter(F.col("source_type") != without_type)
    there = rows.filter(F.col("corpus_version") == target).select(key)
    return chosen.withColumn("corpus_version", F.lit(target)).join(there, key, "left_anti")


def only_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not exist yet: to be applied before costly columns are made."""
    return rows.join(existing.select(key), key, "left_anti")


def latest(rows: DataFrame, key: list[str], date: str, order: str) -> DataFrame:
    """The row of the latest date of each key; of equal dates, the first."""
    by = Window.partitionBy(*key).orderBy(F.desc(date), order)
    return rows.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def relabelled(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of one version under another's name; all others as they are."""
    return rows.withColumn("corpus_version", F.when(F.col("corpus_version") == old, new).otherwise(F.col("corpus_version")))
