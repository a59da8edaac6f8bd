"""As-of joins by ranges: rows meet the last anchor at or below their key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.session import fresh_folder


def floored(rows: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """rows with the other columns of the anchor of greatest `key` at or below theirs, null where there is none; of anchors of one
    key the greatest. Null keys meet nothing.

    Rows and anchors are laid out together by ranges of key, kind and a number of their own, so that a key of any share of
    the rows is spread; the bounds are sampled by Spark. Anchors are carried forward within each partition, and each
    partition begins with the last anchor of those before it."""
    spark = rows.sparkSession
    named = [c for c in anchors.columns if c != key]
    every = anchors.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.lit(0).alias("__kind"), F.struct(*named).alias("__anchor"), F.lit(None).cast(rows.schema).alias("__row"))
    kind = every.schema["__anchor"].dataType
    asked = rows.select(F.col(key).alias("__key"), F.lit(1).alias("__kind"), F.lit(None).cast(kind).alias("__anchor"), F.struct(*rows.columns).alias("__row"))
    both = every.unionByName(asked).withColumn("__at", F.monotonically_increasing_id())
    laid = both.repartitionByRange("__key", "__kind", "__at").withColumn("__part", F.spark_partition_id())
    path = fresh_folder(spark, "asof")
    laid.write.parquet(path)
    laid = spark.read.schema(laid.schema).parquet(path)
    ends = laid.groupBy("__part").agg(F.max(F.when(F.col("__kind") == 0, F.struct("__key", "__anchor")))["__anchor"].alias("__end")).collect()  # a row a partition
    starts, held = [], None
    for part, end in sorted((r["__part"], r["__end"]) for r in ends):
        starts.append((part, held))
        held = end or held
    before = F.broadcast(spark.createDataFrame(starts, f"__part int, __start {kind.simpleString()}"))
    order = Window.partitionBy("__part").orderBy("__key", "__kind", "__anchor", "__at")
    found = laid.withColumn("__own", F.last("__anchor", ignorenulls=True).over(order)).filter("__kind = 1").join(before, "__part")
    return found.withColumn("__met", F.coalesce("__own", "__start")).select("__row.*", *[F.col("__met")[c].alias(c) for c in named])
