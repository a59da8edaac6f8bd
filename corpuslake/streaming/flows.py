"""Windowed streams; what needs keyed state and timers is in `stateful`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage(rows: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Tokens per user and UTC day of a stream with (ts, user_id, tokens); rows later than `lateness` are dropped."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    sums = timed.groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))
    return sums.select(F.to_date("window.start").alias("day"), "user_id", "tokens", "requests")


def sessions(rows: DataFrame, idle: str = "60 seconds", lateness: str = "1 hour") -> DataFrame:
    """Runs of events of a key without a gap of `idle`."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.session_window("ts", idle).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("s.start").alias("started"), "events")
