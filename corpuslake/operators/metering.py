"""Token metering: day counters, quotas, fixed-window limits, write-once caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL = 86_400


def usage(rows: DataFrame, user: str = "user_id", ts: str = "ts", tokens: str = "tokens") -> DataFrame:
    """Tokens per user and UTC day, and per day over all (user null), in one pass."""
    day = rows.withColumn("day", F.to_date(ts))
    return day.groupingSets([[F.col("day"), F.col(user)], [F.col("day")]], F.col("day"), F.col(user)).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("requests"))


def before(keys: list[str], order: list[str], value: str | Column) -> Column:
    """Sum over earlier rows of the same keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def daily_totals_before(rows: DataFrame, day: str, order: list[str], value: str, slices: int = 64) -> DataFrame:
    """`__before`: sum of `value` over earlier rows of the same day, without one task per day.

    Rows of a day are cut into time slices of equal length; sums run within a slice, and the slices'
    totals (slices rows a day) are added up in a window of their own."""
    hour = F.floor((F.unix_micros(F.col(order[0]).cast("timestamp")) % F.lit(86_400_000_000)) / F.lit(86_400_000_000 // slices))
    cut = rows.withColumn("__slice", hour)
    totals = cut.groupBy(day, "__slice").agg(F.sum(value).alias("__t"))
    earlier = Window.partitionBy(day).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__t").over(earlier), F.lit(0))).drop("__t")
    own = before([day, "__slice"], order, value)
    return cut.withColumn("__own", own).join(totals, [day, "__slice"]).withColumn("__before", F.col("__own") + F.col("__base")).drop("__own", "__base", "__slice")


def quota_gate(rows: DataFrame, personal: int, everyone: int, user: str = "user_id", day: str = "day", order: tuple[str, ...] = ("ts", "event_id"), tokens: str = "tokens") -> DataFrame:
    """verdict per request: blocked by the personal quota, else by the one for all, else pass.

    Blocked requests spend nothing. With tokens of 0 or more this has a closed form: a user's sum of
    all earlier tokens decides the personal gate; over the rows that pass it, the day's sum decides
    the common gate; who is over both is told the personal reason."""
    keys = [user, day]
    first = rows.withColumn("__mine", before(keys, list(order), tokens)).withColumn("__ok", F.col("__mine") < personal)
    passing = first.withColumn("__spend", F.when(F.col("__ok"), F.col(tokens)).otherwise(0))
    both = daily_totals_before(passing, day, list(order), "__spend").withColumn("__open", F.col("__before") < everyone)
    spent = F.when(F.col("__ok") & F.col("__open"), F.col(tokens)).otherwise(0)
    final = both.withColumn("__spent", spent).withColumn("used", before(keys, list(order), "__spent"))
    verdict = F.when(F.col("used") >= personal, "personal").when(~F.col("__open"), "global").otherwise("pass")
    return final.withColumn("verdict", verdict).drop("__mine", "__ok", "__spend", "__before", "__open", "__spent")


def within_limit(rows: DataFrame, key: str, ts: str, order: str, unit: str, limit: int) -> Column:
    """Whether a request is among the first `limit` of its key's fixed window."""
    w = Window.partitionBy(key, F.date_trunc(unit, F.col(ts).cast("timestamp"))).orderBy(ts, order)
    return F.row_number().over(w) <= limit


def replay_cache(rows: DataFrame, key: str, ttl: int = TTL, ts: str = "ts", order: str = "event_id", degraded: str | None = None) -> DataFrame:
    """hit per request of a cache that is written on a miss only and not refreshed by hits.

    Whether a request hits depends on the last miss, so each key's requests are folded in order, in
    a sorted stream: a key's state is one time stamp, however many requests it has."""
    flag = F.col(degraded) if degraded else F.lit(False)
    columns = rows.select(F.col(key).cast("string").alias("key"), F.col(order).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), flag.alias("degraded"))
    ordered = columns.repartition("key").sortWithinPartitions("key", "at", "id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, written = None, None
        for frame in frames:
            hits = []
            for key, at, bad in zip(frame["key"], frame["at"], frame["degraded"], strict=True):
                if key != current:
                    current, written = key, None
                hit = written is not None and at < written + ttl * 1_000_000
                if not hit:
                    written = None if bad else at
                hits.append(hit)
            yield pd.DataFrame({"id": frame["id"], "hit": hits})

    return ordered.mapInPandas(fold, "id long, hit boolean")
