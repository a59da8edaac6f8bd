"""Where results go. Every sink writes distributed; none collects rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators.lifecycle import UPDATED, upsert
from corpuslake.sources.tables import readable


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    df.withColumns(nested).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ledger(df: DataFrame, path: str) -> None:
    """Append-only."""
    df.write.mode("append").parquet(path)


def bucketed_ledger(df: DataFrame, name: str, path: str, keys: tuple[str, ...] = ("user_id", "day"), order: tuple[str, ...] = ("ts", "event_id"), buckets: int = 32) -> DataFrame:
    """The ledger as a table that is bucketed by user and day and sorted by time within: what is asked of a user's requests of a
    day in order, by day or by parts of a day, is answered bucket by bucket, without a shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def corpus(df: DataFrame, path: str, key: str = "id", parts: int = 64) -> None:
    """A corpus that upserts are written to: partitioned by its key's hash."""
    df.withColumn("part", part_of(key, parts)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def upserted(spark: SparkSession, path: str, new: DataFrame, key: str = "id", updated: tuple[str, ...] = UPDATED, parts: int = 64) -> list[int]:
    """Write new rows into a stored corpus: rows that exist take the new values of `updated`, others are added. Only the partitions that
    hold a key of `new` are read and written again; all others keep their files. Gives the partitions that were written."""
    stored = spark.read.parquet(path)
    fresh = new.withColumn("part", part_of(key, parts))
    touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # at most `parts`
    if touched:
        old = stored.filter(F.col("part").isin(touched)).drop("part")
        rows = upsert(old, new.select(*old.columns), key, updated).withColumn("part", part_of(key, parts))
        rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return touched


def version(df: DataFrame, path: str) -> None:
    """Replace the versions that df holds, and only those."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_version").parquet(path)


def delete_version(spark: SparkSession, path: str, name: str) -> None:
    """Empty the partition of a version; the others are not touched."""
    rest = spark.read.parquet(path).drop("corpus_version").limit(0)
    rest.write.mode("overwrite").parquet(f"{path}/corpus_version={name}")


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one version: only its partition is read."""
    return spark.read.parquet(path).filter(F.col("corpus_version") == name)


def code_module(rows: DataFrame, columns: list[str], name: str, path: str) -> None:
    """Records as the source text of a typed module: a line for each, in order of `columns`, between an opening and a closing line."""
    kind = "; ".join(f"{c}: string" for c in columns)
    body = rows.select(F.lit(1).alias("at"), *columns, F.concat(F.lit("  "), F.to_json(F.struct(*columns)), F.lit(",")).alias("value"))
    none = [F.lit(None).cast("string").alias(c) for c in columns]
    ends = [(0, f"export const {name}: {{ {kind} }}[] = ["), (2, "];")]
    frame = rows.sparkSession.createDataFrame(ends, "at int, value string").select("at", *none, "value")
    lines(body.unionByName(frame), "value", path, ["at", *columns])


def resumable(todo: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, batches: int, stop: Callable[[int], bool] = lambda n: False) -> DataFrame:
    """What `work` makes of the rows, kept at a path in batches: a run that ends early is taken up by the next, which leaves
    out keys that are there. `stop` (a spent quota, say) is asked before each batch. Gives all that is there so far."""
    spark = todo.sparkSession
    made = work(todo.limit(0))
    for n in range(batches):
        if stop(n):
            break
        done = readable(lambda: spark.read.schema(made.schema).parquet(path))
        part = todo.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == n)
        work(part if done is None else part.join(done.select(key), key, "left_anti")).write.mode("append").parquet(path)
    done = readable(lambda: spark.read.schema(made.schema).parquet(path))
    return made if done is None else done


def lines(df: DataFrame, column: str, path: str, by: list[str]) -> None:
    """Text in a total order, as files that read in that order."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).select(column).write.mode("overwrite").text(path)


def event_frame(event: str | Column, payload: Column) -> Column:
    """One server-sent event."""
    name = F.col(event) if isinstance(event, str) else event
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def slug(heading: str | Column) -> Column:
    column = F.col(heading) if isinstance(heading, str) else heading
    kept = F.regexp_replace(F.lower(column), r"[^A-Za-z0-9_\s-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"), F.lit("-"))


def section_map(heading: Column) -> Column:
    """(key, slug) of a heading: the key is its leading number where it has one."""
    number = F.nullif(F.regexp_extract(heading, r"^(\d+)", 1), F.lit(""))
    return F.struct(F.coalesce(number, heading).alias("key"), slug(heading).alias("slug"))
