"""Session helpers the operators share: Arrow batch sizes, workers' memory, intermediate tables, gapless numbering, salted joins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslake.session import fresh_folder

ARROW_CONF = {
    # Long texts: a batch is bounded by rows and by bytes, so a Python worker holds a few MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
#: Shuffle files of a finished write go at once, not when the driver's JVM next collects.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, in this session: results are lazy, so the
    settings must still hold when the caller runs them."""
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def returning(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task of a mapInArrow, after which its Python worker gives back the memory that it has freed. Workers go on
    to other tasks: else each keeps the most that any operator's task has taken, beside the executor's JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # of glibc
                libc.malloc_trim(0)

    return run


def settled(df: DataFrame, *measures: Column) -> DataFrame | tuple[DataFrame, dict]:
    """The rows, written once as a table in the shared folder: later readers see the same rows
    whatever executors are lost, and what df was made from is not computed again. With measures
    (named aggregates), also their values over the rows, taken while these are written."""
    spark = df.sparkSession
    path = fresh_folder(spark, "settled")
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    seen = Observation()
    try:
        (df.observe(seen, *measures) if measures else df).write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    rows = spark.read.schema(df.schema).parquet(path)
    return (rows, seen.get) if measures else rows


def dropped(*tables: DataFrame) -> None:
    """Empty the folders of settled tables that have no reader left. No Python worker is started for it."""
    for table in tables:
        if files := table.inputFiles():
            nothing = table.sparkSession.range(0).select(F.col("id").cast("int").alias("none")).coalesce(1)
            nothing.write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def numbered(df: DataFrame, groups: list[str], order: list[str], into: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the given order.

    A group may hold any share of all rows: rows are range-partitioned by group and order (with a
    row number last, so that even equal rows spread), numbered within each partition, and shifted
    by the group's rows in earlier partitions. The shifts are one row per group and partition.
    Nulls order first; equal rows take any order among themselves. An empty table stays empty.
    """
    row, part = "__row", "__part"
    rows = settled(df.withColumn(row, F.monotonically_increasing_id()))  # ranges are found in a pass of their own
    spread = rows.repartitionByRange(*[F.col(c) for c in [*groups, *order, row]]).withColumn(part, F.spark_partition_id())
    spread = settled(spread)
    dropped(rows)
    counts = spread.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(part, *groups).orderBy(*[F.col(c).asc_nulls_first() for c in order], row)
    local = spread.withColumn("__local", F.row_number().over(within) - 1)
    keys = [local[c].eqNullSafe(shifts[c]) for c in [part, *groups]]
    joined = local.join(shifts, keys, "left")
    return joined.select(*[local[c] for c in df.columns], (F.col("__local") + F.col("__shift")).cast("long").alias(into))


#: A key is hot if it holds more than this many times the rows of an average shuffle partition.
HOT_SHARE = 1.0


def hot_keys(rows: DataFrame, *sides: list[str], total: int | None = None) -> list[DataFrame | None]:
    """For each side, a list of key columns, the hot keys and `__parts`, the number of tasks that each is dealt over;
    None if there are none. One pass for all sides. The keys go to Spark in Arrow: of a list of rows it would make an RDD,
    for which each executor starts another Python daemon, with workers of its own.

    Hot is relative to the rows of a task, so at most as many keys are hot as there are shuffle
    partitions, and any other key fits a task."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = HOT_SHARE * (rows.count() if total is None else total) / partitions
    names = [f"k{i}" for i in range(len(sides[0]))]
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), *[F.col(c).alias(k) for c, k in zip(side, names, strict=True)]) for n, side in enumerate(sides)]))
    keyed = rows.select(stacked.alias("x")).select("x.*").dropna()
    found = keyed.groupBy("side", *names).count().filter(F.col("count") > max(task, 1)).toArrow()  # at most `partitions` rows a side
    out: list[DataFrame | None] = []
    for n, side in enumerate(sides):
        here = found.filter(pc.equal(found["side"], n))
        parts = [min(partitions, int(count / task) + 1) for count in here["count"].to_pylist()]
        marked = here.select(names).rename_columns(side).append_column("__parts", pa.array(parts, pa.int32()))
        out.append(rows.sparkSession.createDataFrame(marked) if parts else None)
    return out


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with the facts of their keys (a row per key at most).

    Rows of hot keys are dealt over their parts by their hash, and the facts of these keys, and only these, are
    repeated for each part, so that no key lands in one task. All other rows meet the facts where they lie.
    Both sides grow with the corpus, so the join is a sort-merge join at every size."""
    if hot is None:
        return rows.join(facts.hint("merge"), keys, how)
    few = rows.join(F.broadcast(hot.drop("__parts")), keys, "left_anti").join(facts.hint("merge"), keys, how)
    marks = F.broadcast(hot)
    dealt = rows.join(marks, keys).withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), "__parts").cast("int")).drop("__parts")
    repeated = facts.join(marks, keys).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return few.unionByName(dealt.join(repeated.hint("merge"), [*keys, "__salt"], how).drop("__salt"))


def as_text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def schema_with(df: DataFrame, *fields: T.StructField, drop: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in drop] + list(fields))
