"""A ledger that streams append to exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger's rows, with the stream and batch that wrote each."""
    return spark.read.schema(f"{schema}, stream string, batch long").parquet(path)


def keeping(path: str, name: str, then: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. The batch's id is its partition: a batch that is tried again, whether its first try failed before,
    in or after its write, takes the place of what that wrote. `then` runs after each write (to tell others, say) and may fail."""

    def put(rows: DataFrame, batch: int) -> None:
        named = rows.withColumn("stream", F.lit(name)).withColumn("batch", F.lit(batch).cast("long"))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(path)
        if then:
            then(batch)

    return put


def appended(rows: DataFrame, path: str, name: str, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Run a stream into the ledger for the input there is. `name` and `checkpoint` belong together: a new checkpoint counts
    batches anew and needs a new name."""
    return rows.writeStream.foreachBatch(keeping(path, name, then)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
