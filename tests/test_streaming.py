"""Streaming forms against their batch forms, with late rows and state over several batches."""

import json
import os

from pyspark.sql import functions as F

from corpuslake.streaming import flows


def run(frame, tmp_path, name):
    query = frame.writeStream.option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).outputMode("append").format("parquet").start(f"{tmp_path}/{name}-rows")
    query.awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{tmp_path}/{name}-rows")


def write(folder, batches):
    folder.mkdir()
    for n, rows in enumerate(batches):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))


def test_days_close_and_late_rows_are_dropped(spark, tmp_path):
    day = lambda d, h: f"2024-01-0{d}T{h:02d}:00:00"
    write(tmp_path / "in", [
        [{"ts": day(1, 5), "user_id": 1, "tokens": 10}, {"ts": day(1, 23), "user_id": 1, "tokens": 5}],
        [{"ts": day(2, 3), "user_id": 1, "tokens": 4}],
        [{"ts": day(2, 4), "user_id": 1, "tokens": 3}],
        [{"ts": day(1, 6), "user_id": 1, "tokens": 100}, {"ts": day(3, 2), "user_id": 2, "tokens": 1}],
    ])
    rows = spark.readStream.schema("ts timestamp, user_id long, tokens long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    got = run(flows.daily_usage(rows), tmp_path, "usage").select(F.date_format("day", "dd").alias("d"), "user_id", "tokens").collect()
    assert sorted(map(tuple, got)) == [("01", 1, 15), ("02", 1, 7)]
