"""Sinks that write once what they should, sources that give it once, joins by ranges, and observed measures."""

import json
import random
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpuslake.operators import asof
from corpuslake.operators.observed import Observer, StreamObserver, watch_stream
from corpuslake.plans import storage
from corpuslake.sources import paged, sinks
from corpuslake.streaming import ledger


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def floor_of(keys, k):
    below = [a for a in keys if a[0] is not None and k is not None and a[0] <= k]
    return max(below)[1] if below else None


@pytest.mark.parametrize(("n", "anchors"), [(3000, 40), (3000, 1), (500, 0), (0, 5)])
def test_rows_meet_the_last_anchor_at_or_below_them(spark, n, anchors):
    """One key holds half of the rows."""
    rng = random.Random(n + anchors)
    rows = [(i, 500 if i % 2 else rng.choice([None, *range(-50, 1000)]), "x") for i in range(n)]
    points = [(rng.randrange(1000), f"p{i}") for i in range(anchors)] + [(None, "nowhere")] * (anchors > 1)
    got = asof.floored(spark.createDataFrame(rows, "id long, k long, note string").repartition(4), spark.createDataFrame(points, "k long, page string"), "k")
    assert got.columns == ["id", "k", "note", "page"]
    assert sorted((r["id"], r["page"]) for r in got.collect()) == [(i, floor_of(points, k)) for i, k, _ in rows]


def test_no_partition_of_an_as_of_join_holds_a_hot_key_alone(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else rows as few as these come together again
    try:
        got = asof.floored(rows, rows.filter("id % 100 = 1").select("k", F.col("id").alias("page")), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = plan_of(got)
    assert "Window" in plan and "SinglePartition" not in plan and "Window [last(__anchor" in plan.replace("'", "")
    path = plan.split("InMemoryFileIndex(1 paths)[")[1].split("]")[0]
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("__part").count().collect()]
    assert max(sizes) < 0.5 * sum(sizes)


def fed(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_a_batch_that_failed_after_its_write_is_there_once(spark, tmp_path):
    schema, failures = "event_id long, user_id long", iter([True, False, True, True, False, False])
    tries = []

    def then(batch):
        tries.append(batch)
        if next(failures, False):
            raise RuntimeError("after the write")

    for n in range(3):
        fed(tmp_path / "in", n, [{"event_id": 10 * n + i, "user_id": i} for i in range(4)])
        for _ in range(4):
            rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
            try:
                ledger.appended(rows, f"{tmp_path}/ledger", "a", f"{tmp_path}/state", then).awaitTermination()
                break
            except StreamingQueryException:
                continue
    got = ledger.recorded(spark, f"{tmp_path}/ledger", schema)
    assert sorted(r["event_id"] for r in got.collect()) == [10 * n + i for n in range(3) for i in range(4)]
    assert tries == [0, 0, 1, 1, 1, 2] and sorted({r["batch"] for r in got.collect()}) == [0, 1, 2]


def test_two_streams_share_a_ledger(spark, tmp_path):
    fed(tmp_path / "in", 0, [{"event_id": 1, "user_id": 1}])
    for name in ("a", "b"):
        rows = spark.readStream.schema("event_id long, user_id long").json(f"{tmp_path}/in")
        ledger.appended(rows, f"{tmp_path}/ledger", name, f"{tmp_path}/state-{name}").awaitTermination()
    assert sorted(r["stream"] for r in ledger.recorded(spark, f"{tmp_path}/ledger", "event_id long, user_id long").collect()) == ["a", "b"]


def test_a_paged_stream_gives_each_record_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    service = tmp_path / "service"
    for upto in (5, 5, 12, 30):
        service.write_text("".join(f"{i}\n" for i in range(upto)))
        rows = spark.readStream.format("paged").schema("id long, name string").option("fetch", "tests.paged_service:page").option("size", "4").load(str(service))
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/rows")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        got = spark.read.schema("id long, name string").parquet(f"{tmp_path}/rows")
        assert sorted(r["id"] for r in got.collect()) == list(range(upto))


def test_a_paged_stream_reads_between_offsets(tmp_path):
    service = tmp_path / "service"
    service.write_text("".join(f"{i}\n" for i in range(11)))
    reader = paged.PagedStream(__import__("pyspark").sql.types.StructType.fromDDL("id long"), {"path": str(service), "fetch": "tests.paged_service:page", "size": "4"})
    assert reader.initialOffset() == {str(service): 0}
    rows, end = reader.read({str(service): 3})
    assert [r[0] for r in rows] == [3] and end == {str(service): 4}
    assert [r[0] for r in reader.readBetweenOffsets({str(service): 3}, {str(service): 10})] == list(range(3, 10))
    rows, end = reader.read({str(service): 11})
    assert not list(rows) and end == {str(service): 11}


def test_windows_over_a_bucketed_ledger_need_no_shuffle(spark, tiny):
    base = storage.fresh_folder(spark, "ledger-test")
    rows = storage._metered(spark, tiny).select("event_id", "ts", "user_id", "tokens", "day")
    plan = plan_of(storage.limits(sinks.bucketed_ledger(rows, "ledger_of_a_test", base, buckets=4)))
    assert plan.count("Window [") + plan.count("Window(") >= 2 and "Exchange" not in plan and "Bucketed: true" in plan
    assert "Exchange" in plan_of(storage.limits(rows))
    spark.sql("DROP TABLE ledger_of_a_test")


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_an_upsert_writes_the_partitions_of_its_keys_only(spark, tmp_path):
    path = f"{tmp_path}/corpus"
    rows = spark.range(200).select("id", F.lit("old").alias("content"), F.lit("s").alias("section"), F.lit("v1").alias("corpus_version"))
    sinks.corpus(rows, path, parts=8)
    before = files(path)
    new = spark.createDataFrame([(3, "new", "changed", "v2"), (1000, "new", "added", "v2")], rows.schema)
    touched = sinks.upserted(spark, path, new, parts=8)
    after = files(path)
    same = {k for k in before if after.get(k) == before[k]}
    assert 1 <= len(touched) <= 2
    assert {k for k in before if not any(f"part={p}/" in k for p in touched)} == same
    got = {r["id"]: (r["content"], r["section"], r["corpus_version"]) for r in spark.read.parquet(path).collect()}
    assert len(got) == 201 and got[3] == ("new", "s", "v2") and got[1000] == ("new", "added", "v2") and got[4] == ("old", "s", "v1")
    assert sinks.upserted(spark, path, new.limit(0), parts=8) == [] and files(path) == after


def test_measures_of_a_batch_and_none_when_off(spark, tmp_path):
    seen, off = Observer(), Observer(on=False)
    rows = spark.range(100)
    seen.watch(rows, "ids", n=F.count(F.lit(1)), most=F.max("id")).filter("id < 10").write.parquet(f"{tmp_path}/x")
    assert seen.values("ids") == {"n": 100, "most": 99} and seen.values("other") == {}
    assert off.watch(rows, "ids", n=F.count(F.lit(1))) is rows and off.values("ids") == {}


def test_measures_of_each_batch_of_a_stream(spark, tmp_path):
    for n in range(3):
        fed(tmp_path / "in", n, [{"event_id": i, "user_id": 1} for i in range(n + 1)])
    listener = StreamObserver()
    spark.streams.addListener(listener)
    try:
        rows = watch_stream(spark.readStream.schema("event_id long, user_id long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), "events", n=F.count(F.lit(1)))
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/rows")
        query.awaitTermination()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(b["n"] for b in listener.batches["events"]) == [1, 2, 3] and listener.total("events", "n") == 6
    assert listener.ended == [str(query.id)]
