"""State with timers over several batches: it ends when it should, and verdicts are those of the batch forms."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import metering
from corpuslake.streaming import stateful

EVENTS = "query_id long, ts timestamp, seq long, event string, data string"


def stamp(second):
    return f"2024-01-{1 + second // 86400:02d}T{second // 3600 % 24:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


def stream(spark, folder, schema, batches):
    folder.mkdir()
    for n, rows in enumerate(batches):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drained(frame, tmp_path, name):
    """The rows that a stream appends, and its query, ended."""
    stateful.rocks(frame.sparkSession)
    query = frame.writeStream.option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).outputMode("append").format("parquet").start(f"{tmp_path}/{name}-rows")
    query.awaitTermination()
    return sorted(map(tuple, frame.sparkSession.read.schema(frame.schema).parquet(f"{tmp_path}/{name}-rows").collect())), query


def state_rows(query):
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def event(query, second, seq, kind, data=""):
    return {"query_id": query, "ts": stamp(second), "seq": seq, "event": kind, "data": data}


def test_answers_end_once_and_silent_ones_are_idle(spark, tmp_path):
    batches = [
        [event(1, 0, 1, "token", "a"), event(1, 1, 2, "token", "b"), event(2, 1, 1, "token", "x"), event(3, 2, 1, "token", "quiet")],
        [event(1, 20, 3, "restart"), event(1, 21, 4, "token", "c"), event(2, 22, 2, "error"), event(2, 23, 3, "token", "late")],
        [event(1, 40, 5, "final", "done"), event(1, 41, 6, "token", "late")],
        [event(4, 200, 1, "token", "d"), event(4, 201, 2, "final", "e")],
        [event(5, 900, 1, "final", "f")],
        [event(6, 5000, 1, "error")],
    ]
    got, query = drained(stateful.fold_answers(stream(spark, tmp_path / "in", EVENTS, batches)), tmp_path, "answers")
    assert got == [(1, "done", "final"), (2, "x", "error"), (3, "quiet", "idle"), (4, "e", "final"), (5, "f", "final"), (6, "", "error")]
    assert max(state_rows(query)) > 3
    assert state_rows(query)[-1] <= 4  # only what the last event's key holds


def test_state_is_empty_when_all_streams_have_ended(spark, tmp_path):
    batches = [[event(q, q, s, "token", "t") for q in range(20) for s in range(5)], [event(q, 30, 9, "final", "z") for q in range(10)], [event(99, 10_000, 1, "token", "")], [event(99, 20_000, 2, "token", "")]]
    got, query = drained(stateful.fold_answers(stream(spark, tmp_path / "in", EVENTS, batches)), tmp_path, "answers")
    assert len([r for r in got if r[2] == "final"]) == 10 and len([r for r in got if r[2] == "idle"]) == 10
    others = state_rows(query)
    assert others[-1] <= 4 < max(others)


def test_a_leak_is_found_however_far_it_reaches(spark, tmp_path):
    batches = [[event(1, 1, 1, "token", "the system"), event(2, 1, 1, "token", "harmless")], [event(1, 2, 2, "token", " " * 250)], [event(1, 3, 3, "token", "prompt is"), event(1, 4, 4, "token", " more")], [event(1, 5, 5, "final", "no"), event(2, 6, 2, "final", "ok")]]
    got, _ = drained(stateful.fold_answers(stream(spark, tmp_path / "in", EVENTS, batches), r"(?i)system\s+prompt", "sorry"), tmp_path, "guard")
    assert got == [(1, "sorry", "leaked"), (2, "ok", "final")]


def test_a_restart_forgets_what_would_have_leaked(spark, tmp_path):
    batches = [[event(1, 1, 1, "token", "system ")], [event(1, 2, 2, "restart"), event(1, 3, 3, "token", "prompt")], [event(1, 4, 4, "final", "ok")]]
    got, _ = drained(stateful.fold_answers(stream(spark, tmp_path / "in", EVENTS, batches), r"system\s+prompt", "sorry"), tmp_path, "restart")
    assert got == [(1, "ok", "final")]


REQUESTS = "event_id long, ts timestamp, user_id long, tokens long, key string, degraded boolean"


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(6)
    seconds = sorted(rng.randrange(3 * 86400) for _ in range(600))
    rows = [{"event_id": i, "ts": stamp(s), "user_id": rng.choice([1, 1, 1, 2, 3, 4]), "tokens": rng.randrange(40), "key": rng.choice("abcde"), "degraded": rng.random() < 0.3} for i, s in enumerate(seconds)]
    return [rows[i : i + 75] for i in range(0, 600, 75)]


def batch(spark, requests):
    rows = spark.createDataFrame([tuple(r.values()) for part in requests for r in part], REQUESTS.replace("ts timestamp", "ts string"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))


def test_the_cache_hits_as_the_replay_does(spark, tmp_path, requests):
    got, query = drained(stateful.cache(stream(spark, tmp_path / "in", REQUESTS, requests).withColumnRenamed("event_id", "id"), 3600), tmp_path, "cache")
    expected = metering.replay_cache(batch(spark, requests), "key", 3600, degraded="degraded").collect()
    assert got == sorted(map(tuple, expected)) and any(r[1] for r in got)


def test_chained_gates_judge_as_the_batch_does(spark, tmp_path, requests):
    got, query = drained(stateful.quota_gates(stream(spark, tmp_path / "in", REQUESTS, requests), 300, 700), tmp_path, "gates")
    expected = metering.quota_gate(batch(spark, requests), 300, 700).select("event_id", "used", "verdict").collect()
    assert got == sorted(map(tuple, expected))
    assert {r[2] for r in got} == {"personal", "global", "pass"}


def test_windows_judge_as_the_batch_does(spark, tmp_path, requests):
    got, query = drained(stateful.rate_limits(stream(spark, tmp_path / "in", REQUESTS, requests), 2, 9), tmp_path, "windows")
    rows = batch(spark, requests)
    hour, day = (metering.within_limit(rows, "user_id", "ts", "event_id", *x) for x in (("HOUR", 2), ("DAY", 9)))
    expected = rows.select("event_id", F.when(~hour, "hour").when(~day, "day").otherwise("pass").alias("verdict")).collect()
    assert got == sorted(map(tuple, expected)) and len({r[1] for r in got}) == 3
    assert state_rows(query)[-1] < max(state_rows(query))


def test_blocks_bound_the_state_of_many_users(spark, tmp_path):
    users, hours = 400, 3
    batches = [[{"event_id": h * users * 2 + n, "ts": stamp(h * 3600 + n), "user_id": n % users or None, "tokens": 30} for n in range(users * 2)] for h in range(hours)]
    schema = "event_id long, ts timestamp, user_id long, tokens long"
    limited, query = drained(stateful.rate_limits(stream(spark, tmp_path / "in", schema, batches), 1, 2), tmp_path, "limits")
    assert max(state_rows(query)) <= 3 * stateful.DAY_BLOCKS  # a state and the two entries of a timer
    judged = [("pass", "hour"), ("pass", "hour"), ("day", "hour")]
    assert limited == sorted((h * users * 2 + n, "day" if h and judged[h][n // users] == "pass" else judged[h][n // users]) for h in range(hours) for n in range(users * 2))
    gated, query = drained(stateful.quota_gates(stream(spark, tmp_path / "in2", schema, batches), 100, 10**9), tmp_path, "gated")
    assert max(state_rows(query)) <= 3 * (2 * stateful.DAY_BLOCKS + 1)
    assert gated == sorted((h * users * 2 + n, used := min(120, 30 * (2 * h + n // users)), "personal" if used >= 100 else "pass") for h in range(hours) for n in range(users * 2))


def test_streams_of_one_block_end_each_at_its_own_time(spark, tmp_path):
    batches = [[event(q, q * 10, 1, "token", f"t{q}") for q in range(300)], [event(q, 3000 + q, 2, "final", "z") for q in range(295, 300)], [event(7, 9000, 1, "error")], [event(8, 9001, 1, "error")]]
    got, query = drained(stateful.fold_answers(stream(spark, tmp_path / "in", EVENTS, batches)), tmp_path, "many")
    assert got == sorted([(q, f"t{q}", "idle") for q in range(295)] + [(q, "z", "final") for q in range(295, 300)] + [(7, "", "error"), (8, "", "error")])
    assert max(state_rows(query)) <= 3 * stateful.BLOCKS
