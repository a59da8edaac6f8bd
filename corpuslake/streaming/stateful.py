"""State with timers: answer streams, write-once caches, fixed windows and chained gates.

A state key is a block of users, queries or cache keys, by hash (of one day, for what ends with the day): a call, its state and
its timer cost as much for a block as for a single key, so work grows with rows and not with keys. A block's state is one
table, read and written once a batch. Rows of a block are taken in event order within a batch; batches are taken to come in order,
up to the watermark. All state is given up by event-time timers, so it does not outlive the watermark. These need the state
store that `rocks` names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Blocks of keys; and of a day's users, where state ends with the day.
BLOCKS, DAY_BLOCKS = 128, 32
#: Rows of a day's common gate that leave it at once.
SLICE = 50_000


def rocks(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB, which timers and several states a key need."""
    spark.conf.set(STORE, PROVIDER)


def block_of(key: str | Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


def in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable", ignore_index=True)


def day_end(ts: pd.Series) -> int:
    return (int(micros(ts).max()) // 1000 // DAY_MS + 1) * DAY_MS


class Timed(StatefulProcessor):
    """A block's state is one table of `fields`, and has one timer; when that ends, so does the state."""

    fields: tuple[tuple[str, pa.DataType], ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "rows binary")

    def load(self) -> pa.Table:
        found = self.kept.get()  # None where there is none
        return pa.schema(self.fields).empty_table() if found is None else pa.ipc.open_stream(found[0]).read_all()

    def store(self, *columns: Any) -> None:
        table = pa.Table.from_arrays([pa.array(c, type=kind, from_pandas=True) for c, (_, kind) in zip(columns, self.fields, strict=True)], schema=pa.schema(self.fields))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.kept.update((sink.getvalue().to_pybytes(),))

    def until(self, at: int) -> None:
        """The block's timer, in place of the one it has."""
        old = list(self.handle.listTimers())
        if old != [at]:
            for timer in old:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


class Answers(Timed):
    """Tokens append, a restart clears, a final replaces and ends, an error ends; a text that comes to hold what it must not ends
    at that token; a stream of which nothing has come when the watermark is `idle` ms past its last event ends as idle. What comes
    after the end is ignored for another `idle` ms. The block's timer is that of the stream that has been silent longest."""

    fields = (("query_id", pa.int64()), ("ended", pa.bool_()), ("text", pa.string()), ("until", pa.int64()))

    def __init__(self, idle: int, leak: str | None, fallback: str):
        self.idle, self.leak, self.fallback = idle, leak, fallback

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.guard = re.compile(self.leak) if self.leak else None

    def held(self) -> dict[int | None, tuple[bool, str, int]]:
        query, *rest = self.load().to_pydict().values()
        return dict(zip(query, zip(*rest, strict=True), strict=True))

    def keep(self, held: dict[int | None, tuple[bool, str, int]]) -> None:
        if not held:
            self.kept.clear()
            return
        self.store(list(held), *zip(*held.values(), strict=True))

    def answers(self, ends: list[tuple[int | None, str | None, str]]) -> pd.DataFrame:
        return pd.DataFrame({"query_id": pd.array([e[0] for e in ends], dtype="Int64"), "answer": [e[1] for e in ends], "state": [e[2] for e in ends]})

    def leaks(self, before: str, tokens: list[str]) -> bool:
        """Whether the text comes to hold what it must not with these tokens. The whole text is searched."""
        return bool(self.guard and self.guard.search(before + "".join(tokens)))

    def folded(self, text: str, events: list[str], data: list[str | None]) -> tuple[str, tuple[str | None, str] | None]:
        """The text after these events, and its end if there is one: answer, state."""
        new: list[str] = []
        for event, said in zip([*events, None], [*data, None], strict=True):
            if event == "token":
                new.append(said or "")
                continue
            if new and self.leaks(text, new):
                return "", (self.fallback, "leaked")
            text, new = text + "".join(new), []
            if event == "restart":
                text = ""
            elif event in ("final", "error"):
                return "", (said if event == "final" else text, event)
        return text, None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = in_order(rows, "query_id", "seq")
        query = events["query_id"].astype("Int64")
        at, kinds, data = micros(events["ts"]) // 1000, events["event"].tolist(), events["data"].tolist()
        cuts = [*np.flatnonzero((query != query.shift()).fillna(True).to_numpy(bool)).tolist(), len(events)]
        names = [None if pd.isna(q) else int(q) for q in query.iloc[cuts[:-1]]]
        held, ends = self.held(), []
        for name, (a, b) in zip(names, pairwise(cuts), strict=True):
            ended, text, last = held.get(name, (False, "", 0))
            if not ended:
                text, end = self.folded(text, kinds[a:b], data[a:b])
                if end:
                    ended = True
                    ends.append((name, *end))
            held[name] = (ended, text, max(last, int(at[a:b].max()) + self.idle))
        self.keep(held)
        self.until(min(h[2] for h in held.values()))
        if ends:
            yield self.answers(ends)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self.held()
        gone = {q: h for q, h in held.items() if h[2] < now}
        rest = {q: h for q, h in held.items() if q not in gone}
        self.keep(rest)
        if rest:
            self.handle.registerTimer(min(h[2] for h in rest.values()))
        idle = [(q, text, "idle") for q, (ended, text, _) in gone.items() if not ended]
        if idle:
            yield self.answers(idle)


class Cache(Timed):
    """A request hits what was written at most ttl before it; a miss writes, unless its answer is degraded; hits do not refresh.
    What has run out is left out whenever a block is written."""

    fields = (("key", pa.string()), ("at", pa.int64()))

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events, hits = in_order(rows, "ts", "id"), []
        written = dict(zip(*self.load().to_pydict().values(), strict=True))
        for name, at, degraded in zip(events["key"].tolist(), micros(events["ts"]).tolist(), events["degraded"].tolist(), strict=True):
            hits.append(name in written and at < written[name] + self.ttl)
            if not hits[-1]:
                written[name] = at
                if degraded:
                    del written[name]
        now = timerValues.getCurrentWatermarkInMs()
        live = {name: at for name, at in written.items() if (at + self.ttl) // 1000 + 1 >= now}
        if live:
            self.store(list(live), list(live.values()))
            self.until((max(live.values()) + self.ttl) // 1000 + 1)
        else:
            self.kept.clear()
        yield pd.DataFrame({"id": events["id"], "hit": hits})


class Spending(Timed):
    """What users of a block have spent of a day."""

    fields = (("user_id", pa.int64()), ("tokens", pa.int64()))

    def spent_before(self, events: pd.DataFrame, tokens: pd.Series) -> pd.Series:
        """Of each row, what its user had spent before it, on this day; `tokens` are what the rows spend."""
        users, day = events["user_id"].astype("Int64"), self.load().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        old = users.to_frame().merge(day, on="user_id", how="left")["tokens"].fillna(0).astype("int64")
        within = tokens.groupby(users, dropna=False, sort=False).cumsum() - tokens
        sums = pd.concat([day, pd.DataFrame({"user_id": users, "tokens": tokens.astype("Int64")})]).groupby("user_id", dropna=False, sort=False)["tokens"].sum()
        self.store(sums.index.to_series(), sums)
        self.until(day_end(events["ts"]))
        return old + within


class Personal(Spending):
    """Whether the tokens that a user asked for before each request of a day are below the quota."""

    def __init__(self, quota: int):
        self.quota = quota

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = in_order(rows, "ts", "event_id")
        events["tokens"] = events["tokens"].fillna(0).astype("int64")
        yield events.assign(ok=self.spent_before(events, events["tokens"]) < self.quota)[["event_id", "ts", "user_id", "day", "block", "tokens", "ok"]]


class Everyone(Timed):
    """Whether the day's quota is open to each request: over what passed the personal one.

    A day is one ordered key: a gate that all requests share lets them by one at a time. Its state is one number, and all that
    concerns single users is left to the gates before and after it."""

    fields = (("total", pa.int64()),)

    def __init__(self, quota: int):
        self.quota = quota

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = in_order(rows, "ts", "event_id")
        counted = events["tokens"].where(events["ok"], 0)
        total = sum(self.load()["total"].to_pylist())
        before = total + counted.cumsum() - counted
        self.store([total + int(counted.sum())])
        self.until(day_end(events["ts"]))
        events["open"] = before < self.quota
        for at in range(0, len(events), SLICE):
            yield events.iloc[at : at + SLICE][["event_id", "ts", "user_id", "day", "block", "tokens", "ok", "open"]]


class Verdict(Spending):
    """Of a request: what its user had spent, and who stopped it."""

    def __init__(self, personal: int):
        self.personal = personal

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = in_order(rows, "ts", "event_id")
        used = self.spent_before(events, events["tokens"].where(events["ok"] & events["open"], 0))
        verdict = np.where(used >= self.personal, "personal", np.where(events["open"], "pass", "global"))
        yield pd.DataFrame({"event_id": events["event_id"], "used": used, "verdict": verdict})


class Windows(Timed):
    """The first of the windows (name, ms, limit), all within a day, of whose requests a user's request is not among the first `limit`."""

    fields = (("user_id", pa.int64()), ("size", pa.int64()), ("slot", pa.int64()), ("seen", pa.int64()))

    def __init__(self, limits: tuple[tuple[str, int, int], ...]):
        self.limits = limits

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = in_order(rows, "ts", "event_id")
        users, at = events["user_id"].astype("Int64"), micros(events["ts"]) // 1000
        state, now = self.load().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), timerValues.getCurrentWatermarkInMs()
        verdict, parts = pd.Series("pass", index=events.index), []
        for name, size, limit in reversed(self.limits):
            keys = pd.DataFrame({"user_id": users, "slot": pd.array(at // size, dtype="Int64")})
            old = state.loc[state["size"] == size, ["user_id", "slot", "seen"]]
            before = keys.merge(old, on=["user_id", "slot"], how="left")["seen"].fillna(0).astype("int64")
            verdict = verdict.mask(before + keys.groupby(["user_id", "slot"], dropna=False, sort=False).cumcount() >= limit, name)
            sums = pd.concat([old, keys.assign(seen=pd.array(np.ones(len(keys), np.int64), dtype="Int64"))]).groupby(["user_id", "slot"], dropna=False, sort=False)["seen"].sum().reset_index()
            parts.append(sums[(sums["slot"] + 1) * size > now].assign(size=size))
        kept = pd.concat(parts)
        self.store(*(kept[name] for name, _ in self.fields))
        self.until(day_end(events["ts"]))
        yield pd.DataFrame({"event_id": events["event_id"], "verdict": verdict})


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def fold_answers(rows: DataFrame, leak: str | None = None, fallback: str = "", idle: int = 60, lateness: str = "0 seconds") -> DataFrame:
    """query_id, answer, state of a stream of (query_id, ts, seq, event, data): final, error, leaked or idle (after `idle` seconds)."""
    keyed = _timed(rows, lateness).withColumn("block", block_of("query_id", BLOCKS)).groupBy("block")
    return keyed.transformWithStateInPandas(Answers(idle * 1000, leak, fallback), "query_id long, answer string, state string", "append", "eventTime")


def cache(rows: DataFrame, ttl: int, lateness: str = "1 hour") -> DataFrame:
    """id, hit of a stream of (key, ts, id, degraded): metering.replay_cache as requests come."""
    keyed = _timed(rows, lateness).select("key", "ts", "id", "degraded", block_of("key", BLOCKS).alias("block")).groupBy("block")
    return keyed.transformWithStateInPandas(Cache(ttl), "id long, hit boolean", "append", "eventTime")


def quota_gates(rows: DataFrame, personal: int, everyone: int, lateness: str = "1 hour") -> DataFrame:
    """event_id, used, verdict of a stream of (event_id, ts, user_id, tokens): metering.quota_gate as requests come. Three gates in a
    row, each with its own state; the watermark passes through all."""
    out = _timed(rows, lateness).select("event_id", "ts", "user_id", F.to_date("ts").alias("day"), block_of("user_id", DAY_BLOCKS).alias("block"), "tokens")
    schema = "event_id long, ts timestamp, user_id long, day date, block int, tokens long, ok boolean"
    out = out.groupBy("day", "block").transformWithStateInPandas(Personal(personal), schema, "append", "eventTime", eventTimeColumnName="ts")
    out = out.groupBy("day").transformWithStateInPandas(Everyone(everyone), f"{schema}, open boolean", "append", "eventTime", eventTimeColumnName="ts")
    return out.groupBy("day", "block").transformWithStateInPandas(Verdict(personal), "event_id long, used long, verdict string", "append", "eventTime")


def rate_limits(rows: DataFrame, per_hour: int, per_day: int, lateness: str = "1 hour") -> DataFrame:
    """event_id, verdict (hour, day or pass) of a stream of (event_id, ts, user_id), by fixed windows of both sizes."""
    keyed = _timed(rows, lateness).select("event_id", "ts", "user_id", F.to_date("ts").alias("day"), block_of("user_id", DAY_BLOCKS).alias("block")).groupBy("day", "block")
    windows = Windows((("hour", DAY_MS // 24, per_hour), ("day", DAY_MS, per_day)))
    return keyed.transformWithStateInPandas(windows, "event_id long, verdict string", "append", "eventTime")
