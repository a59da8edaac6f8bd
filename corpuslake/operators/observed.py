"""Measures that are taken of rows as they pass, in batch and in streams; or not at all."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


class Observer:
    """Names measures of batch frames and holds their values, which are there when the frame has been run.

    A frame that runs several times gives its first run's values. Switched off, frames pass as they are and there are no values."""

    def __init__(self, on: bool = True):
        self.on = on
        self.seen: dict[str, Observation] = {}

    def watch(self, rows: DataFrame, name: str, **measures: Column) -> DataFrame:
        if not self.on:
            return rows
        self.seen[name] = Observation(name)
        return rows.observe(self.seen[name], *[m.alias(k) for k, m in measures.items()])

    def values(self, name: str) -> dict[str, Any]:
        """Waits for the frame's run to end."""
        return dict(self.seen[name].get) if name in self.seen else {}


def watch_stream(rows: DataFrame, name: str, **measures: Column) -> DataFrame:
    """Measures of each batch of a stream; a StreamObserver that listens gets them."""
    return rows.observe(name, *[m.alias(k) for k, m in measures.items()])


class StreamObserver(StreamingQueryListener):
    """Collects the measures of all batches of the streams that run while it listens: `spark.streams.addListener`."""

    def __init__(self) -> None:
        self.batches: dict[str, list[dict[str, Any]]] = {}
        self.ended: list[str] = []

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.batches.setdefault(name, []).append(row.asDict())

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.ended.append(str(event.id))

    def total(self, name: str, measure: str) -> int:
        return sum(b[measure] or 0 for b in self.batches.get(name, ()))
