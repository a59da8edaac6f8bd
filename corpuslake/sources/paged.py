"""A paged service as a Spark data source: pages by number until an empty or a short one.

The call itself is an option, `fetch` = `module:function`, of (url, page, size) to a list of records: no network is
needed to read, or to test. A function that raises Throttled is asked again, TRIES times in all, after waits that double.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").schema("id long, name string").option("fetch", "my.module:page").load(url)

As a stream it reads on where the last batch ended, page by page: records that a service adds at its end come as new rows.
The offset is the number of records read of each url, so a restarted stream gives each record once.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SIZE, TRIES = 100, 3

Fetch = Callable[[str, int, int], list[dict]]


class Throttled(Exception):
    """The service asks to come back later."""


def fetched(fetch: Fetch, url: str, page: int, size: int, wait: float = 1.0) -> list[dict]:
    for attempt in range(TRIES):
        try:
            return fetch(url, page, size)
        except Throttled:
            if attempt == TRIES - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


def records(fetch: Fetch, url: str, size: int = SIZE, wait: float = 1.0) -> Iterator[dict]:
    page = 1
    while True:
        found = fetched(fetch, url, page, size, wait)
        yield from found
        if len(found) < size:
            return
        page += 1


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PagedStream(schema, dict(self.options))


class PagedStream(SimpleDataSourceStreamReader):
    """A batch holds a page of each url at most (option `pages`: so many), for such a reader runs in the driver."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.urls = schema.names, options["path"].split(",")
        module, name = options["fetch"].split(":")
        self.fetch: Fetch = getattr(importlib.import_module(module), name)
        self.size, self.wait, self.pages = int(options.get("size", SIZE)), float(options.get("wait", "1")), int(options.get("pages", "1"))

    def initialOffset(self) -> dict:
        return {url: 0 for url in self.urls}

    def after(self, url: str, start: int, end: int) -> list[dict]:
        """Records start to end of a url, as far as there are any."""
        out: list[dict] = []
        for page in range(start // self.size, -(-end // self.size)):
            found = fetched(self.fetch, url, page + 1, self.size, self.wait)
            out += found[max(start - page * self.size, 0) : end - page * self.size]
            if len(found) < self.size:
                break
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for url in self.urls:
            at = start.get(url, 0)
            new = self.after(url, at, (at // self.size + self.pages) * self.size)
            rows += [tuple(r.get(n) for n in self.names) for r in new]
            end[url] = at + len(new)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for url in self.urls:
            for record in self.after(url, start.get(url, 0), end[url]):
                yield tuple(record.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        """A service of pages keeps its records: there is nothing to let go."""


class PagedReader(DataSourceReader):
    """A next page is known only after the one before, so a service is one partition; several urls, by commas, are several."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(url) for url in self.options["path"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, name = self.options["fetch"].split(":")
        fetch = getattr(importlib.import_module(module), name)
        size, wait = int(self.options.get("size", SIZE)), float(self.options.get("wait", "1"))
        for record in records(fetch, partition.value, size, wait):
            yield tuple(record.get(n) for n in self.names)


def numbered(url: str, page: int, size: int) -> list[dict]:
    """A stand-in service: `first-last` as its url, records numbered from first to last."""
    first, last = map(int, url.rsplit("/", 1)[-1].split("-"))
    start = first + (page - 1) * size
    return [{"id": i, "name": f"card {i}"} for i in range(start, min(start + size, last + 1))]
