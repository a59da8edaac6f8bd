"""An inverted-file index of vectors: rows partitioned by cell, codes read before vectors.

Centres are fitted on a bounded sample; every row is written to the partition of its nearest centre, with its code (the
sides it lies on of random planes) beside its vector. A search reads the partitions of each query's nearest cells only,
compares codes there, and then the vectors of the most similar codes. How many cells and codes that takes is measured
when the index is written: exact neighbours of a sample of rows, by the place of their cell and, among the rows of the
cells looked at, of their code. All cells and all codes make the search exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.functions import vectors as V
from corpuslake.session import fresh_folder

#: Rows that centres are fitted on (a bounded sample), and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 20_000, 12
#: Rows whose neighbours measure the index, and the recall that its defaults are to reach.
MEASURED, TARGET = 200, 0.95
#: Queries that meet in one pass: a task holds so many times the bits of a code in counts (20 MB).
BLOCK_QUERIES = 5_000
#: Cells at most, and rows a cell below that.
MOST_CELLS, CELL_ROWS = 4096, 32


@dataclass
class CellIndex:
    """Where an index lies and how it is searched; `centres` are its cells' middles, `load` reads one back."""

    path: str
    kind: str
    rows: int
    k: int
    probes: int
    candidates: int
    recall: float
    centres: list[list[float]]

    def save(self, spark: SparkSession) -> CellIndex:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/about")
        return self

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        return CellIndex(**json.loads(spark.read.text(f"{path}/about").first()["value"]))

    def table(self, spark: SparkSession) -> DataFrame:
        """cell, chunk_id, code, embedding."""
        return spark.read.schema(f"chunk_id long, code binary, embedding {self.kind}, cell int").parquet(f"{self.path}/rows")


def fitted(unit: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors by rounds of nearest centre and mean; an empty cell keeps its centre."""
    centres = unit[np.random.RandomState(cells).choice(len(unit), min(cells, len(unit)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        full = np.bincount(nearest, minlength=len(centres)) > 0
        centres = np.where(full[:, None], sums, centres)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def _celled(rows: DataFrame, centres: np.ndarray, bits: int) -> DataFrame:
    kind = dict(rows.dtypes)["embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            for first in range(0, batch.num_rows, V.TILE_ROWS):
                tile = batch.slice(first, V.TILE_ROWS)
                unit = V.matrix(tile.column("embedding"))
                planes = np.random.RandomState(bits).normal(size=(unit.shape[1], bits)) if planes is None else planes
                codes = pa.array([s.tobytes() for s in np.packbits(unit @ planes > 0, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([tile.column("chunk_id"), codes, tile.column("embedding"), pa.array((unit @ centres.T).argmax(axis=1).astype(np.int32))], ["chunk_id", "code", "embedding", "cell"])

    return rows.select(F.col("chunk_id").cast("long"), "embedding").mapInArrow(place, f"chunk_id long, code binary, embedding {kind}, cell int")


def built(rows: DataFrame, k: int = 10, cells: int | None = None, bits: int = V.CODE_BITS, target: float = TARGET, path: str | None = None) -> CellIndex:
    """Write an index of rows (chunk_id, embedding) and measure how it is to be searched for `k` neighbours."""
    spark = rows.sparkSession
    path = path or fresh_folder(spark, "cells")
    total = rows.count()
    sample = V.matrix(rows.select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("embedding").toArrow().column("embedding").combine_chunks()) if total else np.zeros((0, 1))
    centres = fitted(sample, cells or max(1, min(MOST_CELLS, total // CELL_ROWS))) if total else np.zeros((1, 1))
    # A cell's rows are dealt over as many files as they fill: the plan is split and merged by size.
    _celled(rows, centres, bits).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    index = CellIndex(path, dict(rows.dtypes)["embedding"], total, k, len(centres), max(total, 1), 1.0, centres.tolist())
    return measured(spark, index, target, bits).save(spark) if total else index.save(spark)


def added(index: CellIndex, rows: DataFrame, bits: int = V.CODE_BITS) -> CellIndex:
    """More rows, in the cells that there are; measure again when they have changed the corpus."""
    spark = rows.sparkSession
    _celled(rows, np.array(index.centres), bits).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{index.path}/rows")
    index.rows = index.table(spark).count()
    return index.save(spark)


def measured(spark: SparkSession, index: CellIndex, target: float, bits: int) -> CellIndex:
    """The least cells, then the least codes within them, that keep `target` of the exact neighbours of a sample of rows."""
    table, centres = index.table(spark), np.array(index.centres)
    asked = table.orderBy(F.xxhash64("chunk_id", F.lit(1))).limit(MEASURED).select(F.col("chunk_id").alias("query_id"), "embedding", "code")
    held = asked.toArrow()
    queries = {q: i for i, q in enumerate(held.column("query_id").to_pylist())}
    exact = V.nearest(table, spark.createDataFrame(held.select(["query_id", "embedding"])), index.k)
    true = exact.join(table.select("chunk_id", "cell", "code"), "chunk_id").select("query_id", "cell", "code").collect()  # MEASURED * k rows
    if not true:
        return index
    order = np.argsort(-(V.matrix(held.column("embedding").combine_chunks()) @ centres.T), axis=1)
    place = np.argsort(order, axis=1)
    cell_place = np.array([place[queries[r["query_id"]], r["cell"]] for r in true])
    # Half of what may be lost is lost by cells.
    probes = int(np.sort(cell_place)[min(len(true) - 1, int(np.ceil((1 + target) / 2 * len(true))) - 1)]) + 1
    code = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint64).reshape(len(queries), -1)
    query = np.array([queries[r["query_id"]] for r in true])
    unlike = np.bitwise_count(np.frombuffer(b"".join(bytes(r["code"]) for r in true), np.uint64).reshape(len(true), -1) ^ code[query]).sum(axis=1).astype(np.int64)
    shared = spark.sparkContext.broadcast((code, place < probes, query, unlike))

    def closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, probed, query, unlike = shared.value
        total = np.zeros(len(query), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, V.TILE_ROWS):
                tile = batch.slice(first, V.TILE_ROWS)
                near = (-V._unlike(code, V._bits(tile.column("code")))).astype(np.int64)
                near[~probed[:, tile.column("cell").to_numpy()]] = bits + 1
                near.sort(axis=1)
                total += [np.searchsorted(near[q], d, "right") for q, d in zip(query, unlike, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(query))), pa.array(total)], ["at", "n"])

    counts = table.select("code", "cell").mapInArrow(closer, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()
    code_place = np.array([r["n"] for r in counts])
    kept = np.sort(code_place[cell_place < probes])
    candidates = max(index.k, int(kept[min(len(kept) - 1, int(np.ceil(target * len(true))) - 1)]))
    index.probes, index.candidates = probes, candidates
    index.recall = float(((cell_place < probes) & (code_place <= candidates)).mean())
    return index


def searched(spark: SparkSession, index: CellIndex, queries: DataFrame, k: int | None = None, probes: int | None = None, candidates: int | None = None, digits: int = 9) -> DataFrame:
    """query_id, chunk_id, rank, similarity: the k rows of highest cosine for each query (query_id, embedding), among the rows that
    are looked at. Exact with `probes` and `candidates` of 0: all."""
    k = index.k if k is None else k
    centres = np.array(index.centres)
    probes = index.probes if probes is None else probes or len(centres)
    candidates = index.candidates if candidates is None else candidates or index.rows
    if probes >= len(centres) and candidates >= index.rows:
        return V.nearest(index.table(spark), queries, k, digits=digits)
    parts, table = [], index.table(spark)  # whose folders are listed once
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    for n in range(blocks):
        here = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else queries
        parts.append(_searched(spark, table, here, k, min(probes, len(centres)), candidates, digits, centres))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def asking(wanted: np.ndarray) -> dict[int, np.ndarray]:
    """For each cell, the rows of `wanted` (each a query's cells) that hold it, in one sort of all."""
    order = np.argsort(wanted, axis=None, kind="stable")
    cells, first = np.unique(wanted.reshape(-1)[order], return_index=True)
    return dict(zip(cells.tolist(), np.split(order // wanted.shape[1], first[1:]), strict=True))


def _searched(spark: SparkSession, table: DataFrame, queries: DataFrame, k: int, probes: int, candidates: int, digits: int, centres: np.ndarray) -> DataFrame:
    held = V.coded(queries, "query_id").join(queries.select("query_id", "embedding"), "query_id").toArrow()  # a block of queries
    names = held.column("query_id").to_numpy()
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    if not len(names):
        return spark.createDataFrame([], "query_id long, chunk_id long, similarity double, rank int").select("query_id", "chunk_id", "rank", "similarity")
    unit = V.matrix(held.column("embedding").combine_chunks())
    wanted = np.argpartition(-(unit @ centres.T), probes - 1, axis=1)[:, :probes]
    askers = asking(wanted)
    code = V._bits(held.column("code"))
    shared = spark.sparkContext.broadcast((names, code, askers))
    rows = table.filter(F.col("cell").isin(list(askers)))

    def compared(tile: pa.RecordBatch, code: np.ndarray, askers: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, rows of the tile, and the numbers of unlike bits of their codes, cell by cell and a bounded number at once."""
        cells = tile.column("cell").to_numpy()
        codes = V._bits(tile.column("code"))
        for cell in np.unique(cells):
            here = np.flatnonzero(cells == cell)
            for first in range(0, len(askers[int(cell)]), V.TILE_QUERIES):
                who = askers[int(cell)][first : first + V.TILE_QUERIES]
                yield who, here, -V._unlike(code[who], codes[here]).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query, how many of a task's codes are unlike in how many bits."""
        names, code, askers = shared.value
        width = code.shape[1] * 64 + 1
        counts = np.zeros((len(names), width), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, V.TILE_ROWS):
                for who, _, unlike in compared(batch.slice(first, V.TILE_ROWS), code, askers):
                    np.add.at(counts.reshape(-1), (who[:, None] * width + unlike).ravel(), 1)
        query, unlike = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(unlike), pa.array(counts[query, unlike])], ["query_id", "unlike", "n"])

    # How far codes may be: as far as the `candidates`-th most similar one, with all that are as far.
    few = rows.select("code", "cell").coalesce(2 * spark.sparkContext.defaultParallelism)
    counts = few.mapInArrow(spread, "query_id long, unlike long, n long").groupBy("query_id", "unlike").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("query_id").orderBy("unlike")
    reached = counts.withColumn("before", F.sum("n").over(upto) - F.col("n")).filter(F.col("before") < candidates).groupBy("query_id").agg(F.max("unlike").alias("far"))
    far = {r["query_id"]: r["far"] for r in reached.collect()}  # a block of queries
    limits = spark.sparkContext.broadcast((unit, np.array([far.get(q, -1) for q in names.tolist()])))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task's k nearest vectors for each query, among those whose codes are near enough: no code leaves its task."""
        (names, code, askers), (unit, far) = shared.value, limits.value
        ids, best = np.zeros((len(names), k), np.int64), np.full((len(names), k), -np.inf)
        for batch in batches:
            for first in range(0, batch.num_rows, V.TILE_ROWS):
                tile = batch.slice(first, V.TILE_ROWS)
                vectors, chunks = V.matrix(tile.column("embedding")), tile.column("chunk_id").to_numpy()
                for who, here, unlike in compared(tile, code, askers):
                    query, row = np.nonzero(unlike <= far[who][:, None])
                    near = np.full(unlike.shape, -np.inf)
                    near[query, row] = np.round(np.einsum("ij,ij->i", unit[who[query]], vectors[here[row]]), digits)
                    some = np.flatnonzero((near >= best[who, -1][:, None]).any(axis=1))
                    held = who[some]
                    all_ids = np.concatenate([ids[held], np.broadcast_to(chunks[here], (len(held), len(here)))], 1)
                    every = np.concatenate([best[held], near[some]], 1)
                    order = np.lexsort((all_ids, -every), axis=1)[:, :k]
                    ids[held], best[held] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(every, order, 1)
        found = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[:, None], best.shape)[found]), pa.array(ids[found]), pa.array(best[found])], ["query_id", "chunk_id", "similarity"])

    near = rows.select("chunk_id", "code", "embedding", "cell").mapInArrow(similar, "query_id long, chunk_id long, similarity double")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "similarity")


def looked(spark: SparkSession, index: CellIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """query_id, codes, vectors: the shares of rows whose codes and whose vectors a search reads."""
    centres, probes = np.array(index.centres), index.probes if probes is None else probes
    sizes = {r["cell"]: r["n"] for r in index.table(spark).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_CELLS rows
    count = np.array([sizes.get(c, 0) for c in range(len(centres))])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argpartition(-(V.matrix(batch.column("embedding")) @ centres.T), probes - 1, axis=1)[:, :probes]
            read = count[near].sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(read / index.rows), pa.array(np.minimum(read, index.candidates) / index.rows)], ["query_id", "codes", "vectors"])

    return queries.select(F.col("query_id").cast("long"), "embedding").mapInArrow(share, "query_id long, codes double, vectors double")
