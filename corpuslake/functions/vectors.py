"""Vectors in double precision, and exact nearest neighbours in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query vectors that are broadcast at once (25 MB at 64 numbers each); more go in further passes. A pass reads the
#: corpus once, and compares every row with all of these, so that reading is a small part of it.
BLOCK_QUERIES = 50_000
#: Queries and corpus rows that meet in one matrix in a task (4 to 16 MB).
TILE_QUERIES, TILE_ROWS = 500, 2048
#: Planes of an approximate index.
CODE_BITS = 512

Load = Callable[[pa.Array], np.ndarray]
Compare = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalised(a: str | Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / length)


def matrix(column: pa.Array) -> np.ndarray:
    rows = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, allowed: str | None = None, digits: int = 9) -> DataFrame:
    """query_id, chunk_id, rank, similarity: the k corpus rows of highest cosine for each query.

    corpus: chunk_id, embedding and, with `allowed`, `tag`; queries: query_id, embedding and, with
    `allowed`, `tag`: then only rows of the query's tag, or of the tag `allowed`, count. Queries are
    broadcast in blocks of BLOCK_QUERIES; each task keeps its best k for each query, so what is
    shuffled does not grow with the corpus's rows but with its tasks. Similarities
    are rounded to `digits`; ties go to the lower id.
    """
    rows = _in_blocks(corpus, queries, k, allowed, digits, "embedding", matrix, lambda a, b: a @ b.T)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "similarity")


def _in_blocks(corpus: DataFrame, queries: DataFrame, k: int, allowed: str | None, digits: int, column: str, load: Load, compare: Compare) -> DataFrame:
    """Each task's best k rows for each query, by any comparison of two matrices."""
    columns = ["query_id", column, *(["tag"] if allowed is not None else [])]
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    best = []
    for n in range(blocks):
        here = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else queries
        best.append(_best(corpus, here.select(*columns).toArrow(), k, allowed, digits, column, load, compare))
    return reduce(DataFrame.unionAll, best)


def best_of(near: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The k columns of each row with the largest values; of equal ones those of lower ids. Rounded values and
    places make one whole number each, so that a partition by it is exact."""
    order = np.argsort(ids, kind="stable")
    near, ids = near[:, order], ids[order]
    if near.shape[1] > k:
        steps = np.where(np.isfinite(near), np.rint(near * 10**digits), -(2.0 * 10**digits)).astype(np.int64)
        keys = steps * near.shape[1] - np.arange(near.shape[1])
        top = np.argpartition(keys, near.shape[1] - k, axis=1)[:, -k:]
        return ids[top], np.take_along_axis(near, top, 1)
    return np.broadcast_to(ids, near.shape), near


def _best(corpus: DataFrame, block: pa.Table, k: int, allowed: str | None, digits: int, column: str, load: Load, compare: Compare) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(block.combine_chunks())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if not table.num_rows:
            return
        queries = load(table.column(column).combine_chunks())
        wanted = table.column("tag").to_numpy(zero_copy_only=False) if allowed is not None else None
        ids, best = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), -np.inf)
        for batch in batches:
            for first in range(0, batch.num_rows, TILE_ROWS):
                tile = batch.slice(first, TILE_ROWS)
                rows, names = load(tile.column(column)), tile.column("chunk_id").to_numpy()
                tags = tile.column("tag").to_numpy(zero_copy_only=False) if wanted is not None else None
                for start in range(0, len(queries), TILE_QUERIES):
                    here = slice(start, start + TILE_QUERIES)
                    near = np.round(compare(queries[here], rows), digits)
                    if wanted is not None:
                        near[~((tags[None, :] == wanted[here, None]) | (tags == allowed)[None, :])] = -np.inf
                    new_ids, new = best_of(near, names, k, digits)
                    all_ids, every = np.concatenate([ids[here], new_ids], 1), np.concatenate([best[here], new], 1)
                    order = np.lexsort((all_ids, -every), axis=1)[:, :k]
                    ids[here], best[here] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(every, order, 1)
        found = np.isfinite(best)
        names = np.broadcast_to(table.column("query_id").to_numpy()[:, None], best.shape)
        yield pa.RecordBatch.from_arrays([pa.array(names[found]), pa.array(ids[found]), pa.array(best[found])], ["query_id", "chunk_id", "similarity"])

    columns = ["chunk_id", column, *(["tag"] if allowed is not None else [])]
    return corpus.select(*columns).mapInArrow(search, "query_id long, chunk_id long, similarity double")


def coded(rows: DataFrame, id_column: str, bits: int = CODE_BITS) -> DataFrame:
    """id_column, code: on which side of `bits` random planes each row's embedding lies. The index of an
    approximate search: bits / 8 bytes a row, made in one pass without fitting anything."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            for first in range(0, batch.num_rows, TILE_ROWS):
                tile = batch.slice(first, TILE_ROWS)
                unit = matrix(tile.column("embedding"))
                if planes is None:
                    planes = np.random.RandomState(bits).normal(size=(unit.shape[1], bits))
                signs = np.packbits(unit @ planes > 0, axis=1)
                yield pa.RecordBatch.from_arrays([tile.column(id_column), pa.array([s.tobytes() for s in signs], pa.binary())], [id_column, "code"])

    return rows.select(F.col(id_column).cast("long"), "embedding").mapInArrow(code, f"{id_column} long, code binary")


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus the number of different bits of each pair."""
    return -sum(np.bitwise_count(a[:, None, i] ^ b[None, :, i]).astype(np.float32) for i in range(a.shape[1])).astype(np.float64)
