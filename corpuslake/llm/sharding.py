"""Sharding by jump consistent hashing: no ring table, and a new last shard takes rows only into itself.

Cases: a null key hashes as 0; a null text has size 1 (no bytes, plus 1) and the checksum of no
bytes; repeated rows go to one shard and get slots of their own; an empty table stays empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.runtime import numbered
from corpuslake.llm.textbatch import mix

SHARDS = 16
U = np.uint64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, 0 to shards - 1. Expected steps grow with log(shards)."""
    state = mix(keys.astype(U))
    shard = np.full(len(state), -1, np.int64)
    candidate = np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    while len(active):
        shard[active] = candidate[active]
        state[active] = state[active] * U(2862933555777941757) + U(1)
        ratio = float(1 << 31) / ((state[active] >> U(33)) + U(1)).astype(np.float64)
        candidate[active] = ((shard[active] + 1) * ratio).astype(np.int64)
        active = active[candidate[active] < shards]
    return shard


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Texts are read once and not shuffled;
    only ids, sizes and checksums are, to number the slots (by doc_id, size and checksum)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
            keys = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            checks = np.fromiter((zlib.crc32(t.as_buffer()) for t in texts), np.int64, len(texts))
            columns = [ids, sizes, checks, jump(keys, shards), jump(keys, shards + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["doc_id", "size", "text_crc32", "shard", "grown_shard"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(place, "doc_id long, size long, text_crc32 long, shard long, grown_shard long")
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("grown_shard").cast("int"))
    rows = numbered(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
