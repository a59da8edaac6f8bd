"""Token counts by section, from one encoding of each whole document.

A document is encoded once with a byte-level vocabulary, so the tokens' byte lengths add up to the
text and give every token's span. Spans are joined with the section intervals, and each token goes
to exactly one section. The rule for a token that crosses boundaries: the section that holds most
of its bytes gets it; of equal ones, the first. Counts over sections therefore add up to the
document's count.

Sections are given by rows of (doc_id, section, start, end) in code points, or are the lines of the
text (each with its \\n). Bytes that no section holds are section -1; where sections overlap, the
one that starts first holds the bytes.

Cases: a null or empty text has no tokens and, by lines, no section; repeated documents are counted
each; sections of unknown documents, null or empty ones, and parts past the end count for nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.textbatch import slices

OUTSIDE = -1
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


@lru_cache(1)
def encoding(path: str, pattern: str):
    """The vocabulary at `path`, and the byte length of each id."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_edges(text: str, path: str, pattern: str) -> np.ndarray:
    """Byte offsets at which tokens begin, and the end of the text last."""
    coder, sizes = encoding(path, pattern)
    return np.concatenate([[0], np.cumsum(sizes[np.array(coder.encode_ordinary(text), np.int64)])]).astype(np.int64)


def attribute(edges: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section. starts, ends: bytes, ascending, gapless, covering the text."""
    first = np.searchsorted(ends, edges[:-1], "right")
    last = np.searchsorted(starts, edges[1:], "left") - 1
    tokens = np.bincount(first[first == last], minlength=len(starts))
    crossing = np.zeros(len(starts), np.int64)
    for t in np.flatnonzero(first != last):
        inside = np.arange(first[t], last[t] + 1)
        held = np.minimum(ends[inside], edges[t + 1]) - np.maximum(starts[inside], edges[t])
        winner = inside[np.argmax(held)]
        tokens[winner] += 1
        crossing[winner] += 1
    return tokens, crossing


def line_bounds(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of the lines, and their bounds in code points: (edges in bytes, edges in points, sections)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(raw == 10) + 1
    edges = np.unique(np.concatenate([[0], cut, [len(raw)]]))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return edges, points[edges], np.arange(len(edges) - 1)


def given_bounds(text: str, sections: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for given sections: overlaps go to the section that starts first, gaps to OUTSIDE."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    size, at, points, owner = len(begins) - 1, 0, [0], []
    wanted = [s for s in sections or () if None not in (s["section"], s["start"], s["end"])]
    for s in sorted(wanted, key=lambda s: (s["start"], s["end"], s["section"])):
        start, end = max(s["start"], at), min(s["end"], size)
        if end <= start:
            continue
        if start > at:
            points.append(start)
            owner.append(OUTSIDE)
        points.append(end)
        owner.append(s["section"])
        at = end
    if at < size:
        points.append(size)
        owner.append(OUTSIDE)
    points = np.array(points, np.int64)
    return begins[points], points, np.array(owner, np.int64)


def counted(docs: DataFrame, path: str, pattern: str, sections: DataFrame | None = None) -> DataFrame:
    """doc_id, section, start, end (code points), n_tokens, n_crossing: one row per section of each document.

    By lines nothing is shuffled. With `sections`, intervals are gathered by doc_id and joined to it."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    by_lines = sections is None
    if sections is not None:
        spans = sections.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.struct(F.col("section").cast("int").alias("section"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("s"))
        rows = rows.join(spans.groupBy("doc_id").agg(F.collect_list("s").alias("sections")), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(first, len(part)).to_pylist()
                given = batch.column("sections").slice(first, len(part)).to_pylist() if not by_lines else None
                columns: list[list] = [[] for _ in range(6)]
                for i, (doc_id, text) in enumerate(zip(ids, part.to_pylist(), strict=True)):
                    edges, points, names = line_bounds(text) if given is None else given_bounds(text, given[i])
                    if not len(names):
                        continue
                    tokens, crossing = attribute(token_edges(text, path, pattern), edges[:-1], edges[1:])
                    for column, values in zip(columns, (np.full(len(names), -1 if doc_id is None else doc_id), names, points[:-1], points[1:], tokens, crossing), strict=True):
                        column.append(values)
                    if doc_id is None:
                        columns[0][-1] = np.ma.masked_all(len(names), np.int64)
                if columns[0]:
                    joined = [np.ma.concatenate(columns[0]), *(np.concatenate(c) for c in columns[1:])]
                    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                    arrays = [pa.array(np.ma.getdata(c), k, mask=np.ma.getmaskarray(c)) for c, k in zip(joined, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return rows.mapInArrow(count, SCHEMA)


def default_vocabulary() -> tuple[str, str]:
    """Where the public byte-level vocabulary lies on this machine, and its pattern."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
