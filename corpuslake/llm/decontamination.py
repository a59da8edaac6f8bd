"""Benchmark decontamination by pigeonhole edit matching.

Documents and test items are normalised alike: lower case, white space squeezed to single spaces.
An item of m characters may occur in a document with up to k = floor(m * RATE) edits. It is cut
into k + 1 pieces: whatever the edits, one piece occurs unchanged. Exact piece hits come from one
Aho-Corasick pass over each whole document; around each hit, Myers' bit-parallel algorithm gives
the least edit distance of the item to any passage there, and only distances up to k are reported.

Items are a query set: they are broadcast in blocks of at most BLOCK_CHARS characters, and
each block is run against all documents. Documents are not shuffled.

Cases: null and blank texts and items match nothing; items of under LEAST_CHARS characters may only
occur exactly and as whole words; repeated items are matched once and reported under each item_id,
repeated documents are reported each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.runtime import returning
from corpuslake.llm.textbatch import slices

RATE = 0.08
LEAST_CHARS = 40
BLOCK_CHARS = 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate) if len(item) >= LEAST_CHARS else 0


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of near equal length, as (place, piece)."""
    edges = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


class Item:
    def __init__(self, text: str, rate: float):
        self.text, self.errors, self.whole_words = text, budget(text, rate), len(text) < LEAST_CHARS
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i


def best_match(item: Item, passage: str) -> tuple[int, int]:
    """Least edit distance of the item to any substring of the passage, and where that ends (exclusive).

    Myers (1999): one bit for each character of the item, one step for each of the passage."""
    m = len(item.text)
    full, top, masks = (1 << m) - 1, 1 << (m - 1), item.masks
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(passage, 1):
        eq = masks.get(c, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, low = minus | (full & ~(across | plus)), plus & across
        if up & top:
            score += 1
        elif low & top:
            score -= 1
        up, low = (up << 1) & full, (low << 1) & full
        plus, minus = low | (full & ~(down | up)), up & down
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    def __init__(self, texts: list[str], rate: float):
        import ahocorasick

        self.items = [Item(t, rate) for t in texts]
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, item in enumerate(self.items):
            for place, piece in pieces_of(item.text, item.errors):
                owners[piece].append((n, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start of the window, end of the match) of the best match of each item found."""
        spots: dict[int, set[int]] = defaultdict(set)
        for last, (size, where) in self.automaton.iter(text):
            for n, place in where:
                spots[n].add(last + 1 - size - place)
        out = []
        for n, starts in spots.items():
            item = self.items[n]
            m, k = len(item.text), item.errors
            exact = [s for s in sorted(starts) if s >= 0 and text.startswith(item.text, s)]
            if item.whole_words:
                exact = [s for s in exact if not (text[s - 1 : s] if s else "").isalnum() and not text[s + m : s + m + 1].isalnum()]
            if exact:
                out.append((n, 0, exact[0], exact[0] + m))
                continue
            if not k:
                continue
            best = None
            for a, b in merged([(max(0, s - k), min(len(text), s + m + k)) for s in sorted(starts)]):
                distance, end = best_match(item, text[a:b])
                if distance <= k and (best is None or distance < best[1]):
                    best = (n, distance, a, a + end)
            if best:
                out.append(best)
        return out


@lru_cache(1)
def matcher_of(texts: tuple[str, ...], rate: float) -> Matcher:
    """A block's matcher: a Python worker keeps it from task to task."""
    return Matcher(list(texts), rate)


def merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows in order of start, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in windows:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(items: DataFrame, block_chars: int) -> Iterator[list[tuple[list[int], str]]]:
    """Items with equal text together, in blocks whose texts are bounded; one block is held at a time."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rows = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).filter(F.length(text) > 0)
    sized = rows.select("item_id", "text", F.length("text").alias("size"), F.pmod(F.xxhash64("text"), F.lit(1 << 20)).alias("slot"))
    by_slot = sized.groupBy("slot").agg(F.sum("size").alias("size"))
    total = by_slot.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total // block_chars))
    for n in range(count):
        here = sized.filter(F.col("slot") % count == n) if count > 1 else sized
        texts: dict[str, list[int]] = defaultdict(list)
        for row in here.select("item_id", "text").toLocalIterator():
            if clean := normal(row["text"]):
                texts[clean].append(row["item_id"])
        yield [(sorted(set(ids)), t) for t, ids in texts.items()]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget: a row for each document and item that occurs in it."""
    schema = "doc_id long, item_id long, distance long, budget long"
    parts = []
    for block in blocks_of(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(tuple(t for _, t in shared.value), rate) if shared.value else None
            for batch in batches:
                rows = []
                for first, part in slices(batch.column("text")):
                    ids = batch.column("doc_id").slice(first, len(part)).to_pylist()
                    for doc_id, text in zip(ids, part, strict=True):
                        for n, distance, _, _ in matcher.found(normal(text.as_py())) if matcher else ():
                            rows += [(doc_id, item_id, distance, matcher.items[n].errors) for item_id in shared.value[n][0]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "distance", "budget"])

        parts.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(returning(match), schema))
    return reduce(DataFrame.unionAll, parts)


def cleaned(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item occurs; every column stays, and texts are not shuffled."""
    out = docs
    for block in blocks_of(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(tuple(t for _, t in shared.value), rate) if shared.value else None
            for batch in batches:
                clean = [not matcher or not matcher.found(normal(t.as_py())) for t in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(returning(keep), docs.schema)
    return out
