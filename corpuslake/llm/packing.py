"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

A document is its token ids and one end id. Only documents longer than the capacity are cut, into
full pieces and a last shorter one. Pieces are packed by length: the plan is made from the number
of pieces of each length (at most `capacity` numbers, however large the corpus). For each bin it
takes the longest piece that is left, fills greedily with the longest that fit, then replaces the
bin's smallest piece by the two unpacked ones that fill its expanded gap more tightly, until none
do. A bin's make-up is repeated for as long as the counts let that same make-up come out again, so
the plan is that of packing bin by bin. Pieces of one length are interchangeable: they are numbered
across the cluster and looked up in the plan.

Cases: a null or empty text is the end id alone; repeated rows are packed each; long texts are
encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.runtime import numbered, returning

CAPACITY = 4096
END_ID = 1
#: Words whose ids a task remembers in each of two generations (some 70 MB in each).
MEMORY = 300_000
#: Longer words (in bytes) are encoded each time, so that what is remembered stays small.
LONG_WORD = 64


#: Signs that may end a word: one run of them is one unit of the vocabulary's word pattern.
TAIL = ".,;:!?#$%&*|)"
#: How byte-level vocabularies write bytes that are not printable Latin-1 characters.
_UNPRINTABLE = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_SIGNS = {b: chr(256 + i) for i, b in enumerate(_UNPRINTABLE)}


class WordIds(dict):
    """Token ids of a text, as little-endian unsigned 32-bit bytes.

    The vocabulary's rules drop white space and never join across it, so a text is encoded word
    by word (ASCII white space only) and each distinct word of up to LONG_WORD bytes once. Latin letters with or without
    trailing signs need no further rules than lower case; other words take the whole encoder.
    """

    def __init__(self, path: str, remember: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.units = self.tokenizer.model.tokenize
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = np.array(self.encoded(word.decode()), "<u4").tobytes()
        if len(word) > LONG_WORD:
            return got
        if len(self) >= self.remember:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got

    def encoded(self, word: str) -> list[int]:
        letters = word.rstrip(TAIL)
        if not letters.isalpha() or max(letters) > "\xff":
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        signs = letters.lower().encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = [t.id for t in self.units(signs)]
        if len(letters) < len(word):
            ids += [t.id for t in self.units(word[len(letters) :])]
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece; ids do not leave the task."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        try:
            yield from encoded(encoder, batches)
        finally:
            encoder.forget()  # a worker goes on to other tasks

    def encoded(encoder: WordIds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, pc.fill_null(batch.column("text"), "").cast(pa.large_binary()), strict=True):
                body = encoder.of(text.as_py()) + end
                for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                    part = body[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(returning(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Left:
    """Counts of unpacked pieces by length, with the next shorter length that has any."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64)

    def longest(self, limit: int) -> int:
        """The longest length up to the limit of which a piece is left, or 0."""
        found = np.flatnonzero(self.counts[1 : limit + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def best_two(self, limit: int) -> tuple[int, int]:
        """Two lengths, both left, whose sum is the largest up to the limit; (0, 0) if none."""
        lengths = np.flatnonzero(self.counts[: limit + 1])
        if not len(lengths):
            return 0, 0
        partner = np.searchsorted(lengths, limit - lengths, "right") - 1
        fits = partner >= 0
        first, second = lengths[fits], lengths[partner[fits]]
        clash = (first == second) & (self.counts[first] < 2)
        lower = partner[fits][clash] - 1
        second[clash] = np.where(lower >= 0, lengths[np.maximum(lower, 0)], 0)
        total = np.where(second > 0, first + second, 0)
        if not len(total) or total.max() == 0:
            return 0, 0
        best = int(np.argmax(total))
        return int(first[best]), int(second[best])


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as ({length: pieces}, times). counts[l]: pieces of length l, for l from 0 to capacity."""
    left, bins = _Left(counts), []
    while longest := left.longest(capacity):
        had = left.counts.copy()
        most = np.zeros_like(had)  # pieces of each length that were out of the pool at once
        inside: list[int] = []
        gap, length = capacity, longest
        while length:
            fit = min(int(left.counts[length]), gap // length)
            inside += [length] * fit
            left.counts[length] -= fit
            gap -= fit * length
            length = left.longest(gap) if gap else 0
        np.maximum(most, had - left.counts, out=most)
        while gap and len(inside) > 1:
            smallest = inside[-1]
            a, b = left.best_two(gap + smallest)
            if a + b <= smallest:
                break
            left.counts[[smallest]] += 1
            left.counts[a] -= 1
            left.counts[b] -= 1
            inside = sorted([*inside[:-1], a, b], reverse=True)
            gap += smallest - a - b
            np.maximum(most, had - left.counts, out=most)
        taken = had - left.counts
        # The same choices come out again while every length still has what they took at once.
        used = np.flatnonzero(most)
        spare = had[used] - most[used]
        steps = taken[used]
        times = 1 + int(min((s // t for s, t in zip(spare, steps, strict=True) if t), default=0))
        left.counts = had - times * taken
        bins.append(({int(n): int(taken[n]) for n in np.flatnonzero(taken)[::-1]}, times))
    return bins


def seats(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """(length, first number, pieces a bin, first bin, offset) of every length in every bin's make-up."""
    rows, used, first_bin = [], {}, 0
    for inside, times in bins:
        offset = 0
        for length, n in inside.items():
            rows.append((length, used.get(length, 0), n, first_bin, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Texts are encoded once. Pieces are numbered within their length by `numbered`, which spreads
    a length that many pieces share. The plan is a bounded table (lengths and make-ups, not rows)."""
    numbers = numbered(pieces(docs, tokenizer, capacity, end_id), ["length"], ["doc_id", "piece", "ids_crc32"], "__number")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in numbers.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    table = seats(plan(histogram, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] << np.int64(48) | rows[:, 1] if len(rows) else np.zeros(0, np.int64)
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "__number"))
            row = rows[np.searchsorted(keys, length << np.int64(48) | number, "right") - 1]
            since = number - row[:, 1]
            sequence, place = row[:, 3] + since // np.maximum(row[:, 2], 1), row[:, 4] + since % np.maximum(row[:, 2], 1) * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(place)], [*names, "sequence_id", "offset"])

    return numbers.mapInArrow(returning(seat), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))

