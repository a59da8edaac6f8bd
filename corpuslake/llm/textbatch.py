"""Vectorised words, lines and n-gram hashes over Arrow string columns.

A word is a run of characters other than space and the controls 0x09-0x0D. There are three ways to
name words, lines and n-grams: exact numbers within a slice (for measures inside a text), keyed
digests (for comparing texts across the corpus; no one without the key can write a collision down),
and quick polynomial hashes for feature cells, which share cells anyway. Everything works on whole
texts; a slice holds whole documents and about SLICE_BYTES of text (one document at least).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
GRAM_STEP = U(0xD6E8FEB86659FD93)
PRIME = U((1 << 61) - 1)
#: Longer words (in bytes) are digested one by one.
LONG_WORD = 256

_byte_values = np.random.RandomState(20240229).randint(1, 1 << 62, 256, dtype=np.int64).astype(U)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(4)
def _halves_of_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base, base^2, ... modulo the prime, as their low 31 bits and what is above."""
    powers, power = [], 1
    for _ in range(LONG_WORD):
        power = power * base % int(PRIME)
        powers.append(power)
    return np.array([p & 0x7FFFFFFF for p in powers], U), np.array([p >> 31 for p in powers], U)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2^31 modulo 2^61 - 1, for x below it: the bits turn round."""
    return ((x << U(31)) & PRIME) + (x >> U(30))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, _BASE if kind == "up" else _BASE_INVERSE, U)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=U)
    return _powers[kind][:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Row ranges of about `limit` bytes, as (first row, array without nulls)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and total + n > limit:
            yield first, column.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if len(column) > first:
        yield first, column.slice(first)


class Texts:
    """Words of some whole texts. `data` holds their bytes, `at` where each begins (and the end)."""

    def __init__(self, column: pa.Array, lower_ascii: bool = False):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0]
        self.data = _LOWER[data] if lower_ascii else data
        self.n = len(column)
        size = len(data)
        self.space = IS_SPACE[self.data]
        before, after = np.ones(size, bool), np.ones(size, bool)
        before[1:], after[:-1] = self.space[:-1], self.space[1:]
        before[self.at[:-1][self.at[:-1] < size]] = True
        after[self.at[1:][self.at[1:] > 0] - 1] = True
        self.starts = np.flatnonzero(~self.space & before)
        self.ends = np.flatnonzero(~self.space & after) + 1
        #: the first word of each text, and the number of words last
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(self.n), self.counts)
        self._prefix: np.ndarray | None = None

    def words(self) -> np.ndarray:
        """Quick hashes of the words, for feature cells only: two words may be made to share one."""
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, U)
            np.cumsum(_byte_values[self.data] * _power("up", len(self.data)), dtype=U, out=self._prefix[1:])
        down = _power("down", len(self.data) + 1)
        return mix((self._prefix[self.ends] - self._prefix[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))

    def numbers(self) -> tuple[np.ndarray, pa.Array]:
        """The words by number, and the distinct strings that the numbers stand for: equal words, equal numbers."""
        return numbered_spans(self.data, self.starts, self.ends)

    def digests(self, key: int) -> np.ndarray:
        """64-bit digests of the words: their bytes as digits of a polynomial in a secret base (the key), modulo the
        prime 2^61 - 1. Two different words of up to LONG_WORD bytes share one for at most LONG_WORD of 2^61 keys."""
        if not len(self.starts):
            return np.zeros(0, U)
        low, high = _halves_of_powers(key)
        sizes = self.ends - self.starts
        begins = np.cumsum(sizes) - sizes
        place = np.arange(begins[-1] + sizes[-1], dtype=np.int32) - np.repeat(begins.astype(np.int32), sizes)
        if sizes.max() > LONG_WORD:
            place = np.minimum(place, LONG_WORD - 1, out=place)
        digits = self.data[~self.space].astype(U) + U(1)
        # Digits of 9 bits times halves of 31: a word's sums stay far below 2^64.
        total = np.add.reduceat(digits * low[place], begins)
        total += _shifted(np.add.reduceat(digits * high[place], begins) % PRIME)
        out = mix(total % PRIME)
        for i in np.flatnonzero(sizes > LONG_WORD):
            whole = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = np.frombuffer(blake2b(whole, digest_size=8, key=key.to_bytes(16)).digest(), U)[0]
        return out

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact numbers of n words in a row, none across texts; and the first word of each."""
        numbers, _ = self.numbers()
        if len(numbers) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(numbers.astype(np.int32), n))
        place = np.flatnonzero(self.owner[: len(rows)] == self.owner[n - 1 :])
        rows = np.ascontiguousarray(rows[place])
        keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), len(rows), [None, pa.py_buffer(rows)])
        return keys.dictionary_encode().indices.to_numpy().astype(np.int64), place

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in a row, none across texts; and the first word of each."""
        size = len(hashes) - n + 1
        if size <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        total = np.zeros(size, U)
        for j in range(n):
            total = mix(total * GRAM_STEP + hashes[j : j + size])
        place = np.flatnonzero(self.owner[:size] == self.owner[n - 1 :])
        return total[place], place

    def per_text(self, counts: np.ndarray) -> np.ndarray:
        """Sums of whole numbers per byte over each text."""
        total = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Exact number and text of every \\n-separated line that has a word."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        breaks = np.flatnonzero(self.data == 10)
        line = np.searchsorted(breaks, self.starts)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (self.owner[1:] != self.owner[:-1])
        line, owner = line[new], self.owner[new]
        edges = np.concatenate([[-1], breaks, [len(self.data)]])
        starts = np.maximum(edges[line] + 1, self.at[owner])
        ends = np.minimum(edges[line + 1], self.at[owner + 1])
        return numbered_spans(self.data, starts, ends)[0], owner


def numbered_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the strings at ascending, disjoint byte ranges, and the strings by number."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    found = pieces.dictionary_encode()  # of the ranges and of what lies between them
    return found.indices.to_numpy()[0::2].astype(np.int64), found.dictionary


def seen_before(numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the entries equal to an earlier one, and to any other one, of the same text."""
    keys = owner * (numbers.max(initial=0) + 1) + numbers
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    earlier, any_other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:][same]] = True
    any_other[order[1:][same]] = True
    any_other[order[:-1][same]] = True
    return earlier, any_other


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `counts` values; each run is summed by itself."""
    out = np.zeros(len(counts), np.float64)
    full = counts > 0
    if full.any():
        begins = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, begins)
    return out
