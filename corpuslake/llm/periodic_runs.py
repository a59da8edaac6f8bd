"""Periodic run detection by maximal pairs of the LCP-interval tree.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, TIMES * q) words long, that no
neighbouring word extends keeping the period. If words i and i + q start the same l words, differ in the word to
their left and in the word after these l, they are a maximal pair, and l + q words from i on have period q and can not
be extended: the pairs whose distance q is at most l / (TIMES - 1), with l + q >= LEAST, are the runs, and the pair of
least distance over a stretch gives its period. Pairs come from the tree of LCP intervals, built bottom-up over the
sorted suffixes: each interval holds its places in lists by their left word, and where a child's lists enter their
parent's, lists of different left words meet. A place looks for its nearest partners only: between a run's first
place and the next one there is no other occurrence of their common words.

Only words that can lie in a run are sorted. All words of a run begin an n-gram (n as `filter_gram` gives it) that
comes again within q words, and so do their neighbours for as long as the run lasts; n-grams are met by quick hashes
here, which can only let too many through. What is left is numbered exactly and cut where the stretches end.

Cases: a null or empty text has no words and no run; ids may be null or repeated, rows are taken one by one; other
columns are not read; an empty table gives an empty result. A text is held whole in one task: memory is some
40 bytes a byte of the longest text, and time n log n in its words.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.textbatch import Texts, numbered_spans, slices

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Rounds in which stretches that became too short go.
ROUNDS = 12
#: Text whose words a task holds at once (one text at least).
SLICE = 1 << 19
RUN = "array<struct<start: long, length: long, period: long>>"

#: Places by their left word, and how many they are.
Lists = tuple[dict[int, list[int]], int]


def filter_gram(least: int, times: int) -> int:
    """Words of the n-grams that every word of a run (but its last n - 1) begins and meets again within a period."""
    return 1 + min(max(least - 2 * q, (times - 2) * q) for q in range(1, least + 2))


def pair_words(least: int, times: int) -> int:
    """The least number of words that the places of a run's pair have in common."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 2))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence whose last word occurs once, in order: prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(text)
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        found = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(found[1:] != found[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


def common_words(text: list[int], order: list[int]) -> list[int]:
    """Words that each suffix shares with the one before it in order; time is linear."""
    n = len(text)
    before = [-1] * n
    for i in range(1, n):
        before[order[i]] = order[i - 1]
    shared, size = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            size = 0
            continue
        while i + size < n and j + size < n and text[i + size] == text[j + size]:
            size += 1
        shared[i] = size
        size -= size > 0
    return [shared[i] for i in order]


def joined(most: Lists, few: Lists, shared: int, left: list[int], least: int, times: int, runs: dict[tuple[int, int], int]) -> Lists:
    """Lists of two children of an interval as one. Pairs of places from both that differ in their left word and lie
    no further apart than a run allows are noted: runs[start, length] is the least distance."""
    if few[1] > most[1]:
        most, few = few, most
    (held, size), (added, more) = most, few
    reach = shared // (times - 1)

    def note(a: int, b: int) -> None:
        apart = abs(a - b)
        if apart <= reach and shared + apart >= least:
            key = (min(a, b), shared + apart)
            runs[key] = min(runs.get(key, apart), apart)

    for word, places in added.items():
        for p in places:
            if len(held) <= 2 * reach:
                for other, theirs in held.items():
                    if other != word:
                        i = bisect_left(theirs, p)
                        if i < len(theirs):
                            note(p, theirs[i])
                        if i:
                            note(p, theirs[i - 1])
            else:  # many lists, few places within reach
                for x in range(max(0, p - reach), min(len(left), p + reach + 1)):
                    theirs = held.get(left[x], ()) if left[x] != word else ()
                    i = bisect_left(theirs, x)
                    if i < len(theirs) and theirs[i] == x:
                        note(p, x)
    for word, places in added.items():
        theirs = held.setdefault(word, places)
        if theirs is not places:
            if 8 * len(places) > len(theirs):
                theirs += places
                theirs.sort()
            else:
                for p in places:
                    insort(theirs, p)
    return held, size + more


def runs_of(text: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, in order. Numbers below 0 occur once each and
    lie in no run; the last one is such."""
    order = suffix_order(text)
    words, places = text.tolist(), order.tolist()
    shared = common_words(words, places)
    left = [-len(words) - 1, *words[:-1]]
    enough = pair_words(least, times)
    runs: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, Lists]] = []
    for i, p in enumerate(places):
        child: Lists = ({left[p]: [p]}, 1)
        h = shared[i + 1] if i + 1 < len(places) else 0
        while stack and stack[-1][0] > h:
            inner, lists = stack.pop()
            child = joined(lists, child, inner, left, least, times, runs)
        if h < enough:
            continue
        if stack and stack[-1][0] == h:
            stack[-1] = (h, joined(stack[-1][1], child, h, left, least, times, runs))
        else:
            stack.append((h, child))
    return sorted((start, length, period) for (start, length), period in runs.items())


def hopeful(texts: Texts, least: int, times: int) -> np.ndarray:
    """First words of the n-grams that can lie in a run, in order."""
    n = filter_gram(least, times)
    hashes, place = texts.grams(texts.words(), n)
    if not len(place):
        return place
    order = np.argsort(hashes, kind="stable")
    same = (hashes[order][1:] == hashes[order][:-1]) & (texts.owner[place[order]][1:] == texts.owner[place[order]][:-1])
    gap = np.where(same, np.diff(place[order]), len(texts.owner))
    nearest = np.full(len(place), len(texts.owner))
    nearest[order[:-1]] = gap
    nearest[order[1:]] = np.minimum(nearest[order[1:]], gap)
    keep = nearest < len(texts.owner)
    place, nearest = place[keep], nearest[keep]
    for _ in range(ROUNDS):
        breaks = np.flatnonzero((np.diff(place) != 1) | (np.diff(texts.owner[place]) != 0)) + 1
        sizes = np.diff(np.concatenate([[0], breaks, [len(place)]]))
        keep = times * nearest <= np.repeat(sizes, sizes) + n - 1
        if keep.all() or not keep.any():
            break
        place, nearest = place[keep], nearest[keep]
    return place[keep]


def runs_in(texts: Texts, least: int, times: int) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each text that has any, with word numbers within the text."""
    place = hopeful(texts, least, times)
    if not len(place):
        return {}
    n = filter_gram(least, times)
    first = np.ones(len(place), bool)
    first[1:] = (np.diff(place) != 1) | (np.diff(texts.owner[place]) != 0)
    starts = place[first]
    sizes = np.diff(np.concatenate([np.flatnonzero(first), [len(place)]])) + n - 1
    spots = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    distinct, back = np.unique(spots, return_inverse=True)
    numbers = numbered_spans(texts.data, texts.starts[distinct], texts.ends[distinct])[0][back]
    # One sequence, with a number of its own after each stretch.
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.empty(sizes.sum() + len(sizes), np.int64)
    text[np.arange(len(numbers)) + np.repeat(np.arange(len(sizes)), sizes)] = numbers
    text[begins + sizes] = -1 - np.arange(len(sizes))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in runs_of(text, least, times):
        stretch = int(np.searchsorted(begins, start, "right")) - 1
        word = int(starts[stretch] + start - begins[stretch])
        owner = int(texts.owner[word])
        out.setdefault(owner, []).append((word - int(texts.first[owner]), length, period))
    return {k: sorted(v, key=lambda r: (r[0], r[2])) for k, v in out.items()}


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def detected(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; words numbered from 0) and collapsed (the text without what runs
    repeat) of every document. times is 3 or more."""
    if times < 3:
        raise ValueError("a run repeats its period three times or more")
    names = ["doc_id", "n_words", "runs", "collapsed"]
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text"), SLICE):
                texts = Texts(part)
                found = runs_in(texts, least, times)
                bare = [collapsed(texts.data[a:b].tobytes().split(), found.get(i, [])).decode() for i, (a, b) in enumerate(zip(texts.at[:-1], texts.at[1:], strict=True))]
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(i, ())] for i in range(texts.n)]
                columns = [batch.column("doc_id").slice(first, len(part)), pa.array(texts.counts, pa.int64()), pa.array(runs, kind), pa.array(bare, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(detect, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """The documents with periodic tails planted: with h = crc32 of the decimal doc_id and g = floor(h / 10), where h
    is a multiple of 10, each word i >= a becomes word a + (i - a) % p, for a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    Documents without an id or a word stay as they are."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    marked = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    here = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    split = F.when(here, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    sized = marked.withColumn("w", split).withColumn("n", F.size("w"))
    a = (F.col("g") % F.col("n")).cast("int")
    p = (F.lit(1) + F.floor((F.col("n") - a) / (F.lit(3) + F.col("g") % 8))).cast("int")
    times = F.ceil((F.col("n") - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), F.lit(1), F.col("n") - a)
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    return sized.select("doc_id", text.alias("text"))


def digested(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (first of equal ones) and digests of runs and collapsed text."""
    best = F.aggregate(
        "runs",
        F.get("runs", F.lit(0)),
        lambda held, run: F.when(run["length"] * held["period"] > held["length"] * run["period"], run).otherwise(held),
    )
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    part: list[Column] = [F.col("best")[k].alias(k) for k in ("start", "length", "period")]
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", *part, milli, "runs_sha256", "collapsed_sha256")
