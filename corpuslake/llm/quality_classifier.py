"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal updates.

Features of a whole text: word unigrams and bigrams, the same over word shapes (runs of character
classes), and a mark for a word that follows itself, all hashed into `cells`; a feature's value is
its share of the text's n-grams. A score is one sparse dot product and a logistic.

Fitting uses a bounded sample: about SAMPLE_ROWS labelled rows with about SAMPLE_CELLS features between
them, taken by a hash of doc_id when there are more. Their features are made in parallel; one task
holds them (8 bytes each) and passes over them PASSES times, in another order each time. Scoring
covers every document.

Cases: a null or empty text has no features and scores the bias; labels that are null, or have no
document, are not learned from; without any labels every score is 0.5; repeated rows are scored
each; an empty table gives an empty result. The id decides only which rows are held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.runtime import settled
from corpuslake.llm.textbatch import Texts, mix, segment_sums, slices

CELLS = 1 << 18
#: Bounds of the sample: rows, and distinct features of a row summed over rows.
SAMPLE_ROWS, SAMPLE_CELLS = 10_000, 20_000_000
PASSES = 20
ALPHA, BETA, L1, L2 = 0.5, 1e-3, 1e-5, 1e-4
CUT = 0.3
U = np.uint64

_CLASS = np.arange(256, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
_STEP_VALUES = np.random.RandomState(7).randint(1, 1 << 62, (256, 256), dtype=np.int64).astype(U)


def shapes(texts: Texts) -> np.ndarray:
    """Hash of each word's runs of character classes."""
    kind = np.where(texts.space, 0, _CLASS[texts.data])
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    before[texts.starts] = 0
    step = np.where(kind != before, _STEP_VALUES[before, kind], U(0))
    total = np.zeros(len(step) + 1, U)
    np.cumsum(step, dtype=U, out=total[1:])
    return mix(total[texts.ends] - total[texts.starts])


def features(texts: Texts, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all n-grams, text by text, and how many each text has."""
    words, kinds = texts.words(), shapes(texts)
    pairs, place = texts.grams(words, 2)
    kind_pairs, _ = texts.grams(kinds, 2)
    follows = np.where(words[place] == words[place + 1], U(1), U(2)) if len(place) else np.zeros(0, U)
    parts = [words, pairs, kinds + U(11), mix(kind_pairs + U(12)), mix(follows)]
    owners = [texts.owner, texts.owner[place], texts.owner, texts.owner[place], texts.owner[place]]
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    hashed = (np.concatenate(parts) & U(cells - 1)).astype(np.int64)
    return hashed[order], np.bincount(owner, minlength=texts.n)


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; cell `cells` is the bias."""

    def __init__(self, cells: int):
        self.z, self.n = np.zeros(cells + 1), np.zeros(cells + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / rate)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35))) - label
        g = error * values
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def is_held_out(doc_id: Column | str, folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, mod folds, is `fold`; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def some(rows: DataFrame, limit: int, size: Column | None = None, turn: int = 0) -> DataFrame:
    """Rows with a small hash of doc_id: all of them up to `limit` in size, else about as many as that."""
    total = rows.agg(F.sum(F.lit(1) if size is None else size)).first()[0] or 0
    if total <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(1 << 32)) < int((1 << 32) * limit / total))


def examples(rows: DataFrame, cells: int) -> DataFrame:
    """doc_id, label, found (distinct cells) and share (their parts of the text's n-grams) of (doc_id, text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text")):
                hashed, n = features(Texts(part), cells)
                ends = np.cumsum(n)
                found, share = [], []
                for end, k in zip(ends, n, strict=True):
                    at, times = np.unique(hashed[end - k : end], return_counts=True)
                    found.append(at.astype(np.int32))
                    share.append((times / max(k, 1)).astype(np.float32))
                columns = [*batch.select(["doc_id", "label"]).slice(first, len(part)).columns, pa.array(found, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "found", "share"])

    return rows.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int")).mapInArrow(count, "doc_id long, label int, found array<int>, share array<float>")


def fitted(docs: DataFrame, labels: DataFrame, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, sample_cells: int = SAMPLE_CELLS, passes: int = PASSES) -> np.ndarray:
    """Weights (cells + 1, the bias last) learned from (doc_id, label) rows; see the module for the bounds."""
    labels = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "label")
    chosen = some(labels, sample_rows).withColumnRenamed("doc_id", "__id")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    known = settled(examples(sample.select("doc_id", "text", "label"), cells))
    known = some(known, sample_cells, F.size("found"), 1)
    ordered = known.withColumn("turn", F.xxhash64("doc_id", F.lit(2))).repartition(1).sortWithinPartitions("turn", "label", F.size("found"), "found")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Ftrl(cells), []
        for batch in batches:
            for row in range(batch.num_rows):
                found, share = (batch.column(c)[row].values.to_numpy() for c in ("found", "share"))
                held.append((np.append(found, np.int32(cells)), np.append(share, np.float32(1)), batch.column("label")[row].as_py()))
        for turn in range(passes):
            for i in np.random.RandomState(turn).permutation(len(held)):
                model.learn(*held[i])
        w = model.weights(np.arange(cells + 1))
        full = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(w[full])], ["cell", "weight"])

    rows = ordered.select("label", "found", "share").mapInArrow(train, "cell int, weight double").toPandas()  # at most cells + 1 rows
    out = np.zeros(cells + 1)
    out[rows["cell"]] = rows["weight"]
    return out


def scored(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for first, part in slices(batch.column("text")):
                found, n = features(Texts(part), len(w) - 1)
                margin = segment_sums(w[found], n) / np.maximum(n, 1) + w[-1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(part)), pa.array(1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
