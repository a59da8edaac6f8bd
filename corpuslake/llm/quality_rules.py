"""Quality rules: a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Word unigrams and bigrams of every document are hashed into `buckets` cells. Two smoothed
multinomials are counted over all documents: `target` from the documents that `trusted` names,
`raw` from all of them. A document's ratio is the mean over its n-grams of log(target/raw), so it
does not depend on length. `kept` is a fixed comparison with `threshold`, made after base rules on
word count and repeated passages.

Cases: a null or empty text has no words, ratio 0 and fails the base rules; rows of `trusted` with
a null id, or an id without a document, count for nothing; repeated rows count as often as they
occur; an empty table gives an empty result; an empty `trusted` gives ratio 0 for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.runtime import returning
from corpuslake.llm.textbatch import Texts, seen_before, segment_sums, slices

BUCKETS = 1 << 16
#: Mean log ratio, natural logarithm, under which a document does not look like the target.
THRESHOLD = -0.2
#: Up to so many trusted ids (some 40 MB as a hash table) are broadcast; beyond, texts are shuffled to them.
BROADCAST_IDS = 2_000_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Bytes of text whose words a task holds at once.
SLICE = 1 << 19
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))

MEASURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("llr", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def gram_cells(texts: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all unigrams and bigrams, text by text, and how many each text has."""
    words = texts.words()
    pairs, place = texts.grams(words, 2)
    cells = np.concatenate([words, pairs]) & np.uint64(buckets - 1)
    owner = np.concatenate([texts.owner, texts.owner[place]])
    order = np.argsort(owner, kind="stable")
    return cells[order].astype(np.int64), np.bincount(owner, minlength=texts.n)


def counted_cells(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(cell, raw, target): n-gram counts over all documents. Each task sends at most `buckets` rows."""
    ids = trusted.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__trusted")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__trusted"), "left")
    marked = marked.select("text", F.col("__trusted").isNotNull().alias("is_target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            flags = batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            for first, part in slices(batch.column("text"), SLICE):
                cells, n = gram_cells(Texts(part), buckets)
                raw += np.bincount(cells, minlength=buckets)
                target += np.bincount(cells[np.repeat(flags[first : first + len(part)], n)], minlength=buckets)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(raw[full]), pa.array(target[full])], ["cell", "raw", "target"])

    counts = marked.mapInArrow(returning(count), "cell int, raw long, target long")
    return counts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(cells: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target/raw) by cell, with one count added to each. The table is `buckets` rows, whatever the corpus."""
    rows = cells.toPandas()
    raw, target = np.ones(buckets), np.ones(buckets)
    if rows["target"].sum() == 0:
        return np.zeros(buckets)
    raw[rows["cell"]] += rows["raw"]
    target[rows["cell"]] += rows["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def measure(part: pa.Array, ratios: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    texts = Texts(part)
    words = texts.counts.astype(np.int64)
    points = ((texts.data & 0xC0) != 0x80) & ~texts.space
    lines, line_owner = texts.lines()
    earlier, _ = seen_before(lines, line_owner)
    windows, place = texts.windows(WINDOW)
    _, again = seen_before(windows, texts.owner[place])
    edges = np.zeros(len(texts.starts) + 1, np.int64)
    np.add.at(edges, place[again], 1)
    np.add.at(edges, place[again] + WINDOW, -1)
    repeated = np.bincount(texts.owner[np.cumsum(edges[:-1]) > 0], minlength=texts.n)
    cells, n = gram_cells(texts, len(ratios))
    llr = segment_sums(ratios[cells], n) / np.maximum(n, 1)
    failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)
    return {
        "n_words": words,
        "word_chars": texts.per_text(points),
        "n_symbols": texts.per_text(_IS_SYMBOL[texts.data]),
        "n_dup_lines": np.bincount(line_owner[earlier], minlength=texts.n),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "llr": llr,
        "kept": ~failed & (llr >= threshold),
    }


def fitted(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The table of log ratios over all documents."""
    return log_ratios(counted_cells(docs, trusted, buckets), buckets)


def judged(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row of MEASURES per document. Two passes over the texts, neither of which shuffles them
    unless the ids of `trusted` are more than BROADCAST_IDS."""
    table = docs.sparkSession.sparkContext.broadcast(fitted(docs, trusted, buckets))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text"), SLICE):
                got = measure(part, table.value, threshold)
                ids = batch.column("doc_id").slice(first, len(part))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(got[f.name]) for f in MEASURES.fields[1:]]], MEASURES.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(returning(judge), MEASURES)


def accepted(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    table = docs.sparkSession.sparkContext.broadcast(fitted(docs, trusted, buckets))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text"), SLICE):
                yield batch.slice(first, len(part)).filter(pa.array(measure(part, table.value, threshold)["kept"]))

    return docs.mapInArrow(returning(keep), docs.schema)
