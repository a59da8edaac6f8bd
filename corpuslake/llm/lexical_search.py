"""Ranked lexical search over hashed max-sketches.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A term that occurs tf times
in a document has the impact (10^9 tf) div (1000 tf + 20 m), where m follows the document's length, and a document's
score is the sum of its impacts times the weights of an item's terms.

One pass over the texts writes an index: for each document its length, a digest of its text and its sketch, and for
each term the documents that hold it. A sketch has 2^BITS coordinates; a term's impact goes to the one that its hash
names, and a coordinate keeps the greatest. Only coordinates above 0 are written, 4 bytes each. Since impacts of one
document grow with tf, they hold the greatest tf (MOST_TF stands for all above), so the index depends neither on m nor on
the items. A coordinate is an upper bound for all terms that share it, so weights times coordinates are upper bounds of
scores; they are looked up for all of a block of items at once, as one product of matrices.

Search is exact. Round one scores, from their texts, the documents of greatest bounds: the score in place `top` is a
threshold that no result falls below. Round two scores all others whose bound reaches it. Of equal texts the least
`top` ids can be results, and one is scored for all.

Cases: a null or empty text, or one without terms, is found by no item; an item without terms finds nothing; repeated
items are searched each; repeated documents and equal scores come by doc_id (nulls first), then in any order; other
columns are not read; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.llm.runtime import dropped, settled
from corpuslake.llm.textbatch import Texts, slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bytes of terms stay (A-Z lower-cased), all others become spaces.
TERM_BYTES = np.full(256, 0x20, np.uint8)
TERM_BYTES[128:] = np.arange(128, 256)
TERM_BYTES[48:58] = np.arange(48, 58)
TERM_BYTES[97:123] = TERM_BYTES[65:91] = np.arange(97, 123)
#: Bits of a coordinate, and the greatest tf that it keeps: both fit 32 bits.
BITS, MOST_TF = 24, 255
#: Items that are searched at once: so many, of so many characters.
BLOCK_ITEMS, BLOCK_CHARS = 256, 1 << 20
#: Terms whose documents a task counts before it sends them on.
COUNTED_TERMS = 100_000
#: Places of the bound matrix that a task holds at once.
BOUND_CELLS = 1 << 20
SLICE = 1 << 19
U = np.uint64


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def term_texts(part: pa.Array) -> Texts:
    """Texts whose words are their terms."""
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
    data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bare = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(TERM_BYTES[data]))
    return Texts(bare)


def term_counts(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, number, place of one and number of occurrences of every distinct term of each text; the terms by number."""
    numbers, names = texts.numbers()
    keys, place, tf = np.unique(texts.owner * (len(names) + 1) + numbers, return_index=True, return_counts=True)
    return keys // (len(names) + 1), keys % (len(names) + 1), place, tf, names


def coordinates(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U(64 - BITS)


def sketches_of(texts: Texts, owner: np.ndarray, hashes: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of some texts in a row (coordinate and tf as one number), and where each begins (and the end)."""
    cells = np.sort(owner.astype(U) << U(BITS + 8) | coordinates(hashes) << U(8) | np.minimum(tf, MOST_TF).astype(U))
    last = np.ones(len(cells), bool)
    last[:-1] = cells[1:] >> U(8) != cells[:-1] >> U(8)
    cells = cells[last]
    at = np.searchsorted(cells >> U(BITS + 8), np.arange(texts.n + 1, dtype=U))
    return cells.astype(np.uint32), at


INDEX = "row long, doc_id long, high long, low long, n long, sketch binary, term string, df long"


def indexed(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The index as one table (a row per document: row, doc_id, high and low of the text's digest, n, sketch; and rows
    of term and df), the number of documents with a term and of all terms."""
    fields = ["doc_id", "high", "low", "n", "sketch", "term", "df"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def counted() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(held).group_by("term").aggregate([("df", "sum")])
            held.clear()
            for one in rows.select(["term", "df_sum"]).to_batches():
                nothing = [pa.nulls(one.num_rows, kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*nothing, one.column(0).cast(pa.string()), one.column(1)], fields)

        for batch in batches:
            for first, part in slices(batch.column("text"), SLICE):
                texts = term_texts(part)
                owner, number, place, tf, names = term_counts(texts)
                cells, at = sketches_of(texts, owner, texts.words()[place], tf)
                holders = np.bincount(number, minlength=len(names))
                seen = np.flatnonzero(holders)
                held.append(pa.table({"term": names.take(pa.array(seen)), "df": holders[seen]}))
                digests = np.array([np.frombuffer(blake2b(t.as_buffer() or b"", digest_size=16).digest(), np.int64) for t in part.cast(pa.large_binary())]).reshape(-1, 2)
                size = len(part)
                columns = [
                    batch.column("doc_id").slice(first, size), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(texts.counts, pa.int64()),
                    pa.array([cells[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, fields)
                if sum(t.num_rows for t in held) > COUNTED_TERMS:
                    yield from counted()
        if held:
            yield from counted()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(index, INDEX.removeprefix("row long, "))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), *fields)
    table, seen = settled(rows, F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("terms"))
    return table, seen["documents"] or 0, seen["terms"] or 0


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items as (id, distinct terms), in blocks of bounded number and size; one block is held at a time."""
    rows = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    rows = rows.select("*", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(1 << 20)).alias("slot"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    count = max(1, -(-total["n"] * 3 // (2 * BLOCK_ITEMS)), -(-(total["chars"] or 0) // BLOCK_CHARS)) if total["n"] > BLOCK_ITEMS or (total["chars"] or 0) > BLOCK_CHARS else 1
    for k in range(count):
        here = rows.filter(F.col("slot") % count == k) if count > 1 else rows
        block = [(r["item_id"], sorted(set(terms_of(r["text"])))) for r in here.toLocalIterator()]
        if block := [x for x in block if x[1]]:
            yield block


class Block:
    """The items of a block as sparse rows of weighted terms; goes to the tasks."""

    def __init__(self, items: list[tuple[int | None, list[str]]], df: dict[str, int], documents: int, terms: int):
        held = [(k, [t for t in ts if t in df]) for k, ts in items]  # a term of no document adds nothing
        items = [(k, ts) for k, ts in held if ts]
        self.ids = [k for k, _ in items]
        self.documents, self.all_terms = documents, terms
        self.terms = sorted(df)
        self.number = {t.encode(): i for i, t in enumerate(self.terms)}
        places = coordinates(Texts(pa.array(self.terms, pa.large_string())).words())
        #: the terms' coordinates in order, which of them each term has, and a first look by their low bits
        self.coordinates, self.shares = np.unique(places, return_inverse=True)
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.coordinates & U(0xFFFF)).astype(np.int64)] = True
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in self.terms]
        self.places = np.concatenate([[self.number[t.encode()] for t in ts] for _, ts in items]).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum([len(ts) for _, ts in items])])[:-1].astype(np.int64)
        self.weights = np.array(weights, np.int64)

    def middle(self, n: np.ndarray) -> np.ndarray:
        return 100 - 50 + 50 * n * self.documents // self.all_terms

    def scores(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Exact scores of documents (rows, of n terms) for all items (columns); tf: occurrences of the block's terms."""
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * self.middle(n)[:, None])
        return np.add.reduceat((impact * self.weights)[:, self.places], self.begins, axis=1)

    def matrix(self) -> np.ndarray:
        """Weights by coordinate and item; terms of one item that share a coordinate add up."""
        out = np.zeros((len(self.coordinates), len(self.ids)), np.float32)
        np.add.at(out, (self.shares[self.places], np.repeat(np.arange(len(self.ids)), np.diff(np.append(self.begins, len(self.places))))), self.weights[self.places])
        return out

    def bounds(self, batch: pa.RecordBatch, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First row, and upper bounds of scores, of some documents at a time for all items. 32-bit floats are raised by more than they can err."""
        column = batch.column("sketch").cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
        cells = np.frombuffer(column.buffers()[2] or b"", np.uint32)
        middle = self.middle(batch.column("n").to_numpy()).astype(np.float32)
        raised = np.float32(1 + 1e-5 + 2e-7 * int(np.diff(np.append(self.begins, len(self.places))).max()))
        step = max(1, BOUND_CELLS // max(matrix.shape))
        for first in range(0, len(column), step):
            end = min(first + step, len(column))
            here = cells[at[first] : at[end]]
            owner = np.repeat(np.arange(end - first), np.diff(at[first : end + 1]))
            hit = np.flatnonzero(self.likely[here >> np.uint32(8) & np.uint32(0xFFFF)])
            owner, here = owner[hit], here[hit]
            place = np.searchsorted(self.coordinates, (here >> np.uint32(8)).astype(U))
            met = self.coordinates[np.minimum(place, len(self.coordinates) - 1)] == here >> np.uint32(8)
            owner, place, tf = owner[met], place[met], (here[met] & np.uint32(MOST_TF)).astype(np.float32)
            impact = np.zeros((end - first, len(self.coordinates)), np.float32)
            impact[owner, place] = np.where(tf == MOST_TF, np.float32(1e6), np.float32(1e6) * tf / (tf + np.float32(0.02) * middle[first + owner]))
            yield first, (impact @ matrix) * raised


def highest(index: DataFrame, block: Block, keep: int) -> DataFrame:
    """item, row, bound: the documents of greatest bounds for each item."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        matrix, size = block.matrix(), len(block.ids)
        bound, row = np.zeros((0, size), np.float32), np.zeros((0, size), np.int64)
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for first, more in block.bounds(batch, matrix):
                bound = np.vstack([bound, more])
                row = np.vstack([row, np.repeat(rows[first : first + len(more), None], size, 1)])
                if len(bound) > keep:
                    top = np.argpartition(-bound, keep - 1, axis=0)[:keep]
                    bound, row = np.take_along_axis(bound, top, 0), np.take_along_axis(row, top, 0)
        item = np.broadcast_to(np.arange(size, dtype=np.int32), bound.shape)
        found = bound > 0
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(item[found]), pa.array(row[found]), pa.array(bound[found])], ["item", "row", "bound"])

    rows = index.select("row", "n", "sketch").mapInArrow(best, "item int, row long, bound float")
    # Few rows a task are left; they meet in two steps, so that no item's rows of all tasks meet at once.
    for keys in (["item", F.pmod("row", F.lit(64))], ["item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bound"), "row"))
        rows = rows.withColumn("place", place).filter(F.col("place") <= keep).drop("place")
    return rows


def reaching(index: DataFrame, block: Block, least: list[int], top: int) -> DataFrame:
    """item, row, doc_id, high, low: the documents whose bound reaches their item's least score; of equal texts in a batch the `top` least ids."""
    shared = index.sparkSession.sparkContext.broadcast((block, np.array(least, np.float64)))
    names = ["item", "row", "doc_id", "high", "low"]

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = shared.value
        matrix = block.matrix()
        for batch in batches:
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            high, low = batch.column("high").to_numpy(), batch.column("low").to_numpy()
            order = np.lexsort([ids, low, high])
            new = np.ones(len(order), bool)
            new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
            begins = np.flatnonzero(new)
            place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            batch = batch.take(pa.array(np.sort(order[place < top])))
            for first, bound in block.bounds(batch, matrix):
                doc, item = np.nonzero(bound >= least)
                if len(doc):
                    rows = batch.take(pa.array(doc + first))
                    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), *[rows.column(k) for k in names[1:]]], names)

    return index.select("row", "doc_id", "high", "low", "n", "sketch").mapInArrow(reach, "item int, row long, doc_id long, high long, low long")


#: Documents to be scored that are few enough to be sent to all tasks, so that texts stay where they are.
BROADCAST_DOCS = 500_000


def rescored(docs: DataFrame, pairs: DataFrame, block: Block) -> DataFrame:
    """high, low, item, score: exact scores of the pairs (item, doc_id, high, low), one for all equal texts."""
    wanted = settled(pairs.groupBy("high", "low").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("doc_id"), F.collect_set("item").alias("items")))
    few = wanted.count() <= BROADCAST_DOCS
    side = wanted.select(F.col("doc_id").alias("wanted_id"), "high", "low", "items")
    side = F.broadcast(side) if few else side.hint("merge")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(side, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("text", "high", "low", "items")
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = ["high", "low", "item", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        size, held = len(block.terms), max(1, BOUND_CELLS // max(len(block.places), 1))
        for batch in batches:
            for first, part in slices(batch.column("text"), SLICE):
                digests = [np.frombuffer(blake2b(t.as_buffer() or b"", digest_size=16).digest(), np.int64) for t in part.cast(pa.large_binary())]
                high, low = (batch.column(k).slice(first, len(part)).to_numpy() for k in ("high", "low"))
                same = np.array([d[0] == a and d[1] == b for d, a, b in zip(digests, high, low, strict=True)], bool)
                texts = term_texts(part)
                owner, number, _, tf, names_of = term_counts(texts)
                at = np.array([block.number.get(t, -1) for t in names_of.to_pylist()], np.int64)
                term = at[number] if len(number) else number
                for begin in range(0, len(part), held):
                    end = min(begin + held, len(part))
                    here = (owner >= begin) & (owner < end) & (term >= 0)
                    counts = np.zeros((end - begin, size), np.int64)
                    counts[owner[here] - begin, term[here]] = tf[here]
                    scores = block.scores(counts, texts.counts[begin:end])
                    items = batch.column("items").slice(first + begin, end - begin).to_pylist()
                    for k in np.flatnonzero(same[begin:end]):
                        item = np.array(items[k], np.int32)
                        won = scores[k, item]
                        item, won = item[won > 0], won[won > 0]
                        if len(item):
                            row = begin + k
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), high[row])), pa.array(np.full(len(item), low[row])), pa.array(item), pa.array(won)], names)

    scored = texts.mapInArrow(score, "high long, low long, item int, score long")
    return scored.dropDuplicates(["high", "low", "item"])


def searched(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of highest score above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    index, documents, terms = indexed(docs)
    sketches, counts = index.filter(F.col("n") > 0), index.filter(F.col("term").isNotNull())
    parts = []
    for items_here in item_blocks(items) if documents else ():
        wanted = spark.createDataFrame([(t,) for t in sorted(set().union(*(t for _, t in items_here)))], "term string")  # at most BLOCK_CHARS characters
        df = {r["term"]: r["df"] for r in counts.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        if not df:
            continue
        block = Block(items_here, df, documents, terms)
        first = highest(sketches, block, top)
        first = settled(first.join(sketches.select("row", "doc_id", "high", "low").hint("merge"), "row"))
        known = settled(rescored(docs, first, block))
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
        ranked = first.join(known, ["item", "high", "low"]).withColumn("place", place).filter(F.col("place") == top)
        least = {r["item"]: r["score"] for r in ranked.select("item", "score").collect()}  # a row an item
        reached = settled(reaching(sketches, block, [least.get(i, 1) for i in range(len(block.ids))], top))
        unknown = reached.join(known.select("item", "high", "low"), ["item", "high", "low"], "left_anti")
        scores = known.unionByName(rescored(docs, unknown, block), allowMissingColumns=False)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_first(), "row"]
        rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
        found = reached.join(scores, ["item", "high", "low"]).withColumn("rank", rank).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")  # at most a block's items
        parts.append(settled(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
        dropped(first, known, reached)
    dropped(index)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
