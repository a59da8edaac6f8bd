"""A positional inverted index that is kept as tables, and three searches that read it instead of texts.

Postings (term, slice, doc_id, positions) are bucketed by term and slice and sorted within buckets, in a partition for each
version of the corpus; beside them, for each version, every term's number of documents and of slices. A term has one
slice, unless it has more postings than an average bucket: then its documents are dealt over several, so that no bucket
grows with one term. Texts are read once, when their version is written; versions are replaced or dropped by partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.functions import text as X
from corpuslake.session import fresh_folder

BUCKETS = 32
#: Postings that a task of a write sorts.
TASK_POSTINGS = 2_000_000
#: Asked words that are broadcast at once.
BLOCK_WORDS = 1_000_000
#: Texts meet Python in batches of bounded size while a version is written.
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
#: What a word without a label weighs in a cover.
COVER_WEIGHT = 0.1


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    folder: str
    name: str
    buckets: int = BUCKETS

    @classmethod
    def new(cls, spark: SparkSession, buckets: int = BUCKETS) -> TextIndex:
        return cls(spark, fresh_folder(spark, "text-index"), f"postings_{uuid.uuid4().hex}", buckets)

    def put(self, docs: DataFrame, version: str, terms_of: Callable[[str], Column] = X.tokens) -> TextIndex:
        """Write a version from docs (doc_id, text), in place of what it held; other versions' files stay. terms_of: the terms of a
        text in order, its tokens unless told otherwise."""
        spark = self.spark
        found = f"{self.folder}/found-{uuid.uuid4().hex}"
        columns = f"term string, doc_id {dict(docs.dtypes)['doc_id']}, positions array<int>"
        before = {key: spark.conf.get(key, None) for key in ARROW_CONF}
        for key, value in ARROW_CONF.items():
            spark.conf.set(key, value)
        try:
            docs.select("doc_id", terms_of("text").alias("terms")).mapInArrow(inverted, columns).write.parquet(found)
        finally:
            for key, value in before.items():
                spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
        written = spark.read.schema(columns).parquet(found)
        postings, total = written, written.count()
        if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # rows of one document are one document
            postings = written.groupBy("term", "doc_id").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        # A bucket is written by as many tasks as it fills: a task's number in a multiple of the buckets gives its bucket.
        tasks = self.buckets * max(1, -(-total // (self.buckets * TASK_POSTINGS)))
        counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
        terms = counted.withColumn("slices", F.ceil(F.col("documents") / max(1, total // tasks)).cast("int"))
        terms.withColumn("corpus_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_version").parquet(f"{self.folder}/terms")
        many = F.broadcast(self.terms(version).filter("slices > 1").select("term", "slices"))  # at most as many as there are tasks
        sliced = postings.join(many, "term", "left").withColumn("slice", slice_of("doc_id", F.coalesce("slices", F.lit(1)))).drop("slices")
        rows = sliced.select("term", "slice", "doc_id", "positions", F.lit(version).alias("corpus_version")).repartition(tasks, "term", "slice").sortWithinPartitions("term", "doc_id")
        if not spark.catalog.tableExists(self.name):
            writer = rows.write.partitionBy("corpus_version").bucketBy(self.buckets, "term", "slice").sortBy("term", "doc_id")
            writer.option("path", f"{self.folder}/postings").saveAsTable(self.name)
        else:
            mode = spark.conf.get(OVERWRITE)  # insertInto reads it from the session only
            spark.conf.set(OVERWRITE, "dynamic")
            try:
                rows.write.insertInto(self.name, overwrite=True)
            finally:
                spark.conf.set(OVERWRITE, mode)
        written.limit(0).coalesce(1).write.mode("overwrite").parquet(found)
        return self

    def drop(self, version: str) -> None:
        """Forget a version."""
        gone = self.spark.read.parquet(f"{self.folder}/terms").drop("corpus_version").limit(0)
        gone.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/terms/corpus_version={version}")
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (corpus_version = '{version}')")

    def terms(self, version: str) -> DataFrame:
        """term, documents, slices."""
        kinds = "term string, documents long, slices int, corpus_version string"
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/terms").filter(F.col("corpus_version") == version).drop("corpus_version")

    def postings(self, version: str) -> DataFrame:
        """term, slice, doc_id, positions."""
        return self.spark.table(self.name).filter(F.col("corpus_version") == version).drop("corpus_version")

    def weighed(self, asked: DataFrame, version: str) -> DataFrame:
        """asked (.., term) with each term's documents and slices; 0 of both where it has none."""
        met = self.terms(version).join(F.broadcast(asked.select("term").distinct()), "term")  # a vocabulary is not shuffled for a few words
        known = asked.join(met, "term", "left")
        return known.withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn("slices", F.coalesce("slices", F.lit(0)))

    def documents(self, weighed: DataFrame, version: str, *columns: str) -> DataFrame:
        """weighed (.., term, slices) with the documents of each term, and more columns of their postings: buckets are met where they
        lie, and postings pass by the terms, which are few, unsorted."""
        spread = weighed.filter("slices > 0").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        return spread.hint("shuffle_hash").join(self.postings(version).select("term", "slice", "doc_id", *columns), ["term", "slice"]).drop("slice", "slices")

    def places(self, pairs: DataFrame, version: str, positions: bool = False) -> DataFrame:
        """pairs (.., doc_id, term, slices) of which the document holds the term; with its positions, if asked. Of the postings, only
        those of the pairs' terms leave their buckets."""
        held = self.documents(pairs.select("term", "slices").distinct(), version, *(["positions"] if positions else []))
        return pairs.drop("slices").join(held.hint("merge"), ["term", "doc_id"])


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, terms) turned into (term, doc_id, positions), each row of documents by itself: nothing is shuffled. A batch leaves
    in the order of its terms, so that later sorts merge runs."""
    for batch in batches:
        lists = batch.column("terms")
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            continue
        sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        terms = pc.array_sort_indices(flat.dictionary)
        code = np.empty(len(terms), np.int64)
        code[terms.to_numpy()] = np.arange(len(terms))
        key = code[flat.indices.to_numpy()] * len(sizes) + row
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(place[order].astype(np.int32)))
        term = flat.dictionary.take(terms.take(pa.array(key[first] // len(sizes))))
        yield pa.RecordBatch.from_arrays([term, batch.column("doc_id").take(pa.array(key[first] % len(sizes))), positions], ["term", "doc_id", "positions"])


def slice_of(doc_id: str, slices: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), slices).cast("int")


def _met(index: TextIndex, items: DataFrame, version: str, positions: bool = False) -> DataFrame:
    """item_id, doc_id, needed, term, word: the words of items (item_id, words) that documents hold which hold the item's rarest word."""
    single = items.filter("size(words) > 0").select("item_id", F.size("words").alias("needed"), F.posexplode("words").alias("word", "term"))
    weighed = index.weighed(single, version)
    rarest = weighed.groupBy("item_id").agg(F.min(F.struct("documents", "term", "slices")).alias("r")).filter("r.documents > 0")
    found = index.documents(rarest.select("item_id", "r.term", "r.slices"), version).select("item_id", "doc_id")
    # An item with a word that no document has matches nothing: its rarest word is that one.
    asked = weighed.select("item_id", "needed", "word", "term", "slices")
    held = index.documents(asked.join(rarest.select("item_id"), "item_id", "left_semi").select("term", "slices").distinct(), version, *(["positions"] if positions else []))
    return found.join(asked.drop("slices"), "item_id").join(held.hint("merge"), ["term", "doc_id"])


def all_words(index: TextIndex, items: DataFrame, version: str) -> DataFrame:
    """item_id, doc_id, needed: the documents that hold every word of an item (item_id, words); no word matches nothing.

    Documents are met by each item's rarest word only; the other words are then looked up by document
    and word, so that a frequent word makes no pairs of its own."""
    held = _met(index, items, version)
    return held.groupBy("item_id", "doc_id", "needed").count().filter("count = needed").select("item_id", "doc_id", "needed")


def most_words(index: TextIndex, asked: DataFrame, k: int, version: str) -> DataFrame:
    """item_id, doc_id, hits, rank: the k documents that hold most words of an item (item_id, term); of equal ones the lower ids.

    Exact: the postings of all words that are asked are brought together by document, once for each word however many
    items ask for it. There, items are met by word and their hits counted, so a task's pairs never leave it: only its best k
    of each item do. Tasks are as many as keep the pairs of each bounded; items that are many are broadcast by blocks."""
    rows = index.weighed(asked.distinct(), version).filter("documents > 0")
    size = rows.agg(F.sum("documents"), F.count(F.lit(1))).first()
    pairs, blocks = size[0] or 0, max(1, -(-size[1] // BLOCK_WORDS))
    best = Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id")
    met = index.documents(rows.select("term", "slices").distinct(), version).repartition(max(1, -(-pairs // TASK_POSTINGS)), "doc_id")
    counted = []
    for n in range(blocks):
        here = rows.select("item_id", "term").filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n) if blocks > 1 else rows.select("item_id", "term")
        counted.append(met.join(F.broadcast(here), "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("hits")))
    return reduce(DataFrame.unionAll, counted).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def cover_density(index: TextIndex, items: DataFrame, version: str) -> DataFrame:
    """item_id, doc_id, density: over the shortest spans of a document that hold every word of an item, the sum of the weight
    divided by one more than the other words inside.

    A span ends at a place of a word and begins at the earliest of the words' last places up to there;
    of spans with one beginning the first counts. One fold over a document's places of the item's words, which carries
    each word's last place and its number among them."""
    held = _met(index, items, version, positions=True)
    spot = F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("word").alias("word")))))
    spots = held.groupBy("item_id", "doc_id", "needed").agg(F.count(F.lit(1)).alias("count"), F.array_sort(spot).alias("spots")).filter("count = needed")
    kind = "struct<last:array<struct<pos:int,at:int>>,begin:int,seen:int,density:double>"
    nowhere = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("at"))
    start = F.struct(F.array_repeat(nowhere, F.col("needed")).alias("last"), F.lit(-1).alias("begin"), F.lit(0).alias("seen"), F.lit(0.0).alias("density")).cast(kind)

    def step(state: Column, spot: Column) -> Column:
        here = F.struct(spot["pos"].alias("pos"), state["seen"].alias("at"))
        last = F.transform(state["last"], lambda x, i: F.when(i == spot["word"], here).otherwise(x))
        return F.struct(last.alias("last"), state["begin"].alias("begin"), (state["seen"] + 1).alias("seen"), state["density"].alias("density")).cast(kind)

    def counted(state: Column, spot: Column) -> Column:
        begin = F.array_min(state["last"])
        inside = state["seen"] - begin["at"]
        new = (begin["pos"] >= 0) & (begin["pos"] > state["begin"])
        cover = F.when(new, F.lit(COVER_WEIGHT) / (spot["pos"] - begin["pos"] - inside + 2)).otherwise(0.0)
        return F.struct(state["last"].alias("last"), F.when(new, begin["pos"]).otherwise(state["begin"]).alias("begin"), state["seen"].alias("seen"), (state["density"] + cover).alias("density")).cast(kind)

    density = F.aggregate("spots", start, lambda state, spot: counted(step(state, spot), spot), lambda s: s["density"])
    return spots.select("item_id", "doc_id", F.round(density, 6).alias("density"))
