"""What an index of texts moves: documents are inverted where they lie, and only the postings of asked words leave their buckets."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from corpuslake.functions import cells, stems
from corpuslake.functions import vectors as V
from corpuslake.operators import text_index
from corpuslake.operators.text_index import TextIndex
from tests.test_indexes import items, plan_of

TEXTS = [(1, "b a b"), (2, None), (3, ""), (4, "a c a a"), (5, "b")]


def rows_of(index, version="v"):
    return sorted((r.term, r.doc_id, tuple(r.positions)) for r in index.postings(version).collect())


def test_documents_are_inverted_in_their_batch():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "terms": pa.array([["b", "a", "b"], None, [], ["a", "c"]], pa.list_(pa.string()))})
    (got,) = text_index.inverted(iter([batch]))
    assert [(r["term"], r["doc_id"], r["positions"]) for r in got.to_pylist()] == [("a", 1, [1]), ("a", 4, [0]), ("b", 1, [0, 2]), ("c", 4, [1])]
    assert not list(text_index.inverted(iter([batch.slice(1, 2)])))


def test_a_bucket_is_written_by_several_tasks(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS + [(n, f"a w{n}") for n in range(10, 60)], "doc_id long, text string")
    one = TextIndex.new(spark, 2).put(docs, "v")
    monkeypatch.setattr(text_index, "TASK_POSTINGS", 10)
    several = TextIndex.new(spark, 2).put(docs, "v")
    assert rows_of(several) == rows_of(one) and len(rows_of(one)) == 105
    count = lambda x: len(list(Path(x.folder.removeprefix("file:")).glob("postings/*/*.parquet")))
    assert count(one) == 2 and count(several) > 2
    asked = items(spark, ("a", "w20"), ("a", "b"))
    assert sorted((r.item_id, r.doc_id) for r in text_index.all_words(several, asked, "v").collect()) == [(0, 20), (1, 1)]


def test_rows_of_one_document_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c a"), (2, "a")], "doc_id long, text string")
    index = TextIndex.new(spark, 2).put(docs, "v")
    assert rows_of(index) == [("a", 1, (0, 1)), ("a", 2, (0,)), ("b", 1, (1,)), ("c", 1, (0,))]
    words = spark.createDataFrame([(0, "a"), (0, "c")], "item_id long, term string")
    assert [(r.doc_id, r.hits) for r in text_index.most_words(index, words, 2, "v").orderBy("rank").collect()] == [(1, 2), (2, 1)]


@pytest.fixture
def shuffled_joins(spark):
    """As on tables too large for a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("search", [text_index.all_words, text_index.cover_density])
def test_postings_are_not_shuffled_whole(spark, shuffled_joins, search):
    index = TextIndex.new(spark, 2).put(spark.createDataFrame(TEXTS, "doc_id long, text string"), "v")
    assert not re.search(r"hashpartitioning\(term#\d+, slice#\d+, doc_id", plan_of(search(index, items(spark, ("a", "c")), "v")))


def test_most_words_move_a_posting_once(spark, shuffled_joins, monkeypatch):
    index = TextIndex.new(spark, 2).put(spark.createDataFrame(TEXTS, "doc_id long, text string"), "v")
    words = spark.createDataFrame([(n, w) for n in range(50) for w in ("a", "b")], "item_id long, term string")
    monkeypatch.setattr(text_index, "BLOCK_WORDS", 30, raising=False)
    found = text_index.most_words(index, words, 2, "v")
    plan = plan_of(found)
    assert not re.search(r"hashpartitioning\(term#\d+, slice#\d+, doc_id", plan)
    assert {(r.item_id, r.rank, r.doc_id, r.hits) for r in found.collect()} == {(n, *r) for n in range(50) for r in ((1, 1, 2), (2, 4, 1))}


def test_a_word_is_stemmed_once_a_batch(monkeypatch):
    seen, real = [], stems.stem
    monkeypatch.setattr(stems, "stem", lambda w: seen.append(w) or real(w))
    rows = pa.array([["rings", "ringing", "rings"], None, [], ["rings"]], pa.list_(pa.string()))
    assert stems.stemmed(rows).to_pylist() == [["ring", "ring", "ring"], None, [], ["ring"]]
    assert sorted(seen) == ["ringing", "rings"]


def test_codes_stay_in_their_tasks(spark, monkeypatch):
    """Of what a search by codes shuffles, none is a code's row: k rows a task and query leave, and counts."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(n, rng.standard_normal(16).tolist()) for n in range(1200)], "chunk_id long, embedding array<double>").repartition(3)
    index = cells.built(rows, k=3, cells=6)
    queries = rows.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    found = cells.searched(spark, index, queries, 3, probes=6, candidates=600)
    assert plan_of(found).count("MapInArrow") == 1 and "Join" not in plan_of(found)
    near = {(r.query_id, r.chunk_id) for r in found.collect()}
    true = {(r.query_id, r.chunk_id) for r in V.nearest(rows, queries, 3).collect()}
    assert len(near) == 72 and len(near & true) >= 0.95 * 72
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 10)
    assert {(r.query_id, r.chunk_id) for r in cells.searched(spark, index, queries, 3, probes=6, candidates=600).collect()} == near


def test_cells_are_asked_by_the_queries_that_want_them():
    got = cells.asking(np.array([[2, 0], [0, 5], [5, 2]]))
    assert {c: who.tolist() for c, who in got.items()} == {0: [0, 1], 2: [0, 2], 5: [1, 2]}
