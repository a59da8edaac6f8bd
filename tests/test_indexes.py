"""The kept indexes: inverted files of vectors, positional postings, grams. What they find, what their plans read, what updates touch."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.functions import cells
from corpuslake.functions import vectors as V
from corpuslake.operators import substring, text_index
from corpuslake.operators.text_index import TextIndex
from corpuslake.plans import retrieval


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def found(df):
    return sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    """2,000 vectors around 40 centres."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.3 * rng.standard_normal(16)]) for i in range(2000)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(4).cache()


def test_few_cells_answer_where_vectors_have_structure(spark, clustered):
    index = cells.built(clustered, k=10, cells=40)
    queries = retrieval.asked(clustered)
    exact = {r[:2] for r in found(V.nearest(clustered, queries, 10))}
    got = {r[:2] for r in found(cells.searched(spark, index, queries))}
    read = cells.looked(spark, index, queries).agg(F.avg("codes"), F.avg("vectors")).first()
    assert len(exact & got) >= 0.9 * len(exact)
    assert read[0] <= 0.3 and read[1] <= 0.1
    assert index.recall >= 0.9


def test_structureless_vectors_need_many_codes_but_few_vectors(spark, small):
    """At sf0.1 (README): recall 0.96 with 6 % of the vectors."""
    corpus = retrieval.vectors(spark, small)
    index = cells.built(corpus, k=10)
    queries = retrieval.asked(corpus)
    exact = {r[:2] for r in found(V.nearest(corpus, queries, 10))}
    got = {r[:2] for r in found(cells.searched(spark, index, queries))}
    assert len(exact & got) >= 0.9 * len(exact)
    assert cells.looked(spark, index, queries).agg(F.avg("vectors")).first()[0] <= 0.25


def test_a_search_prunes_partitions(spark, clustered):
    index = cells.built(clustered, k=3, cells=16)
    one = clustered.filter("chunk_id = 7").withColumnRenamed("chunk_id", "query_id")
    plan = plan_of(cells.searched(spark, index, one, probes=2, candidates=50))
    assert re.search(r"PartitionFilters: \[.*cell#\d+ IN", plan)
    assert cells.CellIndex.load(spark, index.path) == index


def test_all_cells_and_codes_are_exact_and_rows_can_be_added(spark, clustered):
    index = cells.added(cells.built(clustered.filter("chunk_id < 900"), k=3, cells=8), clustered.filter("chunk_id >= 900"))
    queries = retrieval.asked(clustered)
    assert index.rows == 2000
    assert found(cells.searched(spark, index, queries, 5, probes=0, candidates=0)) == found(V.nearest(clustered, queries, 5))
    every = cells.searched(spark, index, queries, 5, probes=8, candidates=1999)  # by codes, but one row
    assert len(set(found(every)) & set(found(V.nearest(clustered, queries, 5)))) >= 0.95 * 5 * queries.count()


def test_empty_tables_have_an_index(spark, clustered):
    index = cells.built(clustered.limit(0))
    assert cells.searched(spark, index, retrieval.asked(clustered).limit(0)).count() == 0
    full = cells.built(clustered, k=2, cells=4)
    assert cells.searched(spark, full, retrieval.asked(clustered).limit(0), probes=1, candidates=5).count() == 0


TEXTS = {
    1: "The red fox, the RED hen", 2: "red hen and fox", 3: None, 4: "", 5: "fox " * 60, 6: "hen sees red; fox sees hen", 7: "été rouge 12",
}


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(list(TEXTS.items()) + [(100 + i, f"the common w{i}") for i in range(300)], "doc_id long, text string")
    return TextIndex.new(spark, 8).put(docs, "v1").put(docs.filter("doc_id < 3"), "v2")


def items(spark, *words):
    return spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "item_id long, words array<string>")


def test_frequent_terms_are_dealt_over_slices(index):
    slices = {r["term"]: r["slices"] for r in index.terms("v1").collect()}
    assert slices["the"] > 1 and slices["common"] > 1 and slices["hen"] == 1
    assert index.postings("v1").filter("term = 'the'").select("slice").distinct().count() == slices["the"]
    assert index.documents(index.weighed(index.terms("v1").filter("term = 'the'").select("term"), "v1"), "v1").count() == 301


def test_searches_read_no_text(spark, index):
    asked = items(spark, ("red", "fox"), ("the",))
    plan = plan_of(text_index.all_words(index, asked, "v1")) + plan_of(text_index.cover_density(index, asked, "v1"))
    assert "text#" not in plan and "Bucketed: true" in plan and "PartitionFilters: [isnotnull(corpus_version" in plan


def test_all_words_and_versions(spark, index):
    asked = items(spark, ("red", "fox"), ("hen", "nothing"), (), ("the",), ("été", "12"))
    got = {(r.item_id, r.doc_id) for r in text_index.all_words(index, asked, "v1").collect()}
    assert got == {(0, 1), (0, 2), (0, 6), (3, 1), (4, 7)} | {(3, 100 + i) for i in range(300)}
    assert {(r.item_id, r.doc_id) for r in text_index.all_words(index, asked, "v2").collect()} == {(0, 1), (0, 2), (3, 1)}


def test_most_words_are_those_of_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    docs = {i: rng.choice(words, size=rng.integers(1, 30), p=weights / weights.sum()).tolist() for i in range(400)}
    asked = {i: set(rng.choice(words, size=rng.integers(1, 12)).tolist()) for i in range(25)}
    index = TextIndex.new(spark, 4).put(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"), "v")
    rows = spark.createDataFrame([(i, w) for i, ws in asked.items() for w in ws], "item_id long, term string")
    got = sorted(map(tuple, text_index.most_words(index, rows, 5, "v").select("item_id", "doc_id", "hits", "rank").collect()))
    expected = []
    for i, ws in asked.items():
        hits = sorted(((-len(ws & set(d)), k) for k, d in docs.items() if ws & set(d)))[:5]
        expected += [(i, k, -h, n + 1) for n, (h, k) in enumerate(hits)]
    assert got == sorted(expected)


def test_cover_density_of_known_texts(spark, index):
    got = {(r.item_id, r.doc_id): r.density for r in text_index.cover_density(index, items(spark, ("red", "fox"), ("fox",)), "v1").collect()}
    weight = text_index.COVER_WEIGHT
    assert got[0, 2] == pytest.approx(weight / 3, abs=1e-6)  # two words between
    assert got[0, 6] == pytest.approx(weight, abs=1e-6)
    assert got[1, 5] == pytest.approx(60 * weight, abs=1e-6)


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_a_version_is_replaced_without_touching_others(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    index = TextIndex.new(spark, 2).put(docs, "v1").put(docs, "v2")
    folder = index.folder.removeprefix("file:")
    before = {k: v for k, v in files(folder).items() if "corpus_version=v1" in k}
    index.put(docs.filter("doc_id = 2"), "v2")
    assert {k: v for k, v in files(folder).items() if "corpus_version=v1" in k} == before
    assert index.postings("v2").count() == 2 and index.postings("v1").count() == 4
    index.drop("v2")
    assert index.postings("v2").count() == 0 and index.terms("v2").count() == 0 and index.postings("v1").count() == 4


NAMES = ["Small Ring", "RED gear", "blue", "b_lt", "a%b", "", None, "x", "ringing red rings", "Straße", "r%d_", "ab"]


def like(pattern, text):
    shape = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower())
    return re.search(shape, text.lower(), re.S) is not None


@pytest.mark.parametrize("pattern", ["small ring", "RED", "b_lt", "gear", "%", "_", "__", "", "r%d", "in", "x", "%%ring%%", "a_b", "ß", "red%ring", "zzz", "re_ r"])
def test_substring_search_is_ilike(spark, pattern):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    got = substring.containing(rows, spark.createDataFrame([(pattern, 1)], "pattern string, ord int"), "id", "name")
    assert got.columns == ["id", "name", "pattern", "ord"]
    assert sorted(r["id"] for r in got.collect()) == [i for i, n in enumerate(NAMES) if n is not None and like(pattern, n)]


def test_substring_search_meets_by_equality(spark):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    patterns = spark.createDataFrame([("red",), (None,), ("red",)], "pattern string")
    got = substring.containing(rows, patterns, "id", "name", substring.grams(rows, "id", "name").cache())
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert Counter(r["id"] for r in got.collect()) == {1: 2, 8: 2}
