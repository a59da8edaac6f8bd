"""Sources and sinks: what is read, what is pruned, what is taken up again; vectors in tiles; the guard on streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake import session
from corpuslake.functions import vectors
from corpuslake.operators import answers
from corpuslake.sources import paged, sinks, tables
from tests.test_operators import one


def test_a_version_is_read_by_its_partition_only(spark, tmp_path):
    rows = spark.range(40).select("id", F.concat(F.lit("v"), F.col("id") % 4).alias("corpus_version"))
    sinks.version(rows, f"{tmp_path}/t")
    plan = sinks.scan(spark, f"{tmp_path}/t", "v1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(corpus_version" in plan and "= v1)" in plan
    sinks.delete_version(spark, f"{tmp_path}/t", "v2")
    assert {r.corpus_version: r["count"] for r in spark.read.parquet(f"{tmp_path}/t").groupBy("corpus_version").count().collect()} == {"v0": 10, "v1": 10, "v3": 10}


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    for folder, text in (("a", "one"), ("b", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.md").write_text(text)
    got = tables.manifest(spark, [(f"{tmp_path}/b/x.md", "faq"), (f"{tmp_path}/none.md", "errata"), (f"{tmp_path}/a/x.md", "rulebook")])
    assert [(r.ord, r.source_type, r.text) for r in got.orderBy("ord").collect()] == [(0, "faq", "two"), (2, "rulebook", "one")]


def test_batches_are_taken_up_where_they_stopped(spark, tmp_path):
    todo = spark.range(100).withColumnRenamed("id", "k")
    work = lambda run: lambda rows: rows.select("k", F.lit(run).alias("run"))
    first = sinks.resumable(todo, "k", work(1), f"{tmp_path}/s", 5, stop=lambda n: n == 3).count()
    assert 30 < first < 90
    both = sinks.resumable(todo, "k", work(2), f"{tmp_path}/s", 5)
    assert both.count() == both.select("k").distinct().count() == 100 and both.filter("run = 1").count() == first
    assert sinks.resumable(todo, "k", work(3), f"{tmp_path}/s", 5).filter("run = 3").count() == 0
    assert tables.state(spark, f"{tmp_path}/none", "k long").count() == 0


def test_pages_end_with_a_short_one_and_throttled_calls_are_repeated():
    calls = []

    def fetch(url, page, size):
        calls.append(page)
        if page == 2 and calls.count(2) < 3:
            raise paged.Throttled
        return paged.numbered(url, page, size)

    assert [r["id"] for r in paged.records(fetch, "1-25", 10, wait=0)] == list(range(1, 26))
    assert calls == [1, 2, 2, 2, 3]
    assert [r["id"] for r in paged.records(paged.numbered, "1-20", 10)] == list(range(1, 21))  # an empty page ends it
    with pytest.raises(paged.Throttled):
        list(paged.records(lambda *a: (_ for _ in ()).throw(paged.Throttled()), "u", wait=0))


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    assert session.fresh_folder(spark, "x").startswith(session.shared_folder(spark) + "/x-")

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_tiles_change_nothing(spark, monkeypatch):
    rng = np.random.RandomState(5)
    v = rng.normal(size=(300, 6)).round(1)  # many equal similarities
    corpus = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "chunk_id long, embedding array<float>").repartition(2)
    asked = corpus.filter("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    whole = vectors.nearest(corpus, asked, 7, digits=2).collect()
    monkeypatch.setattr(vectors, "TILE_ROWS", 11)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 3)
    assert sorted(vectors.nearest(corpus, asked, 7, digits=2).collect()) == sorted(whole)
    unit = v.astype(np.float32).astype(float) / np.linalg.norm(v.astype(np.float32).astype(float), axis=1, keepdims=True)
    for q in range(20):
        best = sorted(range(300), key=lambda i: (-round(unit[q] @ unit[i], 2), i))[:7]
        assert [r.chunk_id for r in sorted(whole, key=lambda r: r["rank"]) if r.query_id == q] == best


@pytest.mark.parametrize("tokens", [["a ", "sys", "tem ", " pro", "mpt x", "y"], ["my instructions"], ["fine", " text"], [], ["x <con", "text>", "z"]])
def test_the_guard_is_that_of_the_growing_text(spark, tokens):
    import re

    text, sent = "", 0
    for t in tokens:
        text += t
        if re.search(answers.LEAKS, text):
            break
        sent += 1
    leaked = sent < len(tokens)
    assert tuple(one(spark, answers.guarded(F.col("t")), t=tokens)) == (sent, leaked, answers.FALLBACK if leaked else text)
