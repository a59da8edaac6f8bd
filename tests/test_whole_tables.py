"""Queries over all rows of their tables, on the larger of the test tables, and on rows that a cut would drop."""

from pathlib import Path

import duckdb
import pytest

from corpuslake.plans import catalogue
from tests.test_catalogue import rows


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same(spark, small, con, name):
    """The query's rows are those of its SQL."""
    df = catalogue.QUERIES[name](spark, small)
    found = con.execute(catalogue.ORACLE[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())


def test_merge_headings_reads_all_documents(spark, small, con):
    same(spark, small, con, "merge_headings")


def test_fts_and_match_asks_all_words(spark, small, con):
    same(spark, small, con, "fts_and_match")


def test_fts_or_keywords_asks_all_keywords(spark, small, con):
    same(spark, small, con, "fts_or_keywords")


def test_clause_split_takes_the_whole_text(spark, tmp_path):
    text = "word " * 100 + "end. next clause here"
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.part, r.num) for r in catalogue.QUERIES["clause_split"](spark, str(tmp_path)).collect())
    assert got == [(0, None), (1, "133.4.a"), (2, None)]


def test_family_complete_sees_all_documents(spark, small, con):
    same(spark, small, con, "family_complete")


def test_family_complete_keeps_queries_and_members_of_large_ids(spark, tmp_path):
    spark.createDataFrame([(600, [1.0, 0.0], 0), (601, [0.9, 0.1], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(600, "a"), (601, "a"), (701, "b"), *((k, "a") for k in range(702, 720))]
    spark.createDataFrame(docs, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["family_complete"](spark, str(tmp_path)).collect()
    assert [(r.query_id, r.context) for r in got] == [(600, "600,601,702,703,704")]


def test_errata_entries_reads_all_parts(spark, small, con):
    same(spark, small, con, "errata_entries")


def test_tag_token_join_reads_all_parts(spark, small, con):
    same(spark, small, con, "tag_token_join")


def test_refs_gained_lost_reads_all_orders(spark, small, con):
    same(spark, small, con, "refs_gained_lost")


def test_prompt_render_gives_every_item_a_prompt(spark, small, con):
    same(spark, small, con, "prompt_render")
    assert catalogue.QUERIES["prompt_render"](spark, small).count() == con.execute("SELECT count(*) FROM benchmark").fetchone()[0]


def test_prompt_render_keeps_items_without_documents(spark, tmp_path):
    spark.createDataFrame([(41, "some text", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a?"), (2, "b?"), (81, "c?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.chars for r in catalogue.QUERIES["prompt_render"](spark, str(tmp_path)).collect()}
    empty = len("<context>\n\n</context>\nQuestion: b?")
    assert got == {1: empty + len("[#1] some text"), 2: empty, 81: empty + len("[#1] some text")}


def test_card_mentions_ask_all_parts(spark, small, con):
    parts = con.execute("SELECT count(*) FROM part").fetchone()[0]
    assert parts > 400
    assert catalogue.QUERIES["card_mentions_exact"](spark, small).count() == parts
    assert catalogue.QUERIES["card_mentions_window"](spark, small).agg({"count": "sum"}).first()[0] >= parts


LONG = "unique zebra " + "filler words of a long document " * 100


@pytest.fixture
def long_documents(spark, tmp_path):
    docs = [(1, LONG, "en", len(LONG)), (2, "something short", "en", 15)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "filler document"), (1, "zebra?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["hyde_fuse", "rerank_stub"])
def test_long_documents_are_found(spark, long_documents, name):
    got = catalogue.QUERIES[name](spark, long_documents).collect()
    assert {r.query_id for r in got if r.chunk_id == 1} == {0, 1}


def test_route_hard_judges_long_documents(spark, small, con, long_documents):
    assert {r.doc_id for r in catalogue.QUERIES["route_hard"](spark, long_documents).collect()} == {1, 2}
    same(spark, small, con, "route_hard")


def test_hyde_fuse_runs_both_arms_and_the_fallback(spark):
    from pyspark.sql import functions as F

    from corpuslake.operators import ports

    rows = spark.createDataFrame([("abcdef",), ("abc",), ("",), (None,)], "q string")
    assert [r[0] for r in rows.select(ports.hypothetical(F.col("q"))).collect()] == ["def", "", "", ""]


def test_hyde_fuse_adds_the_passage_arm(spark, small):
    from pyspark.sql import functions as F

    even = {r.item_id for r in spark.read.parquet(f"{small}/benchmark.parquet").filter(F.length("text") % 2 == 0).collect()}
    got = catalogue.QUERIES["hyde_fuse"](spark, small).groupBy("query_id").agg(F.max("score").alias("best")).collect()
    both = {r.query_id for r in got if r.best > 1.05 / 61}
    assert both and both <= even and len(got) > len(even) > 0


def test_vector_normalize_dot_searches_every_fiftieth_row(spark, small, con):
    same(spark, small, con, "vector_normalize_dot")
