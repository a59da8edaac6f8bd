"""Generated lines: which quotes are around the whole, and which belong to the text."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslake.functions import text as X
from corpuslake.plans import storage
from corpuslake.plans import text as texts

LINES = [
    ('```\n"who resolves first"\n```', "Context: who resolves first."),
    ("'who resolves first'", "Context: who resolves first."),
    ('the token = "55cf1b56"', 'Context: the token = "55cf1b56".'),
    ('"who said "yes""', 'Context: who said "yes".'),
    ('"yes" he said to the "end', 'Context: "yes" he said to the "end.'),
    ('"', None),
]


def test_quotes_go_as_a_pair(spark):
    rows = spark.createDataFrame(list(enumerate(raw for raw, _ in LINES)), "n int, raw string")
    got = rows.select("n", X.context_line("raw").alias("line")).orderBy("n").collect()
    assert [r["line"] for r in got] == [line for _, line in LINES]


@pytest.mark.parametrize("name", ["resume_batches", "sanitize_lines"])
def test_texts_with_quotes_of_their_own_are_as_in_sql(spark, tmp_path, name):
    said = ['a secret is token = "55cf1b56"', '"quoted from end to end"', 'she said "no"', "it is the dogs'", "'single from end to end'", '"', "", None]
    rows = spark.createDataFrame([(i + 1, t) for i, t in enumerate(said)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = (m[name] for m in ({**storage.QUERIES, **texts.QUERIES}, {**storage.ORACLE, **texts.ORACLE}))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    got = query(spark, str(tmp_path)).select(*[F.col(f"`{c}`") for c in columns]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)
