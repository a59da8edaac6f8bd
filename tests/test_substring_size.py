"""What a substring search broadcasts: patterns, never grams or rows, however small their files are."""

import re

import pytest

from corpuslake.operators import substring


@pytest.mark.parametrize("few", [10, 1])
def test_neither_grams_nor_rows_are_broadcast(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(substring, "FEW", few)
    spark.range(2000).selectExpr("id", "concat('name ', id) AS name").write.parquet(f"{tmp_path}/rows")
    patterns = spark.createDataFrame([(0, "e 19"), (1, "_77"), (2, None)], "ord int, pattern string")
    found = substring.containing(spark.read.parquet(f"{tmp_path}/rows"), patterns, "id", "name")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan
    assert not re.search(r"BroadcastHashJoin \[id#", plan)
    assert re.search(r"SortMergeJoin \[id#", plan)
    got = sorted((r["ord"], r["id"]) for r in found.collect())
    assert got == sorted([(0, n) for n in range(2000) if str(n).startswith("19")] + [(1, n) for n in range(2000) if re.search(".77", f"name {n}")])
