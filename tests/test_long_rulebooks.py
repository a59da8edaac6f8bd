"""Sections of very many rules are packed in time that grows with their text."""

import time

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import chunking


@pytest.mark.parametrize("title_flush", [True, False])
def test_a_section_of_many_rules(spark, title_flush):
    rules = 4000
    rule = lambda i: F.concat((i % 600 + 300).cast("string"), F.lit(". **Ti** some words of a rule "), i.cast("string"))
    text = F.concat(F.lit("## head\n\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(rules)), rule), "\n"))
    began = time.monotonic()
    found = chunking.chunks(spark.range(1).select("id", text.alias("text")), "rulebook", 512, 60, title_flush).orderBy("part").collect()
    assert time.monotonic() - began < 60
    kept = [line for r in found for line in r["content"].split("\n")[1:]]
    assert kept == [f"{i % 600 + 300}. **Ti** some words of a rule {i}" for i in range(1, rules + 1)]
    if title_flush:
        assert [r["section"] for r in found[:2]] == ["301. Ti", "302. Ti"] and len(found) == rules
    else:
        assert found[0]["section"] == "head — Rule 301: Ti" and all(len(r["content"]) < 4 * 62 for r in found)
