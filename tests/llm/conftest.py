"""Documents with the awkward cases: nulls, empty and long texts, repeated rows, clashing extra columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, section string, __x int"

BASE = "the quick brown fox jumps over the lazy dog while seven bright stars shine above quiet hills and rivers tonight"


def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = {1: None, 2: "", 3: " \n\t ", 4: "word", 5: BASE, 6: BASE, 7: BASE.upper(), 8: BASE + " extra", 9: long, 10: "\n".join([BASE] * 4), 11: "日本語 テキスト é́ ß x", 12: "12 34 !!"}
    rows = [(k, t, None, None, None, None, None, None, None) for k, t in texts.items()]
    return [*rows, rows[4], rows[4], (None, BASE + " other tail", "en", "s", 1, 0.0, 0, "x", 1), (None, None, "en", "s", 1, 0.0, 0, "x", 1)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
