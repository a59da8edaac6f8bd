"""Every catalogue query against its SQL, run by DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpuslake.plans import catalogue


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for path in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tiny, oracle, name):
    df = catalogue.QUERIES[name](spark, tiny)
    got = rows(df.columns, df.collect())
    if name in catalogue.ORACLE:
        found = oracle.execute(catalogue.ORACLE[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, found.fetchall())
    else:
        assert got


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
