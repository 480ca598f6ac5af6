"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", CORE)
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


@pytest.fixture(scope="module")
def larger():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_sql_has_rows(larger, name):
    """No comparison is one of nothing with nothing."""
    found = larger.execute(entry.oracle_sql()[name]).fetchall()
    assert found and any(v not in (None, "", 0) for r in found for v in r)


def test_entry(spark):
    assert entry.entry(spark).columns == ["email", "password"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
