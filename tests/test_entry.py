"""Every query that has SQL gives what the SQL gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from folioflow import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or hasattr(v, "is_finite") else v


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = duck.sql(engine.SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert mine == theirs


def test_entry_and_names(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
