"""The registered queries against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from kindred.plans import catalogue

DATA = "/root/testdata/sf0.001"
FAST = [n for n in catalogue.QUERIES if n in catalogue.ORACLES]


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", FAST)
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, DATA)
    want = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted(repr([flat(r[c]) for c in sorted(columns)]) for r in got.collect())
    b = sorted(repr([flat(r[columns.index(c)]) for c in sorted(columns)]) for r in want.fetchall())
    assert a == b


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_entry(spark):
    assert "representative" in entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
