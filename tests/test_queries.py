import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(set(entry.oracle_sql()))


def plain(value):
    return f"{float(value):.6g}" if isinstance(value, float) or type(value).__name__ == "Decimal" else str(value)


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, base, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    told = base.sql(entry.oracle_sql()[name])
    assert sorted(told.columns) == columns
    places = [told.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in places) for r in told.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
