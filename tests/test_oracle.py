"""Each registered query with SQL, side by side with DuckDB on the smallest tables."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert plain([[r[c] for c in columns] for r in df.collect()]) == plain([[r[names.index(c)] for c in columns] for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, DATA).collect()) > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "messages", "original", "compressed", "saved"] and df.count() > 0
