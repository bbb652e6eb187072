"""Every registered query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
RUNS, SQLS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(os.path.join(FOLDER, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def test_every_sql_twin_has_a_query():
    assert set(SQLS) <= set(RUNS)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, db, name):
    df = RUNS[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    assert got
    if name in SQLS:
        cur = db.execute(SQLS[name])
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 12
