import os

import duckdb
import pytest

import __spark_entry__
from gridloom import catalogue


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, tables, name):
    got = catalogue.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    want = tables.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted(tuple(r[names.index(c)] for c in cols) for r in want.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["i0", "key"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_sql(spark, data):
    assert {r["kind"] for r in catalogue.QUERIES["t4_trace"](spark, data).collect()} == {"array", "launch"}
    assert catalogue.QUERIES["k17_events"](spark, data).count() == 4
