"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

LLM = ("op", "pipeline")
NAMES = [n for n in entry.queries() if not n.startswith(LLM)]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    rows = frame.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert frame.columns
        return
    twin = duck.sql(sql)
    assert sorted(frame.columns) == sorted(twin.columns)
    order = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    at = [twin.columns.index(c) for c in order]
    expected = sorted((tuple(plain(r[k]) for k in at) for r in twin.fetchall()), key=repr)
    assert got == expected
