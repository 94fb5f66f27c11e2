"""Every query with SQL against DuckDB on the smallest tables, and the shape of the entry points."""

import math
import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else repr(float(v))
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect()) == wanted


def test_entry_points(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
