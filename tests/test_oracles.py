"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from loamworks.plans import corpus, edits, flows, routing, runs, voice  # noqa: F401
from loamworks.plans.registry import ORACLES, QUERIES

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(float(v)) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    have, expected = (sorted((tuple(plain(v) for v in r) for r in rs), key=repr) for rs in (rows, [[r[i] for i in at] for r in want.fetchall()]))
    assert have == expected


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert os.path.isdir(BASE)
