"""Every query with SQL gives what the SQL gives, on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from marketloom.plans.oracles import ORACLES
from marketloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in ("events", "lineitem", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert got or name in ("risk_alert", "agg_recent_24h", "flt_rsi_overbought")
    if name not in ORACLES:
        return
    r = db.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = [tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()]
    close = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-7 * max(abs(a), abs(b))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert all(map(close, a, b)), (a, b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["account_id", "symbol", "realized_pnl"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
