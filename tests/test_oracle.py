"""Every registered query against its DuckDB oracle on the smoke tables
(row count, columns and an order-insensitive value digest)."""

import datetime as dt
import decimal

import duckdb
import pytest

from places import SMOKE
from tidemark.registry import ORACLE_SQL, QUERIES
from tidemark.sources.testmap import TABLES


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMOKE)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE_SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert "active_scenario_count" in df.columns
