"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from ravelin.queries import QUERIES, SQL
from tests.conftest import SMALL


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 4) if isinstance(x, int | float | Decimal) and not isinstance(x, bool) else str(x)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SMALL)
    expected = tables.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
