"""Every registered query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.check import check, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    verdict, _ = check(spark, con, small, name, QUERIES[name], SQL.get(name))
    assert verdict.startswith(("ok", "rows")), verdict


def test_all_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
