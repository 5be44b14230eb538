"""Every query with SQL gives the same rows in both engines."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sf_dir, con, name):
    assert difference(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) is None


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "status", "n_hits", "context", "prompt"]
    assert df.count() > 0
