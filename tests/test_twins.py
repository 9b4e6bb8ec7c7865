"""Every query that SQL can express, against its twin on the smallest data set."""

import pytest
from twins import compare, duck

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, con, name):
    assert compare(QUERIES[name](spark, small), con, SQL[name]) == ""


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert "PropDead" in df.columns
