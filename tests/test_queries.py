"""Every query with SQL, checked against DuckDB on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["i", "j", "value"] and df.count() == 16


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
