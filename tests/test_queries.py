"""Every named query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_equal_to_sql(spark, con, key):
    assert difference(QUERIES[key](spark, FOLDER), con, ORACLE[key]) == ""


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, key):
    assert QUERIES[key](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
