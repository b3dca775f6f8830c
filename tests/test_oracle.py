"""Every registered query with SQL gives the same rows as the SQL."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    function, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert function(spark, SF).columns
        return
    assert compare(spark, con, function, sql, SF) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
