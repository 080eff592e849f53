"""Every registered query against its SQL oracle on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare, oracle_connection

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None
    assert rows >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
