"""Every query with an oracle equals DuckDB on sf0.001 (row count, column
names, order-insensitive value hash)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle_check import compare, duck

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    assert compare(spark, name, QUERIES[name], SQL[name], SMALL, con, verbose=True)
