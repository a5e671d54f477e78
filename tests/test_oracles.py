"""Every registered query against its DuckDB SQL at the smallest scale."""

import pytest
from oracle_check import compare, connect

from reviewloom.catalog import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_is_checked():
    assert set(SQL) == set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    problem, rows = compare(spark, con, queries()[name], SQL[name], SF_DIR)
    assert problem is None, problem
    assert rows > 0
