"""Every query of the engine against its SQL twin on the smallest tables."""

import pytest

from graphloom import queries

from .compare import connection, difference

FOLDER = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert not difference(queries.queries()[name](spark, FOLDER), con, SQL[name])
