"""Queries without bounds on ids answer for every row of their tables."""

import pytest

from graphloom import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,table,key", [("call_aggregate", "customer", "c_custkey"), ("list_comprehension", "lineitem", "l_orderkey"), ("set_properties", "supplier", "s_suppkey"), ("call_top_per_row", "orders", "o_custkey")])
def test_every_row_is_asked(spark, name, table, key):
    expected = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).distinct().collect()}
    assert {r.k for r in queries.queries()[f"{name}_whole"](spark, FOLDER).collect()} == expected
    assert f"{name}_whole" in queries.oracle_sql()
