"""Every registered query against its DuckDB SQL twin (the driver's gate, at sf0.001)."""

import pytest

import oracle
from hirelens.plans.catalog import oracle_sql, queries

QUERIES = queries()
SQL = oracle_sql()


def test_every_query_has_sql_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    ok, msg = oracle.compare(QUERIES[name](spark, sf), SQL[name], sf)
    assert ok, f"{name}: {msg}"
