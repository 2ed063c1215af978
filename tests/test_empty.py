"""Every registered query on empty tables (same schemas, zero rows): no failure."""

import pytest

from hirelens.plans.catalog import queries
from hirelens.session import scratch_path

QUERIES = queries()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def empty_dir(spark, sf):
    path = scratch_path(spark, "empty-tables")
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty_dir, name):
    QUERIES[name](spark, empty_dir).write.format("noop").mode("overwrite").save()
