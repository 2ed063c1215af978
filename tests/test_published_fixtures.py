"""Queries over the once-published derived tables give the same rows as deriving per query."""

import pytest

import oracle
from hirelens import fixtures as X
from hirelens.plans.catalog import oracle_sql, queries
from hirelens.session import scratch_path

NAMES = ["daily_job_changes", "day_over_day_diff", "industry_growth", "merged_keywords", "explode_responses",
         "lifecycle_sync", "analysis_projection", "link_urls_string", "crawl_log_upsert", "keyword_filter"]


@pytest.fixture(scope="module")
def published(spark, sf):
    X.publish_fixtures(spark, sf, scratch_path(spark, "fixtures"))
    yield
    X.unpublish_fixtures(sf)


@pytest.mark.parametrize("name", NAMES)
def test_published_matches_sql(spark, sf, published, name):
    df = queries()[name](spark, sf)
    assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()  # reads the published copy
    ok, msg = oracle.compare(df, oracle_sql()[name], sf)
    assert ok, msg
