"""Two crawl days through the batch pipeline: files in, versioned snapshots out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.plans.pipeline import publish_news_jobs, run_crawl_day
from hirelens.session import scratch_path


def test_two_crawl_days(spark, sf):
    responses = X.responses_df(spark, sf)
    day1, day2 = scratch_path(spark, "day1"), scratch_path(spark, "day2")
    responses.write.json(day1)
    # Day 2 re-fetches only half of the pages: postings seen only on the other half get delisted.
    responses.where(F.col("page_key") % 2 == 0).withColumn("today", F.lit("2001-08-03")).write.json(day2)
    snaps = scratch_path(spark, "snapshots")
    p1 = run_crawl_day(spark, day1, snaps, dt.date(2001, 8, 2))
    p2 = run_crawl_day(spark, day2, snaps, dt.date(2001, 8, 3))
    s1, s2 = spark.read.parquet(p1), spark.read.parquet(p2)
    assert s1.count() == s2.count() == s1.select("jobNo").distinct().count()
    delisted = s2.where("status = 'inactive'")
    assert delisted.count() > 0
    assert delisted.where(F.col("delisted_date") != "2001-08-03").count() == 0
    seen2 = responses.where((F.col("page_key") % 2 == 0) & (F.col("page_key") % 29 != 0)) \
        .select(F.explode("result.data.list.jobNo").alias("jobNo")).where("jobNo IS NOT NULL").distinct()
    assert s2.where("status = 'active'").join(seen2, "jobNo", "left_anti").count() == 0
    path, rows = publish_news_jobs(spark, p2, scratch_path(spark, "news"), as_of=dt.date(2001, 8, 3))
    assert rows == s2.count()


def test_publish_modes(spark, sf):
    jobs = X.jobs_df(spark, sf).drop("search_keyword")
    snap = scratch_path(spark, "snap")
    jobs.write.parquet(snap)
    base = scratch_path(spark, "published")
    full, n_full = publish_news_jobs(spark, snap, base, as_of=X.AS_OF, version="1")
    part, n_part = publish_news_jobs(spark, snap, base, as_of=X.AS_OF, days_ago=2, mode="replace", version="2")
    up, n_up = publish_news_jobs(spark, snap, base, as_of=X.AS_OF, days_ago=2, previous=full, version="3")
    assert n_full == jobs.count() and 0 < n_part < n_full and n_up == n_full
    again, n_again = publish_news_jobs(spark, snap, base, as_of=X.AS_OF, days_ago=2, version="4")
    assert n_again == n_full  # upserts into the newest complete version
    _, few = publish_news_jobs(spark, snap, base, as_of=X.AS_OF, limit=7, version="5")
    assert few == 7
    with pytest.raises(ValueError):
        publish_news_jobs(spark, snap, scratch_path(spark, "none"), as_of=X.AS_OF, days_ago=2)


def test_dashboard_parity_flag(spark, sf):
    from hirelens.plans.reports import dashboard
    jobs = X.jobs_df(spark, sf)
    default = dashboard(jobs, as_of=X.AS_OF)["series_summary"].first()
    parity = dashboard(jobs, as_of=X.AS_OF, parity=True)["series_summary"].first()
    assert default["sum_removed"] > 0
    assert parity["sum_new"] < default["sum_new"]


def test_bucketed_days_give_the_same_snapshots(spark, sf):
    """Two days with bucketed snapshots: same rows as plain ones, and the second merge doesn't shuffle the stored side."""
    from hirelens.operators.ingest import RESPONSE_TYPE, prepare_batch
    from hirelens.operators.lifecycle import sync_snapshot
    from hirelens.sources.snapshots import latest_snapshot

    responses = X.responses_df(spark, sf)
    day1, day2 = scratch_path(spark, "day1"), scratch_path(spark, "day2")
    responses.write.json(day1)
    responses.where(F.col("page_key") % 2 == 0).withColumn("today", F.lit("2001-08-03")).write.json(day2)
    found = {}
    for buckets in (None, 5):
        snaps = scratch_path(spark, "snapshots")
        run_crawl_day(spark, day1, snaps, dt.date(2001, 8, 2), buckets=buckets)
        run_crawl_day(spark, day2, snaps, dt.date(2001, 8, 3), buckets=buckets)
        found[buckets] = latest_snapshot(spark, snaps)
    rows = {b: df.withColumn("doc", F.to_json("doc")) for b, df in found.items()}  # Spark can't compare VARIANT values
    assert rows[5].count() == rows[None].count() > 0
    assert rows[5].select(rows[None].columns).exceptAll(rows[None]).isEmpty()

    batch = prepare_batch(spark.read.schema(RESPONSE_TYPE).json(day2), dt.date(2001, 8, 4)).drop("status", "last_update_date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # inspect the static plan
    try:
        merged = sync_snapshot(found[5], batch, dt.date(2001, 8, 4), nonempty=F.lit(True))
        lines = merged._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scan = next(k for k, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line)
    join = max(k for k, line in enumerate(lines[:scan]) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in lines[join:scan]), lines
