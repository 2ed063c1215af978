"""Structured Streaming ingest: landing JSON files -> versioned posting snapshots."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.session import scratch_path
from hirelens.sources.snapshots import complete_versions
from hirelens.streaming.ingest_stream import apply_batch, close_crawl_day, latest_snapshot, start_ingest_stream


def test_stream_builds_snapshot(spark, sf):
    landing = scratch_path(spark, "landing")
    snaps = scratch_path(spark, "snaps")
    ckpt = scratch_path(spark, "stream-ckpt")
    X.responses_df(spark, sf).write.json(landing)
    q = start_ingest_stream(spark, landing, snaps, ckpt)
    q.awaitTermination(300)
    snap = latest_snapshot(spark, snaps)
    assert snap is not None
    n = snap.count()
    assert n == snap.select("jobNo").distinct().count() > 0
    assert snap.where(F.col("discovery_date") != F.lit(dt.date(2001, 8, 2))).count() == 0
    assert snap.where(F.col("status") != "active").count() == 0


def _local(path: str) -> str:
    return path.replace("file:", "")


def _responses(spark, day, *ids):
    from hirelens.operators.ingest import RESPONSE_TYPE
    rows = [{"today": day, "keyword": "k", "page_key": k, "page_block": 0, "result": {"data": {"list": [
        {"jobNo": str(i), "jobName": f"job {i}"}]}}} for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, RESPONSE_TYPE)


def test_micro_batches_of_a_day_delist_nothing(spark):
    snaps = scratch_path(spark, "snaps3")
    apply_batch(spark, _responses(spark, "2024-05-01", 1, 2), snaps)
    apply_batch(spark, _responses(spark, "2024-05-01", 3), snaps)
    close_crawl_day(spark, snaps, dt.date(2024, 5, 1))
    first = latest_snapshot(spark, snaps)
    assert {r.jobNo: r.status for r in first.collect()} == {"1": "active", "2": "active", "3": "active"}
    apply_batch(spark, _responses(spark, "2024-05-02", 2), snaps)
    apply_batch(spark, _responses(spark, "2024-05-02", 4), snaps)
    close_crawl_day(spark, snaps, dt.date(2024, 5, 2))
    got = {r.jobNo: (r.status, r.delisted_date) for r in latest_snapshot(spark, snaps).collect()}
    assert got == {"1": ("inactive", "2024-05-02"), "2": ("active", None), "3": ("inactive", "2024-05-02"),
                   "4": ("active", None)}
    close_crawl_day(spark, snaps, dt.date(2024, 5, 3))  # an empty crawl delists nothing
    assert {r.jobNo: (r.status, r.delisted_date) for r in latest_snapshot(spark, snaps).collect()} == got


def test_only_complete_versions_count(spark):
    snaps = _local(scratch_path(spark, "snaps4"))
    assert latest_snapshot(spark, snaps) is None
    apply_batch(spark, _responses(spark, "2024-05-01", 1), snaps)
    os.makedirs(f"{snaps}/version=7")  # a write that never ended
    assert complete_versions(spark, snaps) == ["0"]
    path = apply_batch(spark, _responses(spark, "2024-05-01", 2), snaps)
    assert path.endswith("version=1") and latest_snapshot(spark, snaps).count() == 2
    with open(f"{snaps}/version=1/part-bad.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):  # a failing read is no empty state
        apply_batch(spark, _responses(spark, "2024-05-01", 3), snaps)


def test_fresh_checkpoint_goes_on(spark):
    landing, snaps = _local(scratch_path(spark, "landing5")), scratch_path(spark, "snaps5")
    for k in range(2):
        _responses(spark, "2024-05-01", 10 + k).coalesce(1).write.json(f"{landing}{k}")
        start_ingest_stream(spark, f"{landing}{k}", snaps, scratch_path(spark, "ckpt5")).awaitTermination(300)
    assert {r.jobNo for r in latest_snapshot(spark, snaps).collect()} == {"10", "11"}
