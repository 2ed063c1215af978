"""What the plans move: rows are dealt narrow, a day's batch is dealt once, and inputs that several steps read are made once."""

import datetime as dt

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.operators import day_state as DS
from hirelens.operators import ingest as I
from hirelens.operators import lifecycle as L
from hirelens.plans import q_ingest, q_partial
from hirelens.plans.pipeline import run_crawl_day
from hirelens.plans.reports import daily_ingest
from hirelens.session import scratch_path
from hirelens.sources import snapshots as SN

DAY = dt.date(2001, 8, 2)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_pages_are_dealt_as_the_tables_columns(spark, sf):
    """no struct and no derived key goes through the shuffle by page, and there is one such shuffle."""
    lines = plan_of(I.fetch_stats(X.responses_df(spark, sf)))
    by_page = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(" in line and "l_suppkey" in line]
    assert len(by_page) == 1
    assert not any("struct(" in line or "named_struct" in line for line in lines[by_page[0] + 1:])
    assert not any("Exchange hashpartitioning(keyword" in line and "page_key" in line for line in lines)


def test_a_count_of_changes_moves_no_posting(spark, sf):
    """F25."""
    state = spark.createDataFrame([("1", "active")], "jobNo string, status string")
    lines = plan_of(daily_ingest(X.responses_df(spark, sf), state, as_of=DAY)["change_counts"])
    assert not any("min_by" in line for line in lines)


@pytest.mark.parametrize("kind", [I.RESPONSE_TYPE, I.OPEN_RESPONSE_TYPE], ids=["named", "open"])
def test_a_batch_is_dealt_by_posting_once(spark, kind, tmp_path):
    """F2, F8: the merged postings go to the snapshot's merge as they are dealt."""
    (tmp_path / "a.json").write_text('{"keyword":"k","page_key":1,"page_block":0,"result":{"data":{"list":'
                                     '[{"jobNo":"1","jobName":"a"},{"jobNo":2},{"jobNo":""},{"jobName":"x"}]}}}\n')
    batch = I.prepare_batch(spark.read.schema(kind).json(str(tmp_path)), DAY)
    assert sorted(r.jobNo for r in batch.collect()) == ["1", "2"]
    assert batch.columns[0] == "jobNo" and batch.columns.count("jobNo") == 1
    state = batch.withColumns({"status": F.lit("active"), "delisted_date": F.lit(None).cast("string"), "discovery_date": F.lit(DAY)}).limit(0)
    state = spark.createDataFrame([], state.drop("doc", "link").schema)
    merged = L.sync_snapshot(state, batch.drop("status", "last_update_date", "doc", "link"), DAY, nonempty=F.lit(True))
    assert sum("Exchange hashpartitioning(jobNo" in line for line in plan_of(merged.hint("merge"))) <= 4


def test_day_figures_keep_no_copy_of_the_merge(spark, sf, monkeypatch):
    """Nothing is persisted for the second write."""
    def refuse(*_):
        raise AssertionError("the merge is kept")

    monkeypatch.setattr(DataFrame, "persist", refuse)
    monkeypatch.setattr(DataFrame, "cache", refuse)
    path, snapshots, days = (scratch_path(spark, n) for n in ("responses", "snapshots", "days"))
    X.responses_df(spark, sf).write.json(path)
    for k in range(2):
        run_crawl_day(spark, path, snapshots, DAY + dt.timedelta(days=k), days_base=days)
    want = DS.day_state(SN.latest_snapshot(spark, snapshots))
    assert sorted(map(str, SN.latest_snapshot(spark, days).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_field_changes_of_repeated_and_missing_keys(spark):
    cols = "jobNo string, appearDate string, status string, delisted_date string"
    kept, a, b = ("1", "20010101", "active", None), ("1", "20010102", "active", None), (None, "20010103", "inactive", "2001-01-09")
    before = spark.createDataFrame([kept, kept, a, a, b], cols)
    after = spark.createDataFrame([kept, kept, b, b, b], cols)
    changes = DS.field_changes(before, after)
    assert {(r.old and r.old.appearDate, r.new and r.new.appearDate, r.n) for r in changes.collect()} == {
        ("20010102", None, 2), (None, "20010103", 2)}
    days = DS.apply_deltas(DS.day_state(before), DS.day_deltas(changes))
    assert sorted(map(str, days.collect())) == sorted(map(str, DS.day_state(after).select(days.columns).collect()))


def test_moved_pages_are_made_once(spark, sf):
    """the joins read stored pages, not the tables."""
    assert not any("lineitem" in f for f in q_ingest.q_matched_page_hits(spark, sf).inputFiles())


def test_a_published_day_is_derived_once(spark, sf):
    """the changed snapshot is made from the stored one."""
    jobs, _, _ = q_partial._changed_snapshot(spark, sf)
    assert not any("lineitem" in f or "orders" in f for f in jobs.inputFiles())
