"""Composite reports R1–R6 run end to end and agree with the single operators."""

import datetime as dt

import pytest

from hirelens import fixtures as X
from hirelens.plans.catalog import queries
from hirelens.plans import reports as R


def _run_all(rep):
    return {k: v.count() for k, v in rep.items()}


def test_reports_run(spark, sf):
    jobs = X.jobs_df(spark, sf)
    r1 = _run_all(R.dashboard(jobs, as_of=X.AS_OF, months=120, keywords=["python"]))
    assert r1["series_summary"] == 1 and r1["delisted_buckets"] == 4
    r2 = _run_all(R.daily_changes(jobs, month="2001-07"))
    assert r2["daily"] >= r2["date_picker"] > 0
    r3 = _run_all(R.industry_trends(jobs, months=["2001-07"]))
    assert r3["profile"] == r3["growth"] > 0
    assert _run_all(R.hiring_efficiency(jobs, as_of=X.AS_OF))["competition"] > 0
    assert _run_all(R.salary_location(jobs))["city_counts"] > 0
    state = jobs.where("CAST(jobNo AS BIGINT) % 3 <> 0")
    r6 = R.daily_ingest(X.responses_df(spark, sf), state, as_of=X.AS_OF)
    counts = {r["change"]: r["n"] for r in r6["change_counts"].collect()}
    assert set(counts) <= {"new", "kept", "reactivated", "delisted", "untouched"}
    assert sum(counts.values()) == r6["snapshot"].count()


REPORTS = ["report_daily_changes", "report_industry_trends", "report_hiring_efficiency", "report_salary_location"]


@pytest.mark.parametrize("name", REPORTS)
def test_a_report_reads_the_postings_once(spark, sf, name):
    """One scan of each table and one Expand for the grouping sets, however many outputs."""
    plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("orders.parquet") == 1 and plan.count("customer.parquet") == 1, plan
    assert plan.count("Expand [") == 1 and "lineitem" not in plan


def test_reports_with_missing_values(spark):
    from hirelens.operators import report_counts as RC

    cols = "jobNo string, jobName string, custName string, coIndustryDesc string, appearDate string, delisted_date string, " \
           "salaryDesc string, applyDesc string, periodDesc string, optionEdu string, city string, district string, status string"
    rows = [("1", None, None, None, "20010101", None, None, None, None, None, None, None, None),
            ("2", "b", "c", "I", "20010103", "2001-01-05", "s", "0~5人應徵", "不拘", "大學", "台北市", None, "active"),
            ("3", "b", "c", "I", "20010205", "bad", "s", "大於30人應徵", None, "大學", "台北市", "大安區", "active")]
    jobs = spark.createDataFrame(rows, cols)
    days = {r.key: (r.n, r.n2, r.value) for r in RC.daily_changes(jobs).where("output = 'day'").collect()}
    assert len(days) == 36 and days["2001-01-02"] == (0, 0, 1.0) and days["2001-01-05"] == (0, 1, 1.0) and days["2001-02-05"][2] == 2.0
    months = {r.key: (r.n, r.n2, r.value) for r in RC.daily_changes(jobs).where("output = 'month'").collect()}
    assert months == {"2001-01": (2, 1, 1.0), "2001-02": (1, 0, 1.0)}
    industry = {(r.output, r.key, r.key2): (r.n, r.n2) for r in RC.industry_trends(jobs).collect()}
    assert industry == {("industry", "I", None): (2, 1), ("growth", "I", None): (1, 1),
                        ("industry_month", "I", "2001-01"): (1, 1), ("industry_month", "I", "2001-02"): (1, 1)}
    places = {(r.output, r.key, r.key2): r.n for r in RC.salary_location(jobs).collect()}
    assert places == {("salary", "s", None): 2, ("city", "台北市", None): 2, ("district", "台北市", "大安區"): 1,
                      ("city_salary", "台北市", "s"): 2, ("district_salary", "台北市-大安區", "s"): 1}
    found = RC.hiring_efficiency(jobs, dt.date(2001, 2, 10)).collect()
    assert sum(r.n for r in found if r.output == "shelf_days") == 3
    assert {(r.key, r.n, r.n2) for r in found if r.output == "flags"} == {("long_unfilled", 2, 3), ("recent", 1, 3)}
    for empty in (RC.daily_changes(jobs.limit(0)), RC.industry_trends(jobs.limit(0)), RC.salary_location(jobs.limit(0)),
                  RC.hiring_efficiency(jobs.limit(0), dt.date(2001, 2, 10))):
        assert empty.collect() == []
