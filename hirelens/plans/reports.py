"""Composite reports R1–R6: what a dashboard page or the daily batch asks for.

Each report returns a dict of lazy DataFrames sharing one filtered base.
At scale, call ``base.persist()`` (or publish it) before running several
outputs of a report; nothing here collects rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from hirelens.operators import distribution as D
from hirelens.operators import filters as FL
from hirelens.operators import ingest as I
from hirelens.operators import lifecycle as L
from hirelens.operators import trends as T


def dashboard(jobs: DataFrame, *, as_of, months=None, keywords=None, city=None, district=None,
              date_range: str = "all", top_k: int = 10, parity: bool = False) -> dict[str, DataFrame]:
    """KPIs, trend chart, industry top 10, applicants, shelf-time flags, delisted analysis.

    Default (decision for quirk Q9): trend and delisted outputs use the same
    filters and include inactive postings.  ``parity=True`` reproduces the
    original: the trend sees active postings only, and delisted counts come
    from the unfiltered table.
    """
    base = FL.load_jobs(jobs, as_of=as_of, months=months, keywords=keywords, city=city, district=district,
                        include_inactive=True)
    active = FL.scan_jobs(base)
    stats = T.trend_stats(active if parity else base)
    delisted_src = jobs if parity else base
    analysis = FL.analysis_projection(active, as_of)
    return {
        "latest_day_kpis": T.latest_day_kpis(active, stats),
        "series_summary": T.series_summary(stats),
        "trend_chart": T.chart_data(T.filter_date_range(stats, date_range), T.delisted_by_date(delisted_src)),
        "industry_top10": D.top_n(D.industry_share(active), 10),
        "applicant_kpis": D.applicant_kpis(active),
        "applicant_histogram": D.applicant_histogram(active),
        "flag_ratios": D.flag_ratios(analysis),
        "long_unfilled": D.long_unfilled_topk(analysis, top_k),
        "recent": D.recent_postings(analysis, top_k, longest_first=True),
        "delisted_kpis": T.delisted_kpis(delisted_src, as_of),
        "delisted_buckets": T.delisted_duration_buckets(delisted_src),
        "delisted_daily": T.delisted_daily_ma7(delisted_src),
        "delisted_monthly": T.delisted_monthly(delisted_src),
        "delisted_latest": T.delisted_sorted(delisted_src, "latest", top_k),
    }


def daily_changes(jobs: DataFrame, *, selected_date=None, month: str | None = None) -> dict[str, DataFrame]:
    """R2: daily series, calendar, per-day details and day-over-day diff."""
    daily = T.daily_job_changes(jobs)
    return {
        "daily": daily,
        "calendar": T.calendar_month(daily, month),
        "months": T.month_list(daily),
        "details": T.daily_details(jobs),
        "day_over_day": T.day_over_day_diff(jobs, selected_date),
        "date_picker": T.date_picker(jobs),
    }


def industry_trends(jobs: DataFrame, *, months: list[str] | None = None) -> dict[str, DataFrame]:
    """Industry profile, monthly counts (long; wide when months given), growth, top-5 trend."""
    out = {
        "profile": D.industry_profile(jobs),
        "job_names": D.industry_job_names(jobs),
        "month_counts": D.industry_month_counts(jobs),
        "growth": D.industry_growth(jobs),
        "top5_trend": D.top_industry_trend(jobs, 5),
    }
    if months:
        out["month_wide"] = D.industry_month_wide(jobs, months)
    return out


def hiring_efficiency(jobs: DataFrame, *, as_of) -> dict[str, DataFrame]:
    """Shelf-day histogram, crosstabs, competition levels, long-unfilled / recent lists."""
    analysis = FL.analysis_projection(jobs, as_of)
    return {
        "shelf_histogram": D.histogram(analysis, "shelf_days"),
        "experience_applicants": D.experience_applicants(jobs),
        "competition": D.competition_counts(jobs),
        "education_salary": D.education_salary(jobs),
        "long_unfilled": D.long_unfilled_topk(analysis, None),
        "recent": D.recent_postings(analysis, None),
    }


def salary_location(jobs: DataFrame) -> dict[str, DataFrame]:
    """Salary labels, city / district counts, salary crosstabs, city map."""
    return {
        "salary_labels": D.salary_labels(jobs),
        "city_counts": D.city_counts(jobs),
        "district_top15": D.district_top(jobs, 15),
        "city_salary_top10": D.city_salary_top(jobs, 10),
        "district_salary_top10": D.district_salary_top(jobs, 10, 15),
        "city_map": D.city_map(jobs),
    }


def daily_ingest(responses: DataFrame, state: DataFrame, *, as_of) -> dict[str, DataFrame]:
    """One crawl day — response classes, fetch stats, posting batch, next snapshot."""
    batch = I.prepare_batch(responses, as_of)
    snapshot = L.sync_snapshot(state, batch.drop("status", "last_update_date"), as_of)
    return {
        "response_classes": I.response_classes(responses),
        "fetch_stats": I.fetch_stats(responses),
        "batch": batch,
        "snapshot": snapshot,
        "change_counts": L.change_counts(snapshot),
    }
