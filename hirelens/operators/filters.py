"""Projections and predicates: P1–P24, U1.

All filters are Column predicates on the lazy plan, so Catalyst pushes the
simple ones (status, equality, dates on the published table) into the
Parquet scan and prunes unused columns.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens import constants as C
from hirelens.functions import parsing as P


def _lit_date(d) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)))


def equality_predicate(filters: dict | None) -> Column | None:
    """AND of ``col = value`` (None when no filter)."""
    if not filters:
        return None
    return functools.reduce(operator.and_, [F.col(c) == F.lit(v) for c, v in filters.items()])


def scan_jobs(jobs: DataFrame, filters: dict | None = None, limit: int | None = None,
              include_inactive: bool = False, order_by: list[str] | None = None) -> DataFrame:
    """Active-only unless asked, equality filters, optional limit.

    ``limit=None`` means no limit (the "no limit" option); ``order_by`` makes a
    limited scan deterministic.
    """
    out = jobs
    if not include_inactive:
        out = out.where(F.col("status") == C.STATUS_ACTIVE)
    pred = equality_predicate(filters)
    if pred is not None:
        out = out.where(pred)
    if order_by:
        out = out.orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    if limit:
        out = out.limit(int(limit))
    return out


def recent_jobs(jobs: DataFrame, months: int, as_of, date_column: str = "appearDate") -> DataFrame:
    """Appear date within the last ``30 * months`` days of ``as_of`` (inclusive)."""
    d = F.to_date(F.col(date_column), "yyyyMMdd")
    return jobs.where(d >= F.date_sub(_lit_date(as_of), 30 * int(months)))


def keyword_filter(jobs: DataFrame, keywords: list[str], regex: bool = False) -> DataFrame:
    """P4 (+F15): every keyword must occur (case-insensitive) in the space-joined
    ``search_keyword`` list.  Falls back to P5 when the column is missing.
    Keywords are literal substrings unless ``regex=True``.
    """
    kws = [k.lower() for k in keywords or [] if k]
    if not kws:
        return jobs
    if "search_keyword" in jobs.columns:
        dtype = dict(jobs.dtypes)["search_keyword"]
        kw = jobs["search_keyword"] if dtype.startswith("array") else P.as_keyword_array("search_keyword", "string")
        text = P.keywords_text(kw)
    else:
        text = keyword_text_fallback(jobs)
    preds = [text.rlike(k) if regex else text.contains(k) for k in kws]
    return jobs.where(functools.reduce(operator.and_, preds))


def keyword_text_fallback(jobs: DataFrame) -> Column:
    """P5 text: ``jobName + ' ' + jobDetail + ' ' + custName`` lower-cased.

    A NULL jobName makes the whole text NULL (no match), as in the original.
    """
    cols = jobs.columns
    if "jobName" in cols and "jobDetail" in cols:
        t = F.concat(F.col("jobName"), F.lit(" "), F.coalesce(F.col("jobDetail"), F.lit("")))
    elif "jobName" in cols:
        t = F.col("jobName")
    else:
        t = F.lit("")
    if "custName" in cols:
        t = F.concat(t, F.lit(" "), F.coalesce(F.col("custName"), F.lit("")))
    return F.lower(t)


def keyword_filter_text(jobs: DataFrame, keywords: list[str]) -> DataFrame:
    """P5 explicitly (ignores ``search_keyword``)."""
    text = keyword_text_fallback(jobs)
    kws = [k.lower() for k in keywords or [] if k]
    return jobs.where(functools.reduce(operator.and_, [text.contains(k) for k in kws])) if kws else jobs


def location_filter(jobs: DataFrame, city: str | None = None, district: str | None = None,
                    all_sentinel: str | None = None) -> DataFrame:
    """City / district equality; unset (or equal to ``all_sentinel``) means no filter."""
    out = jobs
    if city and city != all_sentinel and "city" in jobs.columns:
        out = out.where(F.col("city") == city)
    if district and district != all_sentinel and "district" in jobs.columns:
        out = out.where(F.col("district") == district)
    return out


def load_jobs(jobs: DataFrame, *, as_of, months: int | None = None, keywords: list[str] | None = None,
              city: str | None = None, district: str | None = None, include_inactive: bool = False,
              limit: int | None = None, limit_before_filter: bool = False) -> DataFrame:
    """S1 + P3..P6: the dashboard's data load.

    Default: filter first, then limit.  ``limit_before_filter=True`` gives the
    original's order (LIMIT on the scan, filters after it).
    """
    out = scan_jobs(jobs, include_inactive=include_inactive,
                    limit=limit if limit_before_filter else None)
    if months is not None:
        out = recent_jobs(out, months, as_of)
    if keywords:
        out = keyword_filter(out, keywords)
    out = location_filter(out, city, district)
    if limit and not limit_before_filter:
        out = out.limit(int(limit))
    return out


# ---------------------------------------------------------------------------
# Analysis projection
# ---------------------------------------------------------------------------
def analysis_projection(jobs: DataFrame, as_of) -> DataFrame:
    """P7 + P8 + P23: standard analysis columns with defaults for missing ones.

    shelf_days = days from appear date to ``as_of``; ``long_unfilled`` is
    shelf_days > 30, ``recent`` is shelf_days < 30 (30 itself is neither);
    both FALSE when the date is missing.
    """
    cols = set(jobs.columns)

    def has(c):
        return c in cols

    sel = [
        (F.col("jobNo") if has("jobNo") else F.monotonically_increasing_id().cast("string")).alias("job_no"),
        (F.col("jobName") if has("jobName") else F.lit(C.UNKNOWN_LABEL)).alias("job_name"),
        (F.col("custName") if has("custName") else F.lit(C.UNKNOWN_LABEL)).alias("company_name"),
        (F.col("city") if has("city") else F.lit(None).cast("string")).alias("city"),
        (F.col("district") if has("district") else F.lit(None).cast("string")).alias("district"),
        (F.col("search_keyword") if has("search_keyword") else F.array().cast("array<string>")).alias("keywords"),
    ]
    default_link = F.concat(F.lit(C.JOB_URL_BASE), F.col("jobNo")) if has("jobNo") else F.lit(None).cast("string")
    sel.append((F.coalesce(F.col("job"), default_link) if has("job") else default_link).alias("link"))
    for src, dst in (("applyDesc", "apply_desc"), ("salaryDesc", "salary_desc"),
                     ("periodDesc", "experience"), ("optionEdu", "education"),
                     ("coIndustryDesc", "industry"), ("status", "status"), ("delisted_date", "delisted_date")):
        if has(src):
            sel.append(F.col(src).alias(dst))
    out = jobs.select(*sel, *([F.to_date("appearDate", "yyyyMMdd").alias("appear_date")] if has("appearDate") else []))
    if has("appearDate"):
        days = F.datediff(_lit_date(as_of), F.col("appear_date"))
        out = (out.withColumn("shelf_days", days)
               .withColumn("long_unfilled", F.coalesce(days > C.LONG_UNFILLED_DAYS, F.lit(False)))
               .withColumn("recent", F.coalesce(days < C.RECENT_DAYS, F.lit(False))))
    return out


def display_projection(analysis: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The standard display columns that exist, in fixed order."""
    wanted = list(C.DISPLAY_COLUMNS) + list(extra or [])
    return analysis.select(*[c for c in wanted if c in analysis.columns])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """P10: required columns absent from the schema (driver-side, no job)."""
    return [c for c in required if c not in df.columns]


def with_display_labels(df: DataFrame) -> DataFrame:
    """Rename English columns to the original dashboard headers."""
    return df.select(*[F.col(c).alias(C.DISPLAY_LABELS.get(c, c)) for c in df.columns])


def selected_day_jobs(jobs: DataFrame, day, as_of) -> DataFrame:
    """Postings that appeared on one day, as display rows."""
    d = _lit_date(day)
    sel = jobs.where(F.to_date("appearDate", "yyyyMMdd") == d)
    return display_projection(analysis_projection(sel, as_of), extra=["job_no"])


def month_filter(df: DataFrame, month: str, date_col: str = "date") -> DataFrame:
    """Rows whose date falls in calendar month ``yyyy-MM``."""
    return df.where(F.date_trunc("MONTH", F.col(date_col)).cast("date") == _lit_date(f"{month}-01"))


def membership(df: DataFrame, col: str, values) -> DataFrame:
    """``col IN values`` (list) or semi join (DataFrame of one column)."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(v, col, "left_semi")
    return df.where(F.col(col).isin(list(values)))


def active_plus_inactive(active: DataFrame, other: DataFrame) -> DataFrame:
    """Active frame plus the inactive rows of a second frame, by column name."""
    return active.unionByName(other.where(F.col("status") == C.STATUS_INACTIVE), allowMissingColumns=True)


def incremental_slice(jobs: DataFrame, *, as_of, days_ago: int = 0, limit: int = 0) -> DataFrame:
    """``crawl_date >= as_of - days_ago`` when days_ago > 0; limit when > 0."""
    out = jobs
    if days_ago and days_ago > 0:
        out = out.where(F.col("crawl_date") >= F.date_sub(_lit_date(as_of), int(days_ago)))
    if limit and limit > 0:
        out = out.limit(int(limit))
    return out
