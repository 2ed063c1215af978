"""Daily trends: A1–A5, A17–A19, A23–A25, W1–W6, J7/U2 (day-over-day diff).

Pattern used throughout: aggregate postings to one row per day first
(hash aggregate with map-side partial counts — a hot day costs one counter,
not one task full of rows), then run the un-partitioned windows (running
totals, lags, moving averages) on the day-level rows only.  Global scalars
(first/last day) are scalar subqueries, not cross joins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens import constants as C
from hirelens.functions import parsing as P
from hirelens.functions.literals import literal_frame


def _lit_date(d) -> F.Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)))


def with_dates(jobs: DataFrame, date_column: str = "appearDate", date_format: str = "yyyyMMdd") -> DataFrame:
    """Add ``appear_dt`` (strict parse) and ``delisted_dt`` (lenient parse)."""
    out = jobs.withColumn("appear_dt", F.to_date(F.col(date_column), date_format))
    if "delisted_date" in jobs.columns:
        out = out.withColumn("delisted_dt", P.parse_date_lenient("delisted_date"))
    else:
        out = out.withColumn("delisted_dt", F.lit(None).cast("date"))
    return out


def day_counts(jobs: DataFrame, date_column: str = "appearDate", date_format: str = "yyyyMMdd") -> DataFrame:
    """A1 + A2 in one scan: (date, new_jobs, removed_jobs) for days present in data.

    Each posting contributes an appear event and, when it has a valid
    delisted date, a removal event; one aggregation counts both.
    """
    d = with_dates(jobs, date_column, date_format)
    ev = d.select(F.explode(F.array(
        F.struct(F.col("appear_dt").alias("date"), F.lit(1).alias("n"), F.lit(0).alias("r")),
        F.struct(F.col("delisted_dt").alias("date"), F.lit(0).alias("n"), F.lit(1).alias("r")))).alias("e"))
    return (ev.where(F.col("e.date").isNotNull())
            .groupBy(F.col("e.date").alias("date"))
            .agg(F.sum("e.n").cast("bigint").alias("new_jobs"),
                 F.sum("e.r").cast("bigint").alias("removed_jobs")))


def daily_job_changes(jobs: DataFrame, date_column: str = "appearDate",
                      date_format: str = "yyyyMMdd") -> DataFrame:
    """A3: contiguous calendar from the first appear day to the last appear or
    delisted day; new / removed per day (0-filled), running total (W1) and
    first differences (W2).
    """
    return fill_days(day_counts(jobs, date_column, date_format))


def fill_days(days: DataFrame) -> DataFrame:
    """A3 from the counts of the days present in the data (date, new_jobs, removed_jobs)."""
    w = Window.orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the postings are read once: each present day also yields the absent days up to the next present one
    days = days.select("*", F.min(F.when(F.col("new_jobs") > 0, F.col("date"))).over(whole).alias("first"),
                       F.lead("date").over(w).alias("next"))
    spans = days.select("*", F.explode(F.sequence("date", F.coalesce(F.date_sub("next", 1), "date"))).alias("day"))
    present = F.col("day") == F.col("date")
    full = spans.where(F.col("day") >= F.col("first")).select(
        F.col("day").alias("date"),
        *[F.when(present, F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c) for c in ("new_jobs", "removed_jobs")])
    return full.select(
        "date", "new_jobs", "removed_jobs",
        F.sum(F.col("new_jobs") - F.col("removed_jobs")).over(
            w.rowsBetween(Window.unboundedPreceding, 0)).alias("total_jobs"),
        (F.col("new_jobs") - F.lag("new_jobs").over(w)).alias("new_delta"),
        (F.col("removed_jobs") - F.lag("removed_jobs").over(w)).alias("removed_delta"))


def trend_stats(jobs: DataFrame) -> DataFrame:
    """A4: (date, total_jobs, new_jobs, removed_jobs=abs, net_change)."""
    d = daily_job_changes(jobs)
    return d.select("date", "total_jobs", "new_jobs", F.abs("removed_jobs").alias("removed_jobs"),
                    (F.col("new_jobs") - F.abs("removed_jobs")).alias("net_change"))


def filter_date_range(stats: DataFrame, date_range: str = "all", date_col: str = "date") -> DataFrame:
    """Keep rows within the last N days of the **max date in the data** (inclusive)."""
    n = C.DATE_RANGES.get(date_range)
    if n is None:
        return stats
    whole = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = stats.withColumn("_last", F.max(date_col).over(whole))  # day-level rows
    return out.where(F.col(date_col) >= F.date_sub("_last", n)).drop("_last")


def chart_data(stats: DataFrame, delisted: DataFrame | None = None) -> DataFrame:
    """P22 + W6 (+J3): net change and cumulative net over the given (filtered) rows."""
    out = stats
    if delisted is not None:
        out = out.join(delisted.select("date", "delisted_count"), "date", "left") \
                 .withColumn("delisted_count", F.coalesce("delisted_count", F.lit(0).cast("bigint")))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (out.withColumn("net_change", F.col("new_jobs") - F.col("removed_jobs"))
               .withColumn("cumulative_change", F.sum("net_change").over(w)))


def trend_last_days(jobs: DataFrame, date_range: str = "last_30_days") -> DataFrame:
    return chart_data(filter_date_range(trend_stats(jobs), date_range))


def series_summary(stats: DataFrame) -> DataFrame:
    """Sums of new / removed, net, first and last day (one row)."""
    return stats.agg(F.sum("new_jobs").cast("bigint").alias("sum_new"),
                     F.sum("removed_jobs").cast("bigint").alias("sum_removed"),
                     (F.sum("new_jobs") - F.sum("removed_jobs")).cast("bigint").alias("net"),
                     F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def latest_day_kpis(jobs: DataFrame, stats: DataFrame) -> DataFrame:
    """Total postings, and new / removed of the latest day in the series."""
    total = jobs.select(F.count(F.lit(1))).scalar()
    return stats.agg(F.max_by("new_jobs", "date").alias("latest_new"),
                     F.max_by("removed_jobs", "date").alias("latest_removed"),
                     F.max("date").alias("latest_date")) \
                .select(total.alias("total_jobs"), "latest_date", "latest_new", "latest_removed")


def daily_details(jobs: DataFrame) -> DataFrame:
    """A5 + W3 (day level): per present appear day the posting count, and the
    change vs the previous present day.  The per-day posting lists of the
    original are not collected (a day can hold billions of rows); the
    matching rows come from ``daily_detail_rows``.
    """
    d = with_dates(jobs)
    per_day = d.groupBy(F.col("appear_dt").alias("date")).agg(F.count("jobNo").alias("job_count"))
    w = Window.orderBy("date")
    return per_day.select("date", "job_count", F.col("job_count").alias("total_count"),
                          (F.col("job_count") - F.lag("job_count").over(w)).alias("count_diff"))


def daily_detail_rows(jobs: DataFrame) -> DataFrame:
    """A5 (posting level): each posting with its day's count / change."""
    d = with_dates(jobs)
    # a row per calendar day, so the postings are not shuffled by day
    return d.join(F.broadcast(daily_details(jobs).withColumnRenamed("date", "appear_dt")), "appear_dt", "inner")


def day_over_day_diff(jobs: DataFrame, selected_date=None) -> DataFrame:
    """W5 + J7 + J8 + U2: postings only on a day vs its previous present day.

    For every present appear day ``d`` with previous present day ``p``:
    ``only_curr`` = rows of ``d`` whose ``jobName|custName`` key is absent on
    ``p``; ``only_prev`` = rows of ``p`` whose key is absent on ``d``.
    Duplicate rows are kept; NULL keys never match and are excluded.

    All days at once, three shuffles: distinct (day, key) pairs (partial
    aggregation), a window per key ordered by day giving the key's previous
    and next day (at most one row per day per key, so a hot key is bounded
    by the calendar), and one join of the posting rows back to those flags.
    Day neighbours come from the day-level chain (one row per calendar day, broadcast).
    """
    d = with_dates(jobs).withColumn("pkey", P.posting_key()).where(F.col("pkey").isNotNull()) \
        .select(F.col("appear_dt").alias("day"), "pkey", "jobNo", "jobName", "custName")
    keys = d.select("day", "pkey").distinct()
    wk = Window.partitionBy("pkey").orderBy("day")
    chain_w = Window.orderBy("day")
    chain = keys.select("day").distinct().select(
        "day", F.lag("day").over(chain_w).alias("prev_day"), F.lead("day").over(chain_w).alias("next_day"))
    flags = (keys.select("day", "pkey", F.lag("day").over(wk).alias("key_prev"), F.lead("day").over(wk).alias("key_next"))
             .join(F.broadcast(chain), "day")
             .select("day", "pkey", "prev_day", "next_day",
                     (F.col("prev_day").isNotNull() & ~F.col("key_prev").eqNullSafe(F.col("prev_day"))).alias("is_new"),
                     (F.col("next_day").isNotNull() & ~F.col("key_next").eqNullSafe(F.col("next_day"))).alias("is_gone"))
             .where(F.col("is_new") | F.col("is_gone")))
    rows = d.join(flags, ["day", "pkey"])
    # One pass emits both kinds: a row can be new on its day and gone the next.
    sides = F.filter(F.array(
        F.when(F.col("is_new"), F.struct(F.lit("only_curr").alias("change"), F.col("day").alias("d"),
                                         F.col("prev_day").alias("p"))),
        F.when(F.col("is_gone"), F.struct(F.lit("only_prev").alias("change"), F.col("next_day").alias("d"),
                                          F.col("day").alias("p")))), lambda x: x.isNotNull())
    out = rows.select(F.explode(sides).alias("s"), "jobNo", "jobName", "custName", "pkey") \
        .select(F.col("s.change").alias("change"), F.col("s.d").alias("day"), F.col("s.p").alias("prev_day"),
                "jobNo", "jobName", "custName", F.col("pkey").alias("posting_key"))
    if selected_date is not None:
        out = out.where(F.col("day") == _lit_date(selected_date))
    return out


def previous_present_day(jobs: DataFrame) -> DataFrame:
    """Each present appear day and the previous present day (NULL for the first)."""
    days = with_dates(jobs).select(F.col("appear_dt").alias("day")).distinct()
    return days.select("day", F.lag("day").over(Window.orderBy("day")).alias("prev_day"))


def calendar_month(daily: DataFrame, month: str | None = None) -> DataFrame:
    """A25 + P14: calendar cells of the daily series.

    Per day: month label, weekday (Mon=0), week row within the month grid,
    month total and max of new_jobs, and the colour intensity
    ``min(0.2 + 0.8 * n / max(month_max, 1), 1)`` for days with n > 0.
    ``month`` (``yyyy-MM``) restricts to one month.
    """
    m = F.date_trunc("MONTH", F.col("date")).cast("date")
    out = daily.select("date", "new_jobs", m.alias("month_start"))
    if month is not None:
        out = out.where(F.col("month_start") == _lit_date(f"{month}-01"))
    wm = Window.partitionBy("month_start")
    first_wd = (F.dayofweek("month_start") + 5) % 7
    return out.select(
        "date", "new_jobs",
        F.date_format("month_start", C.MONTH_FORMAT).alias("month"),
        F.date_format("month_start", C.MONTH_LABEL_FORMAT).alias("month_label"),
        ((F.dayofweek("date") + 5) % 7).alias("weekday"),
        F.floor((F.dayofmonth("date") - 1 + first_wd) / 7).cast("int").alias("week_row"),
        F.sum("new_jobs").over(wm).cast("bigint").alias("month_total"),
        F.max("new_jobs").over(wm).alias("month_max"),
    ).withColumn("intensity", F.when(
        F.col("new_jobs") > 0,
        F.least(F.lit(0.2) + F.col("new_jobs") / F.greatest(F.col("month_max"), F.lit(1)) * F.lit(0.8), F.lit(1.0))))


def month_list(daily: DataFrame) -> DataFrame:
    """Months covered by the series, as labels (month picker)."""
    ends = daily.agg(F.date_trunc("MONTH", F.min("date")).cast("date").alias("first"),
                     F.date_trunc("MONTH", F.max("date")).cast("date").alias("last"))
    return ends.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("month_start")) \
        .select(F.date_format("month_start", C.MONTH_LABEL_FORMAT).alias("month_label"), "month_start")


def date_picker(jobs: DataFrame) -> DataFrame:
    """Distinct appear days, newest first."""
    return with_dates(jobs).select(F.col("appear_dt").alias("date")).distinct().orderBy(F.desc("date"))


# ---------------------------------------------------------------------------
# Delisted postings
# ---------------------------------------------------------------------------
def delisted(jobs: DataFrame) -> DataFrame:
    """P17 + F13: inactive postings with a valid delisted date, with shelf days before delisting."""
    d = with_dates(jobs)
    return (d.where((F.col("status") == C.STATUS_INACTIVE) & F.col("delisted_dt").isNotNull())
            .withColumn("shelf_days_before_delisting", P.shelf_days_before_delisting("delisted_dt", "appear_dt")))


def delisted_by_date(jobs: DataFrame, start=None, end=None) -> DataFrame:
    """A17 + P12: delisted count per day, within [start, end] when given."""
    out = delisted(jobs).groupBy(F.col("delisted_dt").alias("date")).agg(F.count(F.lit(1)).alias("delisted_count"))
    if start is not None:
        out = out.where(F.col("date") >= _lit_date(start))
    if end is not None:
        out = out.where(F.col("date") <= _lit_date(end))
    return out


def delisted_daily_ma7(jobs: DataFrame) -> DataFrame:
    """A18 + W4: daily delisted counts (present days) with a 7-row moving average."""
    daily = delisted_by_date(jobs)
    w = Window.orderBy("date").rowsBetween(-6, 0)
    return daily.withColumn("ma7", F.avg("delisted_count").over(w))


def delisted_monthly(jobs: DataFrame) -> DataFrame:
    """Delisted count per month (``yyyy-MM``)."""
    return (delisted(jobs).groupBy(F.date_format("delisted_dt", C.MONTH_FORMAT).alias("month"))
            .agg(F.count(F.lit(1)).alias("delisted_count")))


def delisted_duration_buckets(jobs: DataFrame) -> DataFrame:
    """Shelf-time buckets [0,7) [7,30) [30,90) [90,inf); negatives dropped;
    every bucket present (0 when empty), in bucket order.
    """
    s = F.col("shelf_days_before_delisting")
    e = C.DURATION_EDGES
    L = C.DURATION_LABELS
    bucket = (F.when(s < e[0], F.lit(None).cast("int"))
              .when(s < e[1], F.lit(0)).when(s < e[2], F.lit(1)).when(s < e[3], F.lit(2))
              .when(s >= e[3], F.lit(3)))
    counts = delisted(jobs).select(bucket.alias("bucket_order")).where(F.col("bucket_order").isNotNull()) \
        .groupBy("bucket_order").agg(F.count(F.lit(1)).alias("job_count"))
    dim = literal_frame(jobs.sparkSession, list(enumerate(L)), [("bucket_order", "int"), ("bucket", "string")])
    # counts has at most one row per bucket (4): the broadcast side is proven small
    return (dim.join(F.broadcast(counts), "bucket_order", "left")
            .select("bucket_order", "bucket", F.coalesce("job_count", F.lit(0).cast("bigint")).alias("job_count")))


def delisted_kpis(jobs: DataFrame, as_of) -> DataFrame:
    """A21 + P18: delisted count, mean shelf days before delisting, count in the last 30 days."""
    cut = F.date_sub(_lit_date(as_of), 30)
    return delisted(jobs).agg(
        F.count(F.lit(1)).alias("delisted_total"),
        F.avg("shelf_days_before_delisting").alias("avg_shelf_days"),
        F.count_if(F.col("delisted_dt") >= cut).alias("delisted_last_30_days"))


DELISTED_SORTS = {
    "latest": ("delisted_dt", False),
    "earliest": ("delisted_dt", True),
    "longest": ("shelf_days_before_delisting", False),
    "shortest": ("shelf_days_before_delisting", True),
}


def delisted_sorted(jobs: DataFrame, mode: str = "latest", k: int | None = 10) -> DataFrame:
    """Delisted postings in one of four orders (nulls last, jobNo tie-break); top ``k``."""
    col, asc = DELISTED_SORTS[mode]
    o = F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last()
    out = delisted(jobs).orderBy(o, F.col("jobNo").asc_nulls_last())
    return out.limit(k) if k else out
