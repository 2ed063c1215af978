"""Registered trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.fixtures import AS_OF, AS_OF_SQL, with_jobs
from hirelens.operators import trends as T
from hirelens.plans.catalog import SQL, register

# Shared SQL pieces -----------------------------------------------------------
DATES = """, d AS (SELECT *, CAST(strptime(appearDate, '%Y%m%d') AS DATE) AS appear_dt,
                      TRY_CAST(delisted_date AS DATE) AS delisted_dt FROM jobs)"""

DAILY = DATES + """,
nw AS (SELECT appear_dt AS date, count(*) AS n FROM d GROUP BY 1),
rm AS (SELECT delisted_dt AS date, count(*) AS r FROM d WHERE delisted_dt IS NOT NULL GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series(
          CAST((SELECT min(appear_dt) FROM d) AS TIMESTAMP),
          CAST((SELECT greatest(max(appear_dt), coalesce(max(delisted_dt), max(appear_dt))) FROM d) AS TIMESTAMP),
          INTERVAL 1 DAY)) AS DATE) AS date),
f AS (SELECT sp.date, CAST(coalesce(nw.n, 0) AS BIGINT) AS new_jobs, CAST(coalesce(rm.r, 0) AS BIGINT) AS removed_jobs
      FROM sp LEFT JOIN nw ON sp.date = nw.date LEFT JOIN rm ON sp.date = rm.date),
daily AS (SELECT date, new_jobs, removed_jobs,
       CAST(sum(new_jobs - removed_jobs) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_jobs,
       new_jobs - lag(new_jobs) OVER (ORDER BY date) AS new_delta,
       removed_jobs - lag(removed_jobs) OVER (ORDER BY date) AS removed_delta
FROM f)"""

STATS = DAILY + """,
stats AS (SELECT date, total_jobs, new_jobs, abs(removed_jobs) AS removed_jobs, new_jobs - abs(removed_jobs) AS net_change FROM daily)"""

DELISTED = DATES + """,
dl AS (SELECT *, CAST(date_diff('day', appear_dt, delisted_dt) AS INTEGER) AS shelf_days_before_delisting
       FROM d WHERE status = 'inactive' AND delisted_dt IS NOT NULL)"""


def _cte(ctes: str, select: str) -> str:
    return with_jobs(ctes + "\n" + select)


@register("daily_job_changes", _cte(DAILY, "SELECT * FROM daily"))
def q_daily_job_changes(spark, sf):
    return T.daily_job_changes(X.jobs_df(spark, sf))


@register("trend_stats", _cte(STATS, "SELECT * FROM stats"))
def q_trend_stats(spark, sf):
    return T.trend_stats(X.jobs_df(spark, sf))


@register("series_summary", _cte(STATS, """
SELECT CAST(sum(new_jobs) AS BIGINT) AS sum_new, CAST(sum(removed_jobs) AS BIGINT) AS sum_removed,
       CAST(sum(new_jobs) - sum(removed_jobs) AS BIGINT) AS net, min(date) AS first_date, max(date) AS last_date
FROM stats"""))
def q_series_summary(spark, sf):
    return T.series_summary(T.trend_stats(X.jobs_df(spark, sf)))


@register("latest_day_kpis", _cte(STATS, """
SELECT (SELECT count(*) FROM jobs) AS total_jobs, max(date) AS latest_date,
       arg_max(new_jobs, date) AS latest_new, arg_max(removed_jobs, date) AS latest_removed
FROM stats"""))
def q_latest_day_kpis(spark, sf):
    jobs = X.jobs_df(spark, sf)
    return T.latest_day_kpis(jobs, T.trend_stats(jobs))


@register("daily_details", _cte(DATES, """,
pd AS (SELECT appear_dt AS date, count(jobNo) AS job_count FROM d GROUP BY 1)
SELECT date, job_count, job_count AS total_count, job_count - lag(job_count) OVER (ORDER BY date) AS count_diff FROM pd"""))
def q_daily_details(spark, sf):
    return T.daily_details(X.jobs_df(spark, sf))


@register("day_over_day_diff", _cte(DATES, """,
dk AS (SELECT *, jobName || '|' || custName AS pkey FROM d WHERE jobName IS NOT NULL AND custName IS NOT NULL),
days AS (SELECT DISTINCT appear_dt AS day FROM dk),
chain AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev_day FROM days),
ch AS (SELECT * FROM chain WHERE prev_day IS NOT NULL),
keys AS (SELECT DISTINCT appear_dt AS kday, pkey AS kkey FROM dk)
SELECT 'only_curr' AS change, ch.day, ch.prev_day, dk.jobNo, dk.jobName, dk.custName, dk.pkey AS posting_key
FROM dk JOIN ch ON dk.appear_dt = ch.day
WHERE NOT EXISTS (SELECT 1 FROM keys WHERE keys.kday = ch.prev_day AND keys.kkey = dk.pkey)
UNION ALL
SELECT 'only_prev' AS change, ch.day, ch.prev_day, dk.jobNo, dk.jobName, dk.custName, dk.pkey AS posting_key
FROM dk JOIN ch ON dk.appear_dt = ch.prev_day
WHERE NOT EXISTS (SELECT 1 FROM keys WHERE keys.kday = ch.day AND keys.kkey = dk.pkey)"""))
def q_day_over_day_diff(spark, sf):
    return T.day_over_day_diff(X.jobs_df(spark, sf))


@register("calendar_month", _cte(DAILY, """,
c AS (SELECT date, new_jobs, CAST(date_trunc('month', date) AS DATE) AS month_start FROM daily)
SELECT date, new_jobs, strftime(month_start, '%Y-%m') AS month, strftime(month_start, '%Y年%m月') AS month_label,
       CAST((dayofweek(date) + 6) % 7 AS INTEGER) AS weekday,
       CAST(floor((dayofmonth(date) - 1 + (dayofweek(month_start) + 6) % 7) / 7) AS INTEGER) AS week_row,
       CAST(sum(new_jobs) OVER (PARTITION BY month_start) AS BIGINT) AS month_total,
       max(new_jobs) OVER (PARTITION BY month_start) AS month_max,
       CASE WHEN new_jobs > 0 THEN least(0.2 + new_jobs / greatest(max(new_jobs) OVER (PARTITION BY month_start), 1) * 0.8, 1.0) END AS intensity
FROM c"""))
def q_calendar_month(spark, sf):
    return T.calendar_month(T.daily_job_changes(X.jobs_df(spark, sf)))


@register("date_picker", _cte(DATES, "SELECT DISTINCT appear_dt AS date FROM d"))
def q_date_picker(spark, sf):
    return T.date_picker(X.jobs_df(spark, sf))


@register("delisted_by_date", _cte(DELISTED, """
SELECT delisted_dt AS date, count(*) AS delisted_count FROM dl
WHERE delisted_dt BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1"""))
def q_delisted_by_date(spark, sf):
    return T.delisted_by_date(X.jobs_df(spark, sf), "1996-01-01", "2000-12-31")


@register("delisted_daily_ma7", _cte(DELISTED, """,
dd AS (SELECT delisted_dt AS date, count(*) AS delisted_count FROM dl GROUP BY 1)
SELECT date, delisted_count, avg(delisted_count) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7 FROM dd"""))
def q_delisted_daily_ma7(spark, sf):
    return T.delisted_daily_ma7(X.jobs_df(spark, sf))


@register("delisted_monthly", _cte(DELISTED, """
SELECT strftime(delisted_dt, '%Y-%m') AS month, count(*) AS delisted_count FROM dl GROUP BY 1"""))
def q_delisted_monthly(spark, sf):
    return T.delisted_monthly(X.jobs_df(spark, sf))


@register("delisted_duration_buckets", _cte(DELISTED, """,
b AS (SELECT CASE WHEN shelf_days_before_delisting < 0 THEN NULL WHEN shelf_days_before_delisting < 7 THEN 0
                  WHEN shelf_days_before_delisting < 30 THEN 1 WHEN shelf_days_before_delisting < 90 THEN 2 ELSE 3 END AS bucket_order
      FROM dl),
cnt AS (SELECT bucket_order, count(*) AS job_count FROM b WHERE bucket_order IS NOT NULL GROUP BY 1),
dim AS (SELECT * FROM (VALUES (0, '少於7天'), (1, '7-30天'), (2, '30-90天'), (3, '超過90天')) t(bucket_order, bucket))
SELECT CAST(dim.bucket_order AS INTEGER) AS bucket_order, dim.bucket, CAST(coalesce(cnt.job_count, 0) AS BIGINT) AS job_count
FROM dim LEFT JOIN cnt ON dim.bucket_order = cnt.bucket_order"""))
def q_delisted_duration_buckets(spark, sf):
    return T.delisted_duration_buckets(X.jobs_df(spark, sf))


@register("delisted_kpis", _cte(DELISTED, f"""
SELECT count(*) AS delisted_total, avg(shelf_days_before_delisting) AS avg_shelf_days,
       count(*) FILTER (WHERE delisted_dt >= {AS_OF_SQL} - 30) AS delisted_last_30_days FROM dl"""))
def q_delisted_kpis(spark, sf):
    return T.delisted_kpis(X.jobs_df(spark, sf), AS_OF)


@register("delisted_sorted", _cte(DELISTED, """
SELECT jobNo, jobName, custName, appear_dt, delisted_dt, shelf_days_before_delisting FROM dl
ORDER BY shelf_days_before_delisting DESC NULLS LAST, jobNo ASC NULLS LAST LIMIT 10"""))
def q_delisted_sorted(spark, sf):
    return T.delisted_sorted(X.jobs_df(spark, sf), "longest", 10).select(
        "jobNo", "jobName", "custName", "appear_dt", "delisted_dt", "shelf_days_before_delisting")


@register("daily_detail_rows", _cte(DATES, """,
pd AS (SELECT appear_dt AS date, count(jobNo) AS job_count FROM d GROUP BY 1),
dd AS (SELECT date, job_count, job_count - lag(job_count) OVER (ORDER BY date) AS count_diff FROM pd)
SELECT d.appear_dt, d.jobNo, d.jobName, d.custName, d.job, d.city, d.district,
       array_to_string(d.search_keyword, '|') AS search_keyword, dd.job_count, dd.count_diff
FROM d JOIN dd ON d.appear_dt = dd.date"""))
def q_daily_detail_rows(spark, sf):
    return T.daily_detail_rows(X.jobs_df(spark, sf)).select(
        "appear_dt", "jobNo", "jobName", "custName", "job", "city", "district",
        F.array_join("search_keyword", "|").alias("search_keyword"), "job_count", "count_diff")


@register("trend_with_delisted", _cte(STATS + """,
dl AS (SELECT delisted_dt AS date, count(*) AS delisted_count FROM d
       WHERE status = 'inactive' AND delisted_dt IS NOT NULL GROUP BY 1)""", """
SELECT s.date, s.total_jobs, s.new_jobs, s.removed_jobs, CAST(coalesce(dl.delisted_count, 0) AS BIGINT) AS delisted_count,
       s.new_jobs - s.removed_jobs AS net_change,
       CAST(sum(s.new_jobs - s.removed_jobs) OVER (ORDER BY s.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS cumulative_change
FROM stats s LEFT JOIN dl ON s.date = dl.date"""))
def q_trend_with_delisted(spark, sf):
    jobs = X.jobs_df(spark, sf)
    return T.chart_data(T.trend_stats(jobs), T.delisted_by_date(jobs))


@register("previous_present_day", _cte(DATES, """
SELECT day, lag(day) OVER (ORDER BY day) AS prev_day FROM (SELECT DISTINCT appear_dt AS day FROM d)"""))
def q_previous_present_day(spark, sf):
    return T.previous_present_day(X.jobs_df(spark, sf))


@register("month_list", _cte(DAILY, """
SELECT strftime(m, '%Y年%m月') AS month_label, CAST(m AS DATE) AS month_start
FROM (SELECT unnest(generate_series(CAST(date_trunc('month', (SELECT min(date) FROM daily)) AS TIMESTAMP),
                                    CAST(date_trunc('month', (SELECT max(date) FROM daily)) AS TIMESTAMP),
                                    INTERVAL 1 MONTH)) AS m)"""))
def q_month_list(spark, sf):
    return T.month_list(T.daily_job_changes(X.jobs_df(spark, sf)))


def _delisted_mode_sql(order: str) -> str:
    return _cte(DELISTED, f"""
SELECT jobNo, jobName, custName, appear_dt, delisted_dt, shelf_days_before_delisting FROM dl
ORDER BY {order}, jobNo ASC NULLS LAST LIMIT 10""")


def _delisted_mode_query(mode: str):
    def q(spark, sf):
        return T.delisted_sorted(X.jobs_df(spark, sf), mode, 10).select(
            "jobNo", "jobName", "custName", "appear_dt", "delisted_dt", "shelf_days_before_delisting")
    return q


for _mode, _order in (("latest", "delisted_dt DESC NULLS LAST"), ("earliest", "delisted_dt ASC NULLS LAST"),
                      ("shortest", "shelf_days_before_delisting ASC NULLS LAST")):
    register(f"delisted_sorted_{_mode}", _delisted_mode_sql(_order))(_delisted_mode_query(_mode))


def _trend_range_sql(days: int) -> str:
    return _cte(STATS, f""",
flt AS (SELECT * FROM stats WHERE date >= (SELECT max(date) FROM stats) - {days})
SELECT date, total_jobs, new_jobs, removed_jobs, new_jobs - removed_jobs AS net_change,
       CAST(sum(new_jobs - removed_jobs) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_change
FROM flt""")


def _trend_range_query(rng: str):
    def q(spark, sf):
        return T.trend_last_days(X.jobs_df(spark, sf), rng)
    return q


for _days in (7, 30, 90):
    register(f"trend_last_{_days}_days", _trend_range_sql(_days))(_trend_range_query(f"last_{_days}_days"))


@register("calendar_one_month", f"SELECT * FROM ({SQL['calendar_month']}) WHERE month = '2001-06'")
def q_calendar_one_month(spark, sf):
    """A25 + P14: the calendar of one month."""
    return T.calendar_month(T.daily_job_changes(X.jobs_df(spark, sf)), "2001-06")
