"""R1 with its filters: each output of the dashboard, whose twin is the single operator's on the filtered postings.

R2 to R5 as one query each, all outputs of a report in one frame; the twins join the single operators' own twins.
"""

from __future__ import annotations

from hirelens import fixtures as X
from hirelens.fixtures import AS_OF, AS_OF_SQL, JOBS_SQL
from hirelens.operators import report_counts as RC
from hirelens.plans import q_distribution, q_trends  # noqa: F401  (their twins are used)
from hirelens.plans import reports as R
from hirelens.plans.catalog import SQL, register

MONTHS_BACK, KEYWORD = 36, "Python"
_LIST = ["job_no", "job_name", "company_name", "shelf_days"]
_GONE = ["jobNo", "jobName", "custName", "appear_dt", "delisted_dt", "shelf_days_before_delisting"]
#: output -> (twin, active postings only, columns)
OUTPUTS = {
    "latest_day_kpis": ("latest_day_kpis", False, None), "series_summary": ("series_summary", False, None),
    "trend_chart": ("trend_with_delisted", False, None), "industry_top10": ("industry_top10", True, None),
    "applicant_kpis": ("applicant_kpis", True, None), "applicant_histogram": ("applicant_histogram", True, None),
    "flag_ratios": ("flag_ratios", True, None), "long_unfilled": ("long_unfilled_topk", True, _LIST),
    "recent": ("dashboard_recent", True, _LIST), "delisted_kpis": ("delisted_kpis", False, None),
    "delisted_buckets": ("delisted_duration_buckets", False, None),
    "delisted_daily": ("delisted_daily_ma7", False, None), "delisted_monthly": ("delisted_monthly", False, None),
    "delisted_latest": ("delisted_sorted_latest", False, _GONE),
}


def _twin(name: str, active: bool) -> str:
    base = f"""WITH stored AS ({JOBS_SQL}), jobs AS (
  SELECT * FROM stored WHERE CAST(strptime(appearDate, '%Y%m%d') AS DATE) >= {AS_OF_SQL} - {30 * MONTHS_BACK}
  AND contains(lower(array_to_string(search_keyword, ' ')), '{KEYWORD.lower()}')
  {"AND status = 'active'" if active else ''})"""
    sql = SQL[name].replace(f"WITH jobs AS ({JOBS_SQL})", base, 1)
    # the headline total counts active postings, the series all
    return sql.replace("(SELECT count(*) FROM jobs) AS total_jobs",
                       "(SELECT count(*) FROM jobs WHERE status = 'active') AS total_jobs")


def _query(output: str, columns: list[str] | None):
    def q(spark, sf):
        report = R.dashboard(X.jobs_df(spark, sf), as_of=AS_OF, months=MONTHS_BACK, keywords=[KEYWORD])
        return report[output].select(*columns) if columns else report[output]
    return q


for _output, (_name, _active, _columns) in OUTPUTS.items():
    register(f"report_dashboard_{_output}", _twin(_name, _active))(_query(_output, _columns))


def _part(output: str, name: str, **columns: str) -> str:
    """Rows of one output from a single operator's twin, or from SQL."""
    fields = ", ".join(f"CAST({columns.get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in RC.KINDS.items() if c != "output")
    return f"SELECT '{output}' AS output, {fields} FROM ({SQL.get(name, name)}) p"


def _report(*parts: str) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


_MONTHS = f"""WITH d AS (SELECT CAST(strptime(appearDate, '%Y%m%d') AS DATE) AS a, TRY_CAST(delisted_date AS DATE) AS g FROM ({JOBS_SQL})),
e AS (SELECT a AS day, 1 AS new, 0 AS gone FROM d UNION ALL SELECT g, 0, 1 FROM d WHERE g IS NOT NULL),
m AS (SELECT day, sum(new) AS new, sum(gone) AS gone FROM e GROUP BY 1)
SELECT strftime(day, '%Y-%m') AS month, sum(new) AS new, sum(gone) AS gone, max(new) AS best FROM m GROUP BY 1"""


@register("report_daily_changes", _report(
    _part("day", "daily_job_changes", key="date", n="new_jobs", n2="removed_jobs", value="total_jobs", value2="new_delta"),
    _part("month", _MONTHS, key="month", n="new", n2="gone", value="best")))
def q_report_daily_changes(spark, sf):
    return RC.daily_changes(X.jobs_df(spark, sf))


@register("report_industry_trends", _report(
    f"""SELECT 'industry' AS output, s.industry AS key, NULL AS key2, s.job_count AS n, p.company_count AS n2, s.share_pct AS value,
               CAST(NULL AS DOUBLE) AS value2 FROM ({SQL["industry_share"]}) s JOIN ({SQL["industry_profile"]}) p USING (industry)""",
    f"""SELECT 'industry_month', c.industry, c.month, c.job_count, r.place, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
        FROM ({SQL["industry_month_counts"]}) c LEFT JOIN (
          SELECT industry, row_number() OVER (ORDER BY job_count DESC, industry) AS place FROM ({SQL["industry_month_counts"]}) l
          WHERE month = (SELECT max(month) FROM ({SQL["industry_month_counts"]}) x)
          QUALIFY place <= 5) r USING (industry)""",
    _part("growth", "industry_growth", key="industry", n="first_count", n2="last_count", value="growth_pct")))
def q_report_industry_trends(spark, sf):
    return RC.industry_trends(X.jobs_df(spark, sf))


@register("report_hiring_efficiency", _report(
    _part("shelf_days", "shelf_histogram", key="bin", n="job_count", value="bin_start", value2="bin_end"),
    _part("experience", "experience_applicants", key="experience", key2="apply_desc", n="job_count"),
    _part("education", "education_salary", key="education", key2="salary_desc", n="job_count"),
    _part("competition", "competition_level", key="competition", n="job_count"),
    _part("flags", "flag_ratios", key="'long_unfilled'", n="long_unfilled_count", n2="total", value="long_unfilled_ratio"),
    _part("flags", "flag_ratios", key="'recent'", n="recent_count", n2="total", value="recent_ratio")))
def q_report_hiring_efficiency(spark, sf):
    return RC.hiring_efficiency(X.jobs_df(spark, sf), AS_OF)


@register("report_salary_location", _report(
    _part("salary", "salary_labels", key="salary_desc", n="job_count"),
    f"""SELECT 'city', c.city, NULL, c.job_count, CAST(NULL AS BIGINT), m.lon, m.lat
        FROM ({SQL["city_counts"]}) c LEFT JOIN ({SQL["city_map"]}) m USING (city)""",
    _part("district", "district_top15", key="city", key2="district", n="job_count"),
    _part("city_salary", "city_salary_top10", key="city", key2="salary_desc", n="job_count"),
    _part("district_salary", "district_salary_top10", key="city_district", key2="salary_desc", n="job_count")))
def q_report_salary_location(spark, sf):
    return RC.salary_location(X.jobs_df(spark, sf))
