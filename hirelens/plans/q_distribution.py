"""Registered distribution queries."""

from __future__ import annotations

from hirelens import fixtures as X
from hirelens.fixtures import AS_OF, with_jobs
from hirelens.operators import distribution as D
from hirelens.operators import filters as FL
from hirelens.plans import sqlfrag as S
from hirelens.plans.catalog import register


def _q(body: str) -> str:
    return with_jobs(body)


MONTHS = """, m AS (SELECT *, strftime(CAST(strptime(appearDate, '%Y%m%d') AS DATE), '%Y-%m') AS month
               FROM jobs WHERE coIndustryDesc IS NOT NULL)"""


@register("industry_share", _q("""
SELECT coIndustryDesc AS industry, count(*) AS job_count,
       count(*) / (SELECT count(*) FROM jobs) * 100.0 AS share_pct
FROM jobs WHERE coIndustryDesc IS NOT NULL GROUP BY 1"""))
def q_industry_share(spark, sf):
    return D.industry_share(X.jobs_df(spark, sf))


@register("industry_top10", _q("""
SELECT coIndustryDesc AS industry, count(*) AS job_count,
       count(*) / (SELECT count(*) FROM jobs) * 100.0 AS share_pct
FROM jobs WHERE coIndustryDesc IS NOT NULL GROUP BY 1 ORDER BY job_count DESC, industry LIMIT 10"""))
def q_industry_top10(spark, sf):
    return D.top_n(D.industry_share(X.jobs_df(spark, sf)), 10)


@register("industry_profile", _q("""
SELECT coIndustryDesc AS industry, count(jobNo) AS job_count, count(DISTINCT custName) AS company_count
FROM jobs WHERE coIndustryDesc IS NOT NULL GROUP BY 1"""))
def q_industry_profile(spark, sf):
    return D.industry_profile(X.jobs_df(spark, sf))


@register("industry_job_names", _q("""
SELECT coIndustryDesc AS industry, jobName AS job_name, count(*) AS n
FROM jobs WHERE coIndustryDesc IS NOT NULL GROUP BY 1, 2"""))
def q_industry_job_names(spark, sf):
    return D.industry_job_names(X.jobs_df(spark, sf))


@register("industry_month_counts", _q(MONTHS + """
SELECT coIndustryDesc AS industry, month, count(jobNo) AS job_count FROM m GROUP BY 1, 2"""))
def q_industry_month_counts(spark, sf):
    return D.industry_month_counts(X.jobs_df(spark, sf))


@register("industry_growth", _q(MONTHS + f""",
g AS (SELECT coIndustryDesc AS industry,
             count(*) FILTER (WHERE month = (SELECT min(month) FROM m) AND jobNo IS NOT NULL) AS first_count,
             count(*) FILTER (WHERE month = (SELECT max(month) FROM m) AND jobNo IS NOT NULL) AS last_count
      FROM m GROUP BY 1)
SELECT industry, first_count, last_count, last_count - first_count AS growth,
       {S.growth_pct('first_count', '(last_count - first_count)')} AS growth_pct,
       {S.growth_label('first_count', '(last_count - first_count)')} AS growth_rate
FROM g"""))
def q_industry_growth(spark, sf):
    return D.industry_growth(X.jobs_df(spark, sf))


@register("top5_industry_trend", _q(MONTHS + """,
mc AS (SELECT coIndustryDesc AS industry, month, count(jobNo) AS job_count FROM m GROUP BY 1, 2),
top AS (SELECT industry FROM mc WHERE month = (SELECT max(month) FROM mc)
        ORDER BY job_count DESC, industry LIMIT 5)
SELECT * FROM mc WHERE industry IN (SELECT industry FROM top)"""))
def q_top5_industry_trend(spark, sf):
    return D.top_industry_trend(X.jobs_df(spark, sf), 5)


@register("experience_applicants", _q("""
SELECT periodDesc AS experience, applyDesc AS apply_desc, count(*) AS job_count FROM jobs
WHERE periodDesc IS NOT NULL AND applyDesc IS NOT NULL GROUP BY 1, 2"""))
def q_experience_applicants(spark, sf):
    return D.experience_applicants(X.jobs_df(spark, sf))


@register("education_salary", _q("""
SELECT optionEdu AS education, salaryDesc AS salary_desc, count(*) AS job_count FROM jobs
WHERE optionEdu IS NOT NULL AND salaryDesc IS NOT NULL GROUP BY 1, 2"""))
def q_education_salary(spark, sf):
    return D.education_salary(X.jobs_df(spark, sf))


@register("salary_labels", _q("""
SELECT salaryDesc AS salary_desc, count(*) AS job_count FROM jobs WHERE salaryDesc IS NOT NULL GROUP BY 1"""))
def q_salary_labels(spark, sf):
    return D.salary_labels(X.jobs_df(spark, sf))


@register("city_counts", _q("""
SELECT city, count(*) AS job_count FROM jobs WHERE city IS NOT NULL GROUP BY 1"""))
def q_city_counts(spark, sf):
    return D.city_counts(X.jobs_df(spark, sf))


@register("district_top15", _q("""
SELECT city, district, count(*) AS job_count FROM jobs WHERE city IS NOT NULL AND district IS NOT NULL
GROUP BY 1, 2 ORDER BY job_count DESC, city, district LIMIT 15"""))
def q_district_top15(spark, sf):
    return D.district_top(X.jobs_df(spark, sf), 15)


@register("city_salary_top10", _q("""
SELECT city, salaryDesc AS salary_desc, count(*) AS job_count FROM jobs
WHERE city IS NOT NULL AND salaryDesc IS NOT NULL
  AND city IN (SELECT city FROM (SELECT city, count(*) AS n FROM jobs WHERE city IS NOT NULL GROUP BY 1
                                 ORDER BY n DESC, city LIMIT 10))
GROUP BY 1, 2"""))
def q_city_salary_top10(spark, sf):
    return D.city_salary_top(X.jobs_df(spark, sf), 10)


@register("district_salary_top10", _q("""
SELECT city || '-' || district AS city_district, salaryDesc AS salary_desc, count(*) AS job_count FROM jobs
WHERE city || '-' || district IS NOT NULL AND salaryDesc IS NOT NULL
  AND city || '-' || district IN (
      SELECT city || '-' || district FROM (
        SELECT * FROM (SELECT city, district, count(*) AS n FROM jobs
                       WHERE city IS NOT NULL AND district IS NOT NULL GROUP BY 1, 2
                       ORDER BY n DESC, city, district LIMIT 15)
        ORDER BY n DESC, city, district LIMIT 10))
GROUP BY 1, 2"""))
def q_district_salary_top10(spark, sf):
    return D.district_salary_top(X.jobs_df(spark, sf), 10, 15)


@register("city_map", _q(""", coords AS (SELECT * FROM (VALUES ('台北市', 121.5598, 25.0598), ('新北市', 121.4657, 25.0125),
    ('桃園市', 121.3010, 24.9936), ('台中市', 120.6839, 24.1377), ('台南市', 120.2141, 23.0008),
    ('高雄市', 120.3011, 22.6273), ('新竹市', 120.9647, 24.8138), ('新竹縣', 121.0165, 24.8390),
    ('基隆市', 121.7419, 25.1287)) t(city, lon, lat))
SELECT cc.city, cc.job_count, CAST(coords.lon AS DOUBLE) AS lon, CAST(coords.lat AS DOUBLE) AS lat
FROM (SELECT city, count(*) AS job_count FROM jobs WHERE city IS NOT NULL GROUP BY 1) cc
JOIN coords ON cc.city = coords.city"""))
def q_city_map(spark, sf):
    return D.city_map(X.jobs_df(spark, sf))


APPL_LO, APPL_HI = S.applicant("applyDesc")
SAL_LO, SAL_HI = S.salary("salaryDesc")


@register("applicant_range", _q(f"""
SELECT jobNo, applyDesc, {APPL_LO} AS min_applicants, {APPL_HI} AS max_applicants,
       ({APPL_LO} + {APPL_HI}) / 2.0 AS avg_applicants FROM jobs"""))
def q_applicant_range(spark, sf):
    return D.with_applicants(X.jobs_df(spark, sf)).select(
        "jobNo", "applyDesc", "min_applicants", "max_applicants", "avg_applicants")


@register("salary_range", _q(f"""
SELECT jobNo, salaryDesc, {SAL_LO} AS min_salary, {SAL_HI} AS max_salary,
       ({SAL_LO} + {SAL_HI}) / 2.0 AS avg_salary FROM jobs"""))
def q_salary_range(spark, sf):
    return D.with_salary(X.jobs_df(spark, sf)).select("jobNo", "salaryDesc", "min_salary", "max_salary", "avg_salary")


@register("competition_level", _q(f"""
SELECT {S.competition('applyDesc')} AS competition, count(*) AS job_count FROM jobs GROUP BY 1"""))
def q_competition_level(spark, sf):
    return D.competition_counts(X.jobs_df(spark, sf))


@register("applicant_kpis", _q(f"""
SELECT avg(({APPL_LO} + {APPL_HI}) / 2.0) AS avg_applicants, max({APPL_HI}) AS max_applicants FROM jobs"""))
def q_applicant_kpis(spark, sf):
    return D.applicant_kpis(X.jobs_df(spark, sf))


def _hist_sql(src: str, x: str, bins: int = 20) -> str:
    return f""", hx AS (SELECT CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL),
b AS (SELECT (SELECT min(x) FROM hx) AS lo, ((SELECT max(x) FROM hx) - (SELECT min(x) FROM hx)) / {float(bins)} AS w),
hb AS (SELECT CAST(CASE WHEN b.w = 0 THEN 0 ELSE least(floor((x - b.lo) / b.w), {bins - 1}) END AS INTEGER) AS bin, b.lo, b.w
       FROM hx, b)
SELECT bin, count(*) AS job_count, any_value(lo) + bin * any_value(w) AS bin_start,
       any_value(lo) + (bin + 1) * any_value(w) AS bin_end FROM hb GROUP BY bin"""


@register("applicant_histogram", _q(f", ap AS (SELECT ({APPL_LO} + {APPL_HI}) / 2.0 AS avg_applicants FROM jobs)"
                                    + _hist_sql("ap", "avg_applicants")))
def q_applicant_histogram(spark, sf):
    return D.applicant_histogram(X.jobs_df(spark, sf))


@register("shelf_histogram", _q(S.ANALYSIS + _hist_sql("an2", "shelf_days")))
def q_shelf_histogram(spark, sf):
    return D.histogram(FL.analysis_projection(X.jobs_df(spark, sf), AS_OF), "shelf_days")


@register("flag_ratios", _q(S.ANALYSIS + """
SELECT count(*) AS total, count(*) FILTER (WHERE long_unfilled) AS long_unfilled_count,
       count(*) FILTER (WHERE recent) AS recent_count,
       count(*) FILTER (WHERE long_unfilled) / count(*) AS long_unfilled_ratio,
       count(*) FILTER (WHERE recent) / count(*) AS recent_ratio FROM an2"""))
def q_flag_ratios(spark, sf):
    return D.flag_ratios(FL.analysis_projection(X.jobs_df(spark, sf), AS_OF))


@register("long_unfilled_topk", _q(S.ANALYSIS + """
SELECT job_no, job_name, company_name, shelf_days FROM an2 WHERE long_unfilled
ORDER BY shelf_days DESC NULLS LAST, job_no ASC NULLS LAST LIMIT 10"""))
def q_long_unfilled_topk(spark, sf):
    return D.long_unfilled_topk(FL.analysis_projection(X.jobs_df(spark, sf), AS_OF), 10) \
        .select("job_no", "job_name", "company_name", "shelf_days")


@register("recent_postings", _q(S.ANALYSIS + """
SELECT job_no, job_name, company_name, shelf_days FROM an2 WHERE recent"""))
def q_recent_postings(spark, sf):
    return D.recent_postings(FL.analysis_projection(X.jobs_df(spark, sf), AS_OF)) \
        .select("job_no", "job_name", "company_name", "shelf_days")


@register("dashboard_recent", _q(S.ANALYSIS + """
SELECT job_no, job_name, company_name, shelf_days FROM an2 WHERE recent
ORDER BY shelf_days DESC NULLS LAST, job_no ASC NULLS LAST LIMIT 10"""))
def q_dashboard_recent(spark, sf):
    """R1's recent list (O6): the ten recent postings longest on the shelf."""
    return D.recent_postings(FL.analysis_projection(X.jobs_df(spark, sf), AS_OF), 10, longest_first=True) \
        .select("job_no", "job_name", "company_name", "shelf_days")


@register("industry_month_wide", _q(MONTHS + """
SELECT coIndustryDesc AS industry,
       count(jobNo) FILTER (WHERE month = '2001-06') AS "2001-06",
       count(jobNo) FILTER (WHERE month = '2001-07') AS "2001-07",
       count(jobNo) FILTER (WHERE month = '2001-08') AS "2001-08"
FROM m GROUP BY 1"""))
def q_industry_month_wide(spark, sf):
    return D.industry_month_wide(X.jobs_df(spark, sf), ["2001-06", "2001-07", "2001-08"])



@register("industry_growth_table", _q(MONTHS + f""",
g AS (SELECT coIndustryDesc AS industry,
             count(*) FILTER (WHERE month = (SELECT min(month) FROM m) AND jobNo IS NOT NULL) AS first_count,
             count(*) FILTER (WHERE month = (SELECT max(month) FROM m) AND jobNo IS NOT NULL) AS last_count
      FROM m GROUP BY 1)
SELECT industry, last_count - first_count AS growth,
       {S.growth_label('first_count', '(last_count - first_count)')} AS growth_rate
FROM g ORDER BY growth DESC, industry"""))
def q_industry_growth_table(spark, sf):
    return D.industry_growth_table(X.jobs_df(spark, sf)).select("industry", "growth", "growth_rate")


@register("experience_applicants_wide", _q("""
SELECT periodDesc, """ + ", ".join(f"count(*) FILTER (WHERE applyDesc = '{b}') AS \"{b}\"" for b in X.APPLY_BANDS if b) + """
FROM jobs WHERE periodDesc IS NOT NULL AND applyDesc IS NOT NULL GROUP BY 1"""))
def q_experience_applicants_wide(spark, sf):
    """A9 in wide form over the known bands."""
    return D.crosstab_wide(X.jobs_df(spark, sf), "periodDesc", "applyDesc", [b for b in X.APPLY_BANDS if b])
