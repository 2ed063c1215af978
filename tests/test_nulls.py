"""Operators on postings whose optional columns are all NULL, or missing (SURVEY §5 (5))."""

import pytest
from pyspark.sql import functions as F

from hirelens import constants as C
from hirelens import fixtures as X
from hirelens.operators import distribution as D
from hirelens.operators import filters as FL
from hirelens.operators import trends as T

OPTIONAL = ["coIndustryDesc", "salaryDesc", "applyDesc", "periodDesc", "optionEdu", "jobDetail",
            "delisted_date", "city", "district", "jobName", "custName", "job"]

OPS = {
    "daily_job_changes": T.daily_job_changes, "daily_details": T.daily_details,
    "day_over_day_diff": T.day_over_day_diff, "delisted_buckets": T.delisted_duration_buckets,
    "delisted_kpis": lambda j: T.delisted_kpis(j, X.AS_OF), "delisted_ma7": T.delisted_daily_ma7,
    "industry_share": D.industry_share, "industry_growth": D.industry_growth,
    "top5": D.top_industry_trend, "city_salary_top": D.city_salary_top, "district_salary_top": D.district_salary_top,
    "experience_applicants": D.experience_applicants, "applicant_histogram": D.applicant_histogram,
    "applicant_kpis": D.applicant_kpis, "competition": D.competition_counts, "city_map": D.city_map,
    "flag_ratios": lambda j: D.flag_ratios(FL.analysis_projection(j, X.AS_OF)),
    "keyword_filter": lambda j: FL.keyword_filter(j, ["python"]),
}


@pytest.fixture(scope="module")
def null_jobs(spark, sf):
    jobs = X.jobs_df(spark, sf)
    return jobs.withColumns({c: F.lit(None).cast(dict(jobs.dtypes)[c]) for c in OPTIONAL}) \
               .withColumn("search_keyword", F.lit(None).cast("array<string>"))


@pytest.mark.parametrize("name", sorted(OPS))
def test_all_null_optional_columns(null_jobs, name):
    OPS[name](null_jobs).write.format("noop").mode("overwrite").save()


def test_missing_optional_columns(spark, sf):
    jobs = X.jobs_df(spark, sf).select("jobNo", "appearDate", "status")
    an = FL.analysis_projection(jobs, X.AS_OF)
    row = an.first()
    assert row["job_name"] == "未知" and row["company_name"] == "未知"
    assert row["link"].endswith(row["job_no"])
    assert "salary_desc" not in an.columns
    assert FL.display_projection(an).columns == [c for c in C.DISPLAY_COLUMNS if c in an.columns]
    assert FL.keyword_filter(jobs, ["x"]).count() == 0  # no keyword / text columns at all
    assert T.daily_job_changes(jobs).count() > 0
