"""Distributions and rankings: A6–A16, A22, A27–A29, F1–F3 applied, O3–O6, O8, O9, J9, J14.

Every operator aggregates with ``groupBy`` (partial + final hash aggregate,
so a hot city or industry costs one counter per task before the shuffle).
Group keys are filtered ``IS NOT NULL`` where the original drops null keys.
Top-N restrictions are a ``limit`` over an already aggregated frame (tiny,
bounded by N) joined back with a semi join.  Global totals and first / last
months are window aggregates over the few aggregated rows (one scan of the
postings); histogram bounds are one scalar subquery.  Long form is the primary output of crosstabs; ``wide`` gives
the pivot over an explicit label list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens import constants as C
from hirelens.functions import parsing as P
from hirelens.functions.literals import literal_frame


def _cnt(name: str = "job_count"):
    return F.count(F.lit(1)).alias(name)


# ---------------------------------------------------------------------------
# Industry (A6, A7, A8, O5, O9)
# ---------------------------------------------------------------------------
def industry_share(jobs: DataFrame, industry_col: str = "coIndustryDesc") -> DataFrame:
    """Count per industry (nulls excluded) and share % of **all** rows.

    One scan: the NULL-industry group is counted too, the total is a window
    sum over the (few) aggregated groups, and the NULL group is dropped last.
    """
    groups = jobs.groupBy(F.col(industry_col).alias("industry")).agg(_cnt())
    total = F.sum("job_count").over(Window.partitionBy())
    return (groups.withColumn("share_pct", F.col("job_count") / total * F.lit(100.0))
            .where(F.col("industry").isNotNull()))


def top_n(df: DataFrame, n: int, by: str = "job_count", key: str | list[str] = "industry") -> DataFrame:
    """Top ``n`` rows by ``by`` desc, ties broken by key asc."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def industry_profile(jobs: DataFrame, industry_col: str = "coIndustryDesc") -> DataFrame:
    """Postings (count of jobNo) and distinct companies per industry."""
    return (jobs.where(F.col(industry_col).isNotNull())
            .groupBy(F.col(industry_col).alias("industry"))
            .agg(F.count("jobNo").alias("job_count"), F.countDistinct("custName").alias("company_count")))


def industry_job_names(jobs: DataFrame, industry_col: str = "coIndustryDesc") -> DataFrame:
    """A7 job-name list in long form: (industry, job_name, n)."""
    return (jobs.where(F.col(industry_col).isNotNull())
            .groupBy(F.col(industry_col).alias("industry"), F.col("jobName").alias("job_name"))
            .agg(F.count(F.lit(1)).alias("n")))


def _with_month(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("month", P.month_label(F.to_date("appearDate", "yyyyMMdd")))


def industry_month_counts(jobs: DataFrame, industry_col: str = "coIndustryDesc") -> DataFrame:
    """A8 long form: count(jobNo) per (industry, month ``yyyy-MM``); absent pairs are 0."""
    return (_with_month(jobs).where(F.col(industry_col).isNotNull())
            .groupBy(F.col(industry_col).alias("industry"), "month")
            .agg(F.count("jobNo").alias("job_count")))


def industry_growth(jobs: DataFrame, industry_col: str = "coIndustryDesc") -> DataFrame:
    """A8 + F11 (+O9 order): first-month and last-month counts per industry,
    growth = last − first, numeric growth % and its label.

    One scan: the (industry, month) counts are aggregated first; the global
    first / last month (the first and last pivot columns) are window
    min / max over those few aggregated rows.
    """
    mc = industry_month_counts(jobs, industry_col)
    everything = Window.partitionBy()
    mc = mc.withColumns({"first_month": F.min("month").over(everything),
                         "last_month": F.max("month").over(everything)})
    agg = mc.groupBy("industry").agg(
        F.sum(F.when(F.col("month") == F.col("first_month"), F.col("job_count")).otherwise(0)).alias("first_count"),
        F.sum(F.when(F.col("month") == F.col("last_month"), F.col("job_count")).otherwise(0)).alias("last_count"))
    g = F.col("last_count") - F.col("first_count")
    return (agg.withColumn("growth", g)
            .withColumn("growth_pct", P.growth_pct("first_count", "growth"))
            .withColumn("growth_rate", P.growth_label("first_count", "growth")))


def industry_growth_table(jobs: DataFrame, industry_col: str = "coIndustryDesc") -> DataFrame:
    """The growth table sorted by growth, largest first (industry tie-break)."""
    return industry_growth(jobs, industry_col).orderBy(F.desc("growth"), F.asc("industry"))


def industry_month_wide(jobs: DataFrame, months: list[str], industry_col: str = "coIndustryDesc") -> DataFrame:
    """A8 wide form over an explicit month list (0-filled)."""
    return (_with_month(jobs).where(F.col(industry_col).isNotNull())
            .groupBy(F.col(industry_col).alias("industry")).pivot("month", months)
            .agg(F.count("jobNo")).na.fill(0))


def top_industry_trend(jobs: DataFrame, n: int = 5, industry_col: str = "coIndustryDesc") -> DataFrame:
    """O5 + P19: monthly counts of the ``n`` industries largest in the latest month.

    One scan: rank industries inside the latest month with a window over the
    aggregated (industry, month) rows, then keep the top ``n`` industries.
    """
    mc = industry_month_counts(jobs, industry_col).withColumn(
        "last_month", F.max("month").over(Window.partitionBy()))
    latest_rank = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("job_count"), F.asc("industry")))
    ranked = mc.withColumn("_r", F.when(F.col("month") == F.col("last_month"), latest_rank))
    top = F.min("_r").over(Window.partitionBy("industry"))
    return ranked.withColumn("_top", top).where(F.col("_top") <= n).drop("_r", "_top", "last_month")


# ---------------------------------------------------------------------------
# Crosstabs (A9–A12) and simple counts
# ---------------------------------------------------------------------------
def crosstab(df: DataFrame, row: str, col: str, row_alias: str | None = None,
             col_alias: str | None = None) -> DataFrame:
    """Long-form crosstab: counts of (row, col) pairs, null keys dropped."""
    return (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
            .groupBy(F.col(row).alias(row_alias or row), F.col(col).alias(col_alias or col))
            .agg(_cnt()))


def crosstab_wide(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Wide crosstab over an explicit label list (0-filled)."""
    return (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
            .groupBy(row).pivot(col, values).count().na.fill(0))


def experience_applicants(jobs: DataFrame) -> DataFrame:
    """Experience × applicant band."""
    return crosstab(jobs, "periodDesc", "applyDesc", "experience", "apply_desc")


def education_salary(jobs: DataFrame) -> DataFrame:
    """A10: education × salary label."""
    return crosstab(jobs, "optionEdu", "salaryDesc", "education", "salary_desc")


def salary_labels(jobs: DataFrame) -> DataFrame:
    """Postings per salary label (nulls dropped), sorted by label."""
    return (jobs.where(F.col("salaryDesc").isNotNull()).groupBy(F.col("salaryDesc").alias("salary_desc"))
            .agg(_cnt()).orderBy("salary_desc"))


def city_counts(jobs: DataFrame) -> DataFrame:
    """Postings per city (nulls dropped), most first."""
    return (jobs.where(F.col("city").isNotNull()).groupBy("city").agg(_cnt())
            .orderBy(F.desc("job_count"), F.asc("city")))


def district_counts(jobs: DataFrame) -> DataFrame:
    """Postings per (city, district)."""
    return jobs.where(F.col("city").isNotNull() & F.col("district").isNotNull()) \
        .groupBy("city", "district").agg(_cnt())


def district_top(jobs: DataFrame, n: int = 15) -> DataFrame:
    """A15 + O4: the ``n`` largest (city, district) groups."""
    return top_n(district_counts(jobs), n, "job_count", ["city", "district"])


def city_salary_top(jobs: DataFrame, n: int = 10) -> DataFrame:
    """A11 + J14: city × salary label for the ``n`` largest cities."""
    top = top_n(city_counts(jobs), n, "job_count", "city").select("city")
    return crosstab(jobs, "city", "salaryDesc", "city", "salary_desc").join(F.broadcast(top), "city", "left_semi")


def district_salary_top(jobs: DataFrame, n: int = 10, pool: int = 15) -> DataFrame:
    """A12 + J14 + F14: ``city-district`` × salary label for the top ``n`` of the top ``pool`` districts."""
    top = top_n(district_top(jobs, pool), n, "job_count", ["city", "district"]) \
        .select(P.city_district_key().alias("city_district"))
    keyed = jobs.withColumn("city_district", P.city_district_key())
    return crosstab(keyed, "city_district", "salaryDesc", "city_district", "salary_desc") \
        .join(F.broadcast(top), "city_district", "left_semi")


def city_map(jobs: DataFrame) -> DataFrame:
    """J9 + P20: city counts with map coordinates; cities without coordinates dropped."""
    coords = literal_frame(jobs.sparkSession, C.CITY_COORDINATES,
                           [("city", "string"), ("lon", "double"), ("lat", "double")])
    return city_counts(jobs).join(F.broadcast(coords), "city", "inner")


# ---------------------------------------------------------------------------
# Applicants, competition, salary
# ---------------------------------------------------------------------------
def _staged(df: DataFrame, parsed, names: tuple[str, str, str]) -> DataFrame:
    """Evaluate a parsed (min, max) struct once, then spread it into columns (+ avg).

    The struct is computed in its own projection; Spark keeps that
    projection rather than inlining the (non-trivial) expression three times.
    """
    tmp = "_parsed_" + names[0]
    out = df.withColumn(tmp, parsed)
    lo, hi = F.col(tmp)["min"], F.col(tmp)["max"]
    return out.withColumns({names[0]: lo, names[1]: hi, names[2]: (lo + hi) / F.lit(2.0)}).drop(tmp)


def with_applicants(df: DataFrame, col: str = "applyDesc") -> DataFrame:
    return _staged(df, P.applicant_range(col, with_avg=False), ("min_applicants", "max_applicants", "avg_applicants"))


def with_salary(df: DataFrame, col: str = "salaryDesc") -> DataFrame:
    return _staged(df, P.salary_range(col, with_avg=False), ("min_salary", "max_salary", "avg_salary"))


def with_competition(df: DataFrame, col: str = "applyDesc") -> DataFrame:
    return df.withColumn("competition", P.competition_level(col))


def competition_counts(jobs: DataFrame) -> DataFrame:
    """A16 (+F3): postings per competition level."""
    return with_competition(jobs).groupBy("competition").agg(_cnt())


def applicant_kpis(jobs: DataFrame) -> DataFrame:
    """Mean of the applicant mid-point, max of the upper bound."""
    return with_applicants(jobs).agg(F.avg("avg_applicants").alias("avg_applicants"),
                                     F.max("max_applicants").alias("max_applicants"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Fixed-width histogram over [min, max] with ``bins`` bins
    (the last bin is closed).  min / max are scalar subqueries.
    """
    x = F.col(col).cast("double")
    base = df.where(x.isNotNull())
    bounds = base.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()  # one subquery
    lo, hi = bounds["lo"], bounds["hi"]
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / width), F.lit(bins - 1))).cast("int")
    return (base.groupBy(b.alias("bin")).agg(_cnt())
            .withColumn("bin_start", lo + F.col("bin") * width)
            .withColumn("bin_end", lo + (F.col("bin") + 1) * width))


def applicant_histogram(jobs: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(with_applicants(jobs), "avg_applicants", bins)


def flag_ratios(analysis: DataFrame) -> DataFrame:
    """Long-unfilled and recent counts and their share of all postings (NULL when there are none)."""
    return analysis.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("long_unfilled").alias("long_unfilled_count"),
        F.count_if("recent").alias("recent_count"),
        F.try_divide(F.count_if("long_unfilled"), F.count(F.lit(1))).alias("long_unfilled_ratio"),
        F.try_divide(F.count_if("recent"), F.count(F.lit(1))).alias("recent_ratio"))


def long_unfilled_topk(analysis: DataFrame, k: int | None = 10) -> DataFrame:
    """P15 + O6: long-unfilled postings, longest on the shelf first (jobNo tie-break)."""
    out = analysis.where("long_unfilled").orderBy(F.desc_nulls_last("shelf_days"), F.asc_nulls_last("job_no"))
    return out.limit(k) if k else out


def recent_postings(analysis: DataFrame, k: int | None = None, longest_first: bool = False) -> DataFrame:
    """P16 + O8: recent postings, newest first (fewest shelf days).

    ``longest_first`` is the dashboard's order (O6): most shelf days first.
    """
    days = F.desc_nulls_last("shelf_days") if longest_first else F.asc_nulls_last("shelf_days")
    out = analysis.where("recent").orderBy(days, F.asc_nulls_last("job_no"))
    return out.limit(k) if k else out
