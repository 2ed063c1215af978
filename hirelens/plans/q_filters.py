"""Registered projection / filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.fixtures import AS_OF, AS_OF_SQL, with_hits, with_jobs
from hirelens.functions import parsing as P
from hirelens.operators import distribution as D
from hirelens.operators import filters as FL
from hirelens.operators import dimensions as DM
from hirelens.plans import sqlfrag as S
from hirelens.plans.catalog import register
from hirelens.session import scratch_path

ANALYSIS_COLS = ["job_no", "job_name", "company_name", "city", "district", "keywords", "link", "apply_desc",
                 "salary_desc", "experience", "education", "industry", "status", "delisted_date",
                 "appear_date", "shelf_days", "long_unfilled", "recent"]


def _kw_text(df, col="keywords"):
    return df.withColumn(col, F.array_join(col, "|"))


@register("active_jobs_scan", with_jobs("""
SELECT jobNo, jobName, custName, status, coIndustryDesc FROM jobs
WHERE status = 'active' AND coIndustryDesc = 'BUILDING'"""))
def q_active_jobs_scan(spark, sf):
    return FL.scan_jobs(X.jobs_df(spark, sf), filters={"coIndustryDesc": "BUILDING"}) \
        .select("jobNo", "jobName", "custName", "status", "coIndustryDesc")


@register("recent_jobs_filter", with_jobs(f"""
SELECT jobNo, appearDate FROM jobs
WHERE CAST(strptime(appearDate, '%Y%m%d') AS DATE) >= {AS_OF_SQL} - 180"""))
def q_recent_jobs_filter(spark, sf):
    return FL.recent_jobs(X.jobs_df(spark, sf), 6, AS_OF).select("jobNo", "appearDate")


@register("keyword_filter", with_jobs("""
SELECT jobNo, array_to_string(search_keyword, '|') AS search_keyword FROM jobs
WHERE contains(lower(array_to_string(search_keyword, ' ')), 'python')
  AND contains(lower(array_to_string(search_keyword, ' ')), 'dj')"""))
def q_keyword_filter(spark, sf):
    return FL.keyword_filter(X.jobs_df(spark, sf), ["Python", "DJ"]) \
        .select("jobNo", F.array_join("search_keyword", "|").alias("search_keyword"))


@register("keyword_filter_text", with_jobs("""
, t AS (SELECT jobNo, lower(jobName || ' ' || coalesce(jobDetail, '') || ' ' || coalesce(custName, '')) AS txt FROM jobs)
SELECT jobNo FROM t WHERE contains(txt, 'role-1') AND contains(txt, 'high')"""))
def q_keyword_filter_text(spark, sf):
    return FL.keyword_filter(X.jobs_df(spark, sf).drop("search_keyword"), ["ROLE-1", "high"]).select("jobNo")


@register("location_filter", with_jobs("""
SELECT jobNo, city, district FROM jobs WHERE city = '台北市' AND district = '大安區'"""))
def q_location_filter(spark, sf):
    return FL.location_filter(X.jobs_df(spark, sf), "台北市", "大安區").select("jobNo", "city", "district")


@register("analysis_projection", with_jobs(S.ANALYSIS + f"""
SELECT {', '.join(c if c != 'keywords' else "array_to_string(keywords, '|') AS keywords" for c in ANALYSIS_COLS)}
FROM an2"""))
def q_analysis_projection(spark, sf):
    return _kw_text(FL.analysis_projection(X.jobs_df(spark, sf), AS_OF).select(*ANALYSIS_COLS))


@register("display_projection", with_jobs(S.ANALYSIS + """
SELECT city, district, job_name, company_name, shelf_days, appear_date, link, salary_desc, apply_desc,
       experience, education, array_to_string(keywords, '|') AS keywords FROM an2"""))
def q_display_projection(spark, sf):
    return _kw_text(FL.display_projection(FL.analysis_projection(X.jobs_df(spark, sf), AS_OF)))


@register("selected_day_jobs", with_jobs(S.ANALYSIS + """
SELECT city, district, job_name, company_name, shelf_days, appear_date, link, salary_desc, apply_desc,
       experience, education, array_to_string(keywords, '|') AS keywords, job_no
FROM an2 WHERE appear_date = DATE '2001-07-31'"""))
def q_selected_day_jobs(spark, sf):
    return _kw_text(FL.selected_day_jobs(X.jobs_df(spark, sf), "2001-07-31", AS_OF))


@register("active_plus_inactive", with_jobs("""
SELECT jobNo, status, city FROM jobs WHERE status = 'active' AND city = '台北市'
UNION ALL SELECT jobNo, status, city FROM jobs WHERE status = 'inactive'"""))
def q_active_plus_inactive(spark, sf):
    jobs = X.jobs_df(spark, sf)
    active = FL.location_filter(FL.scan_jobs(jobs), "台北市").select("jobNo", "status", "city")
    return FL.active_plus_inactive(active, jobs.select("jobNo", "status", "city"))


@register("incremental_slice", with_jobs(f"""
SELECT jobNo, crawl_date FROM jobs WHERE crawl_date >= {AS_OF_SQL} - 3"""))
def q_incremental_slice(spark, sf):
    return FL.incremental_slice(X.jobs_df(spark, sf), as_of=AS_OF, days_ago=3).select("jobNo", "crawl_date")


@register("city_district_split", with_jobs(f"""
SELECT jobNo, jobAddrNoDesc, {X.sql_city('jobAddrNoDesc')} AS city, {X.sql_district('jobAddrNoDesc')} AS district FROM jobs"""))
def q_city_district_split(spark, sf):
    jobs = X.jobs_df(spark, sf).select("jobNo", "jobAddrNoDesc")
    return P.with_city_district(jobs)


_LINK_STR = ("'{' || concat_ws(', ', '''applyAnalyze'': ' || substr(applyAnalyze, 7), '''job'': ' || substr(job, 7), "
             "CASE WHEN cust <> '' THEN '''cust'': ' || cust END) || '}'")


def _sql_extract(s: str, key: str) -> str:
    v = f"regexp_extract({s}, '''{key}'':\\s*(//[^,}}]+)', 1)"
    return f"CASE WHEN {v} <> '' AND NOT starts_with({v}, 'http:') AND NOT starts_with({v}, 'https:') THEN 'https:' || {v} ELSE {v} END"


@register("link_urls_string", with_hits(f"""
SELECT jobNo, ord_line, ord_part, ord_supp, {_sql_extract('ls', 'applyAnalyze')} AS applyAnalyze,
       {_sql_extract('ls', 'job')} AS job, {_sql_extract('ls', 'cust')} AS cust
FROM (SELECT *, {_LINK_STR} AS ls FROM hits)"""))
def q_link_urls_string(spark, sf):
    h = X.hits_df(spark, sf)
    u = P.link_urls_from_string(X.link_string(F.col("link")))
    return h.select("jobNo", F.col("ord.line").alias("ord_line"), F.col("ord.part").alias("ord_part"),
                    F.col("ord.supp").alias("ord_supp"), u.applyAnalyze.alias("applyAnalyze"),
                    u.job.alias("job"), u.cust.alias("cust"))


@register("link_urls_struct", with_hits("""
SELECT jobNo, ord_line, ord_part, ord_supp, applyAnalyze, job, cust FROM hits"""))
def q_link_urls_struct(spark, sf):
    h = X.hits_df(spark, sf)
    u = P.link_urls_from_struct("link")
    return h.select("jobNo", F.col("ord.line").alias("ord_line"), F.col("ord.part").alias("ord_part"),
                    F.col("ord.supp").alias("ord_supp"), u.applyAnalyze.alias("applyAnalyze"),
                    u.job.alias("job"), u.cust.alias("cust"))


@register("keyword_suggest", with_jobs("""
SELECT kw AS keyword FROM (SELECT DISTINCT unnest(search_keyword) AS kw FROM jobs)
WHERE starts_with(lower(kw), 'd') ORDER BY kw LIMIT 5"""))
def q_keyword_suggest(spark, sf):
    return DM.keyword_suggest(DM.keyword_choices(X.jobs_df(spark, sf)), "python, D")


@register("all_districts", with_jobs("""
SELECT city, array_to_string(list_sort(list(DISTINCT district)), '|') AS districts FROM jobs
WHERE city IS NOT NULL AND city <> '' AND district IS NOT NULL AND district <> '' GROUP BY 1"""))
def q_all_districts(spark, sf):
    dim = DM.districts_from_postings(X.jobs_df(spark, sf))
    return DM.districts_by_city(dim).select("city", F.array_join("districts", "|").alias("districts"))


@register("district_union", with_jobs("""
SELECT DISTINCT district FROM jobs
WHERE city IS NOT NULL AND city <> '' AND district IS NOT NULL AND district <> ''"""))
def q_district_union(spark, sf):
    return DM.all_districts(DM.districts_from_postings(X.jobs_df(spark, sf)))


def _given_districts(spark, sf):
    """A dimension file: the districts of all cities but one, and one more for each that no posting has."""
    seen = DM.districts_from_postings(X.jobs_df(spark, sf)).where("city <> '新北市'")
    lists = DM.districts_by_city(seen).select("city", F.concat("districts", F.array(F.concat("city", F.lit("東")))).alias("districts"))
    path = scratch_path(spark, "districts")
    lists.select(F.to_json(F.map_from_arrays(F.array("city"), F.array("districts"))).alias("value")).write.text(path)
    return DM.read_city_districts(spark, path, lines=True)


GIVEN_SQL = """, seen AS (SELECT DISTINCT city, district FROM jobs
           WHERE city IS NOT NULL AND city NOT IN ('', '新北市') AND district IS NOT NULL AND district <> ''),
dim AS (SELECT * FROM seen UNION SELECT city, city || '東' FROM seen)
"""


@register("location_choices", with_jobs(GIVEN_SQL + """
SELECT city, array_to_string(list_sort(list(DISTINCT district)), '|') AS districts
FROM (SELECT * FROM dim UNION ALL SELECT '全部城市', district FROM dim) GROUP BY 1"""))
def q_location_choices(spark, sf):
    """U4 from a given file, with the entry for all cities."""
    return DM.location_choices(_given_districts(spark, sf)).select("city", F.array_join("districts", "|").alias("districts"))


@register("postings_by_location", with_jobs(GIVEN_SQL + """
, n AS (SELECT city, NULLIF(district, '') AS district, count(*) AS n FROM jobs WHERE city IS NOT NULL AND city <> '' GROUP BY 1, 2),
places AS (SELECT * FROM dim UNION SELECT city, NULL FROM dim)
SELECT coalesce(places.city, n.city) AS city, coalesce(places.district, n.district) AS district, places.city IS NOT NULL AS known,
       coalesce(n.n, 0) AS job_count
FROM places FULL OUTER JOIN n ON places.city = n.city AND places.district IS NOT DISTINCT FROM n.district"""))
def q_postings_by_location(spark, sf):
    """U4 joined to the postings; cities and districts that the file lacks are kept."""
    return DM.postings_by_location(X.jobs_df(spark, sf), _given_districts(spark, sf))


@register("report_columns", with_jobs("""
, c AS (SELECT jobNo, coIndustryDesc, salaryDesc FROM jobs)
SELECT 'industry' AS page, true AS complete, '' AS missing, count(coIndustryDesc) AS usable FROM c
UNION ALL SELECT 'salary', true, '', count(salaryDesc) FROM c
UNION ALL SELECT 'location', false, 'city|district', 0"""))
def q_report_columns(spark, sf):
    """P10: which pages a table without the place columns can feed, and with how many postings."""
    jobs = X.jobs_df(spark, sf).drop("city", "district")
    needs = {"industry": ["coIndustryDesc"], "salary": ["salaryDesc"], "location": ["city", "district"]}
    rows = []
    for page, columns in needs.items():
        lacks = FL.missing_columns(jobs, columns)
        usable = F.lit(0).cast("long") if lacks else F.count(F.col(columns[0]))
        rows.append(F.struct(F.lit(page).alias("page"), F.lit(not lacks).alias("complete"), F.lit("|".join(lacks)).alias("missing"),
                             usable.alias("usable")))
    return jobs.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@register("dashboard_base", with_jobs(f"""
SELECT jobNo, appearDate, city, array_to_string(search_keyword, '|') AS search_keyword FROM jobs
WHERE status = 'active' AND CAST(strptime(appearDate, '%Y%m%d') AS DATE) >= {AS_OF_SQL} - 720
  AND contains(lower(array_to_string(search_keyword, ' ')), 'python') AND city = '台北市'"""))
def q_dashboard_base(spark, sf):
    """S1 + P2 + P3 + P4 + P6: the dashboard's data load, filters before any limit."""
    out = FL.load_jobs(X.jobs_df(spark, sf), as_of=AS_OF, months=24, keywords=["Python"], city="台北市")
    return out.select("jobNo", "appearDate", "city", F.array_join("search_keyword", "|").alias("search_keyword"))


@register("scan_ordered_limit", with_jobs("""
SELECT jobNo, appearDate, status FROM jobs ORDER BY appearDate ASC NULLS LAST, jobNo ASC NULLS LAST LIMIT 100"""))
def q_scan_ordered_limit(spark, sf):
    """O1 + P24: a limited scan with its order, inactive postings included."""
    return FL.scan_jobs(X.jobs_df(spark, sf), limit=100, include_inactive=True, order_by=["appearDate", "jobNo"]) \
        .select("jobNo", "appearDate", "status")


@register("keyword_filter_unset", with_jobs("SELECT jobNo, status FROM jobs"))
def q_keyword_filter_unset(spark, sf):
    """P4 / P5 without keywords keep every posting."""
    return FL.keyword_filter_text(FL.keyword_filter(X.jobs_df(spark, sf), []), []).select("jobNo", "status")


@register("month_jobs", with_jobs("""
SELECT jobNo, appearDate FROM jobs WHERE substr(appearDate, 1, 6) = '200106'"""))
def q_month_jobs(spark, sf):
    """Postings of one calendar month."""
    dated = X.jobs_df(spark, sf).withColumn("date", F.to_date("appearDate", "yyyyMMdd"))
    return FL.month_filter(dated, "2001-06").select("jobNo", "appearDate")


@register("top_industry_jobs", with_jobs("""
SELECT jobNo, coIndustryDesc, city FROM jobs WHERE city IN ('台北市', '新北市') AND coIndustryDesc IN (
  SELECT coIndustryDesc FROM jobs WHERE coIndustryDesc IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, coIndustryDesc LIMIT 3)"""))
def q_top_industry_jobs(spark, sf):
    """Membership in a list, and in another frame's column."""
    jobs = X.jobs_df(spark, sf)
    top = D.top_n(D.industry_share(jobs), 3).select("industry")
    return FL.membership(FL.membership(jobs, "city", ["台北市", "新北市"]), "coIndustryDesc", top) \
        .select("jobNo", "coIndustryDesc", "city")


@register("keyword_values", with_jobs("""
SELECT jobNo, array_to_string(search_keyword, '|') AS from_list, coalesce(NULLIF(city, ''), '') AS from_text,
       array_to_string(search_keyword, '|') AS parsed FROM jobs"""))
def q_keyword_values(spark, sf):
    """F16 on lists and on text, F17 on typed lists with blanks and empty parts."""
    typed = F.concat(F.lit(" , "), F.concat_ws(" ,, ", "search_keyword"), F.lit(","))
    return X.jobs_df(spark, sf).select(
        "jobNo", F.array_join(P.as_keyword_array("search_keyword"), "|").alias("from_list"),
        F.array_join(P.as_keyword_array("city", "string"), "|").alias("from_text"),
        F.array_join(P.parse_keyword_list(typed), "|").alias("parsed"))
