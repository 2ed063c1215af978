"""Registered ingest / lifecycle queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.fixtures import AS_OF, AS_OF_SQL, HITS_SQL, JOBS_SQL, KEYWORD_LISTS_SQL, with_hits
from hirelens.operators import ingest as I
from hirelens.operators import lifecycle as L
from hirelens.plans.catalog import register
from hirelens.plans.pipeline import run_crawl_day
from hirelens.session import drop_scratch, scratch_path, shuffles_released
from hirelens.sources import snapshots as SN
from hirelens.streaming.ingest_stream import apply_batch, close_crawl_day

URL_SQL = ("'https://www.104.com.tw/jobs/search/list?keyword=' || coalesce({kw}, '') || '&page=' || CAST({page} AS VARCHAR)"
           " || '&area=' || {area} || '&industry=&jobCat=&exp=&edu=&mode=s&jobsource=index'")


@register("explode_responses", with_hits(f"""
SELECT jobNo, jobName, search_keyword, page_key, page_block,
       CAST(row_number() OVER (PARTITION BY search_keyword, page_key, page_block
                               ORDER BY ord_line, ord_part, ord_supp, ord_price, ord_okey) - 1 AS INTEGER) AS pos,
       {AS_OF_SQL} AS crawl_date, 'active' AS status, coalesce(jobAddrNo, '') AS area_code,
       coalesce(jobAddrNoDesc, '') AS area_name
FROM hits WHERE page_key % 29 <> 0"""))
def q_explode_responses(spark, sf):
    return I.explode_responses(X.responses_df(spark, sf), AS_OF).select(
        "jobNo", "jobName", "search_keyword", "page_key", "page_block", "pos", "crawl_date", "status", "area_code", "area_name")


@register("merged_keywords", with_hits(f"""
SELECT ids.jobNo, ids.custName, coalesce(array_to_string(kl.search_keyword, '|'), '') AS search_keyword
FROM (SELECT jobNo, min(custName) AS custName FROM hits WHERE jobNo IS NOT NULL GROUP BY 1) ids
LEFT JOIN ({KEYWORD_LISTS_SQL}) kl ON kl.jobNo = ids.jobNo"""))
def q_merged_keywords(spark, sf):
    m = I.merge_postings(X.hits_df(spark, sf).drop("page_key", "page_block"))
    return m.select("jobNo", "custName", F.array_join("search_keyword", "|").alias("search_keyword"))


@register("response_classes", with_hits("""
SELECT CASE WHEN page_key % 29 = 0 THEN 'error' ELSE 'valid' END AS response_class, count(*) AS page_count
FROM (SELECT DISTINCT search_keyword, page_key, page_block FROM hits) GROUP BY 1"""))
def q_response_classes(spark, sf):
    return I.response_classes(X.responses_df(spark, sf))


@register("response_classes_odd", with_hits("""
SELECT CASE WHEN page_key % 29 = 0 THEN 'error' WHEN page_key % 7 = 0 THEN 'no_data' WHEN page_key % 5 = 0 THEN 'no_list'
       ELSE 'valid' END AS response_class, count(*) AS page_count,
       CAST(coalesce(sum(n) FILTER (WHERE page_key % 29 <> 0 AND page_key % 7 <> 0 AND page_key % 5 <> 0), 0) AS BIGINT) AS hits
FROM (SELECT search_keyword, page_key, page_block, count(*) AS n FROM hits GROUP BY ALL) GROUP BY 1"""))
def q_response_classes_odd(spark, sf):
    """S20 with all four classes: some pages have no data, others data without a list."""
    data = F.col("result.data")
    data = F.when(F.col("page_key") % 7 != 0, F.when(F.col("page_key") % 5 == 0, data.withField(
        "list", F.lit(None).cast(I.RESPONSE_TYPE["result"].dataType["data"].dataType["list"].dataType))).otherwise(data))
    pages = X.responses_df(spark, sf).withColumn("result", F.col("result").withField("data", data))
    hits = pages.groupBy(I.response_class().alias("response_class")).agg(
        F.sum(F.when(I.response_class() == "valid", F.size("result.data.list")).otherwise(0)).alias("hits"))
    return I.response_classes(pages).join(hits, "response_class")


@register("fetch_stats", with_hits("""
SELECT keyword, count(*) FILTER (WHERE page_key % 29 <> 0) AS pages_ok,
       count(*) FILTER (WHERE page_key % 29 = 0) AS pages_failed,
       CAST(coalesce(sum(n) FILTER (WHERE page_key % 29 <> 0), 0) AS BIGINT) AS jobs_fetched
FROM (SELECT search_keyword AS keyword, page_key, page_block, count(*) AS n FROM hits GROUP BY 1, 2, 3)
GROUP BY 1"""))
def q_fetch_stats(spark, sf):
    return I.fetch_stats(X.responses_df(spark, sf))


def _state_batch(spark, sf):
    """Stored state and a day's batch: every posting is on one side at least; the batch renames its postings."""
    jobs = X.jobs_df(spark, sf)
    k = F.col("jobNo").cast("bigint")
    state = jobs.where(k % 3 != 0)
    batch = (jobs.where((k % 4 != 0) | (k % 3 == 0)).drop(*L.STATE_ONLY)
             .withColumn("jobName", F.concat("jobName", F.lit(" (update)"))).withColumn("crawl_date", F.lit(AS_OF)))
    return state, batch


IN_BATCH = "(CAST(jobNo AS BIGINT) % 4 <> 0 OR CAST(jobNo AS BIGINT) % 3 = 0)"


def _sync_sql(delist):
    """All columns of the next snapshot, and ``change``."""
    return f"""
WITH jobs AS ({JOBS_SQL}),
st AS (SELECT * FROM jobs WHERE CAST(jobNo AS BIGINT) % 3 <> 0),
bt AS (SELECT * REPLACE (jobName || ' (update)' AS jobName, {AS_OF_SQL} AS crawl_date) FROM jobs WHERE {IN_BATCH}),
j AS (SELECT CASE WHEN bt.jobNo IS NOT NULL THEN bt ELSE st END AS r, st.jobNo IS NOT NULL AS in_s,
             bt.jobNo IS NOT NULL AS in_b, coalesce(st.status, 'active') AS s_status, st.delisted_date AS s_del,
             st.discovery_date AS s_disc, st.last_update_date AS s_upd
      FROM st FULL OUTER JOIN bt ON st.jobNo = bt.jobNo),
c AS (SELECT *, CASE WHEN in_s AND in_b AND s_status = 'inactive' THEN 'reactivated'
                     WHEN in_s AND in_b THEN 'kept' WHEN in_b THEN 'new'
                     WHEN {delist} AND (SELECT count(*) FROM bt) > 0 AND s_status = 'active' THEN 'delisted'
                     ELSE 'untouched' END AS change FROM j),
w AS (SELECT unnest(r), c.* EXCLUDE (r) FROM c),
snap AS (SELECT * EXCLUDE (in_s, in_b, s_status, s_del, s_disc, s_upd) REPLACE (
       CASE WHEN change IN ('new', 'kept', 'reactivated') THEN 'active' WHEN change = 'delisted' THEN 'inactive' ELSE s_status END AS status,
       CASE WHEN change IN ('new', 'reactivated') THEN NULL WHEN change = 'delisted' THEN strftime({AS_OF_SQL}, '%Y-%m-%d') ELSE s_del END AS delisted_date,
       CASE WHEN change = 'new' THEN {AS_OF_SQL} ELSE s_disc END AS discovery_date,
       CASE WHEN change = 'untouched' THEN s_upd ELSE {AS_OF_SQL} END AS last_update_date) FROM w)
"""


LIFECYCLE_SQL = _sync_sql("true")


@register("lifecycle_sync", LIFECYCLE_SQL + "SELECT * FROM snap")
def q_lifecycle_sync(spark, sf):
    state, batch = _state_batch(spark, sf)
    return L.sync_snapshot(state, batch, AS_OF)


@register("upsert_job_rows", _sync_sql("false") + "SELECT * FROM snap")
def q_upsert_job_rows(spark, sf):
    """The stored postings after an upsert, with their update date."""
    state, batch = _state_batch(spark, sf)
    return L.upsert(state, batch, AS_OF)


@register("lifecycle_change_counts", LIFECYCLE_SQL + "SELECT change, count(*) AS n FROM snap GROUP BY 1")
def q_lifecycle_change_counts(spark, sf):
    state, batch = _state_batch(spark, sf)
    return L.change_counts(L.sync_snapshot(state, batch, AS_OF))


@register("upsert_jobs", f"""
WITH jobs AS ({JOBS_SQL}),
st AS (SELECT jobNo FROM jobs WHERE CAST(jobNo AS BIGINT) % 3 <> 0),
bt AS (SELECT jobNo FROM jobs WHERE {IN_BATCH})
SELECT count(*) FILTER (WHERE st.jobNo IS NULL) AS inserted, count(*) FILTER (WHERE st.jobNo IS NOT NULL) AS modified
FROM bt LEFT JOIN st ON bt.jobNo = st.jobNo""")
def q_upsert_jobs(spark, sf):
    state, batch = _state_batch(spark, sf)
    return L.upsert_counts(state, batch)


@register("existing_statuses", f"""WITH jobs AS ({JOBS_SQL})
SELECT status, count(*) AS n FROM jobs GROUP BY 1""")
def q_existing_statuses(spark, sf):
    return L.existing_statuses(X.jobs_df(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("crawl_log_upsert", with_hits(f"""
, pages AS (SELECT DISTINCT search_keyword AS keyword, page_key, page_block FROM hits)
SELECT keyword, {URL_SQL.format(kw='keyword', page='page_block + 1', area='CAST(page_key AS VARCHAR)')} AS crawl_url,
       CASE WHEN page_key % 2 = 0 THEN 'ok' WHEN page_key % 29 = 0 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN page_key % 2 = 0 THEN 1 ELSE 0 END AS seq
FROM pages"""))
def q_crawl_log_upsert(spark, sf):
    r = X.responses_df(spark, sf)
    old = I.crawl_log_from_responses(r, seq=0)
    # a second fetch of the even pages, all successful
    new = r.where(F.col("page_key") % 2 == 0).select(
        "today", "keyword", "first_url", "crawl_url", F.lit("ok").alias("status"),
        F.lit(None).cast("int").alias("total_count"), F.lit(1).alias("seq"))
    return L.crawl_log_upsert(old, new).select("keyword", "crawl_url", "status", "seq")


def _frontier(spark, sf):
    kws = X.hits_df(spark, sf).where(F.col("search_keyword").isNotNull()) \
        .select(F.col("search_keyword").alias("keyword")).distinct()
    areas = X.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("area_code"), F.col("n_name").alias("area_name"),
        (F.col("n_nationkey") % 5 + 1).cast("int").alias("total_page"))
    return I.crawl_frontier(kws, areas)


FRONTIER_SQL = f"""WITH hits AS ({HITS_SQL}),
kw AS (SELECT DISTINCT search_keyword AS keyword FROM hits WHERE search_keyword IS NOT NULL),
fr AS (SELECT kw.keyword, CAST(n.n_nationkey AS VARCHAR) AS area_code, n.n_name AS area_name,
              CAST(p.page AS INTEGER) AS page
       FROM kw, nation n, LATERAL (SELECT unnest(range(1, n.n_nationkey % 5 + 2)) AS page) p),
fu AS (SELECT *, {URL_SQL.format(kw='keyword', page='page', area='area_code')} AS crawl_url,
              {URL_SQL.format(kw='keyword', page='1', area='area_code')} AS first_url FROM fr)
"""


@register("crawl_frontier", FRONTIER_SQL + "SELECT * FROM fu")
def q_crawl_frontier(spark, sf):
    return _frontier(spark, sf)


@register("frontier_pending", FRONTIER_SQL + "SELECT * FROM fu WHERE page % 2 = 0")
def q_frontier_pending(spark, sf):
    fr = _frontier(spark, sf)
    log = fr.where(F.col("page") % 2 == 1).select(
        F.lit(AS_OF.isoformat()).alias("today"), "crawl_url", "first_url", F.lit("ok").alias("status"))
    return I.frontier_pending(fr, log, AS_OF)


@register("page_keyword_match", with_hits("""
SELECT search_keyword AS keyword, page_key, page_block FROM (SELECT DISTINCT search_keyword, page_key, page_block FROM hits)
WHERE search_keyword IN ('Python', 'SRE')"""))
def q_page_keyword_match(spark, sf):
    path = scratch_path(spark, "pages")  # stored once, as they are matched in several ways, without their postings
    with shuffles_released(spark):
        X.responses_df(spark, sf).select("keyword", "page_key", "page_block", "url", "crawl_url").write.parquet(path)
    r = spark.read.parquet(path)
    plan = r.where(F.col("keyword").isin("Python", "SRE")).select("keyword", "crawl_url")
    return I.page_keyword_match(r, plan).select("keyword", "page_key", "page_block")


def _moved_pages(spark, sf, counted=False):
    """Pages whose keyword or URL isn't the planned one: foreign or no keyword, URL with a suffix or inside another URL.

    Stored once, as they are matched in several ways, without their postings; ``counted`` adds these' number ``n``.
    """
    page = F.col("page_key")
    url = F.when(page % 7 == 0, F.concat(F.lit("https://r.example/?to="), "url", F.lit("&x=1"))) \
        .when(page % 3 == 0, F.concat("url", F.lit("&ref=mail"))).when(page % 11 == 0, F.lit(None)).otherwise(F.col("url"))
    keyword = F.when(page % 5 == 0, F.lit(None)).when(page % 5 == 1, F.lit("SRE")).otherwise(F.col("keyword"))
    n = [F.when(I.response_class() == "valid", F.size("result.data.list")).alias("n")] if counted else []
    path = scratch_path(spark, "moved-pages")
    moved = X.responses_df(spark, sf).select("page_key", "page_block", F.col("keyword").alias("fetched_for"), keyword.alias("keyword"),
                                             url.alias("url"), "crawl_url", *n)
    with shuffles_released(spark):
        moved.write.parquet(path)
    pages = spark.read.parquet(path)
    plan = pages.where(page % 4 != 0).select(F.col("fetched_for").alias("keyword"), "crawl_url")
    return pages.drop("crawl_url"), plan


MOVED_SQL = """, pages AS (SELECT search_keyword AS fetched_for, page_key, page_block, count(*) AS n FROM hits GROUP BY ALL),
moved AS (SELECT *, CASE WHEN page_key % 5 = 0 THEN NULL WHEN page_key % 5 = 1 THEN 'SRE' ELSE fetched_for END AS keyword,
                 page_key % 7 = 0 OR page_key % 3 = 0 OR page_key % 11 <> 0 AS has_url FROM pages),
plan AS (SELECT DISTINCT fetched_for AS matched_keyword FROM pages WHERE page_key % 4 <> 0 AND fetched_for IS NOT NULL),
matched AS (
  SELECT m.*, plan.matched_keyword FROM moved m JOIN plan ON m.keyword = plan.matched_keyword
  UNION
  SELECT m.*, fetched_for FROM moved m WHERE has_url AND page_key % 4 <> 0 AND fetched_for IS NOT NULL)
"""


@register("page_keyword_or_url", with_hits(MOVED_SQL + """
SELECT page_key, page_block, fetched_for, keyword, matched_keyword FROM matched"""))
def q_page_keyword_or_url(spark, sf):
    """Pages with a foreign or null keyword, or a longer URL, still belong to the keyword that planned the URL."""
    pages, plan = _moved_pages(spark, sf)
    return I.page_keyword_match(pages, plan).select("page_key", "page_block", "fetched_for", "keyword", "matched_keyword")


@register("matched_page_hits", with_hits(MOVED_SQL + """
SELECT matched_keyword, count(*) AS pages, CAST(sum(n) FILTER (WHERE page_key % 29 <> 0) AS BIGINT) AS hits
FROM matched GROUP BY 1"""))
def q_matched_page_hits(spark, sf):
    """J13 -> P21: the postings of a page are tagged with each keyword it belongs to."""
    pages, plan = _moved_pages(spark, sf, counted=True)  # the joins carry no postings
    tagged = I.page_keyword_match(pages, plan).withColumn("keyword", F.col("matched_keyword"))
    return tagged.groupBy("matched_keyword").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("hits"))


def _open_day(spark, sf, day):
    """Response files of a crawl day whose postings have fields that no code names (their names come from the data)."""
    pages = X.responses_df(spark, sf).where(I.response_class() == "valid")
    pages = pages if day == 1 else pages.where(F.col("page_key") % 3 == 0)

    def posting(p):
        k = F.coalesce(p["jobNo"].cast("long"), F.lit(0))
        name = p["jobName"] if day == 1 else F.concat(p["jobName"], F.lit(" (day 2)"))
        text = F.to_json(p.withField("jobName", name))
        number = k % 7 if day == 1 else F.when(k % 2 == 0, F.lit(100))
        field = F.concat(F.lit(',"extra_'), k % 5, F.lit('":'), number)
        late = F.concat(F.lit(',"late_'), k % 3, F.lit('":{"note":"v'), k % 4, F.lit('"}'))
        more = [field] if day == 1 else [field, late]
        return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.concat_ws("", *more), F.lit("}"))

    head = F.to_json(F.struct("today", "url", "keyword", "page_key", "page_block", "status"))
    body = F.array_join(F.transform("result.data.list", posting), ",")
    path = scratch_path(spark, "responses")
    lines = pages.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"result":{"data":{"totalPage":1,"list":['),
                                  body, F.lit("]}}}")).alias("value"))
    with shuffles_released(spark):
        lines.write.text(path, compression="gzip")
    return path


@register("open_fields_snapshot", with_hits("""
, d1 AS (SELECT DISTINCT jobNo, jobName, custName, CAST(jobNo AS BIGINT) AS k FROM hits WHERE jobNo IS NOT NULL AND page_key % 29 <> 0),
d2 AS (SELECT DISTINCT jobNo FROM hits WHERE jobNo IS NOT NULL AND page_key % 29 <> 0 AND page_key % 3 = 0),
j AS (SELECT d1.*, d2.jobNo IS NOT NULL AS again FROM d1 LEFT JOIN d2 ON d1.jobNo = d2.jobNo)
SELECT jobNo, CASE WHEN again THEN jobName || ' (day 2)' ELSE jobName END AS jobName, custName,
       CASE WHEN again THEN 'active' ELSE 'inactive' END AS status,
       'extra_' || k % 5 || '=' || CASE WHEN again AND k % 2 = 0 THEN 100 ELSE k % 7 END
       || CASE WHEN again THEN ',late_' || k % 3 || '={"note":"v' || k % 4 || '"}' ELSE '' END AS unnamed
FROM j"""))
def q_open_fields_snapshot(spark, sf):
    """Fields that no code names reach the snapshot, and stay through the next day's upsert unless it sets them."""
    base = scratch_path(spark, "snapshots")
    for day in (1, 2):
        path = _open_day(spark, sf, day)
        run_crawl_day(spark, path, base, AS_OF + dt.timedelta(days=day - 1))
        drop_scratch(spark, path)  # the day's files are read
    named = F.array(*[F.lit(f.name) for f in I.POSTING_TYPE])
    fields = F.map_entries(F.map_filter(F.variant_get("doc", "$", "map<string,variant>"),
                                        lambda k, _: ~F.array_contains(named, k)))
    text = F.transform(fields, lambda e: F.concat(e["key"], F.lit("="), F.to_json(e["value"])))
    return SN.latest_snapshot(spark, base).select("jobNo", "jobName", "custName", "status",
                                                  F.array_join(F.array_sort(text), ",").alias("unnamed"))


ROW = ["jobNo", "jobName", "custName", "coIndustryDesc", "jobDetail", "jobAddrNo", "jobAddrNoDesc", "area_code", "area_name",
       "appearDate", "salaryDesc", "applyDesc", "periodDesc", "optionEdu", "applyAnalyze", "job", "cust", "city", "district"]
LIFE = ["status", "delisted_date", "discovery_date", "last_update_date", "crawl_date"]


def _crawled_sql(pages, name):
    """Postings of the valid pages ``pages``, with their keywords in the order in which the pages show them."""
    return f"""
{name}_ex AS (SELECT *, row_number() OVER (PARTITION BY search_keyword, page_key, page_block
                                           ORDER BY ord_line, ord_part, ord_supp, ord_price, ord_okey) AS pos
              FROM hits WHERE page_key % 29 <> 0 AND {pages}),
{name}_kw AS (SELECT jobNo, string_agg(search_keyword, '|' ORDER BY o) AS search_keyword
              FROM (SELECT jobNo, search_keyword, min((page_key, page_block, pos, search_keyword)) AS o
                    FROM {name}_ex WHERE search_keyword IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
{name} AS (SELECT p.*, coalesce(w.search_keyword, '') AS search_keyword
           FROM (SELECT DISTINCT * EXCLUDE (search_keyword, ord_line, ord_part, ord_supp, ord_price, ord_okey, page_key, page_block, pos, jobNo_raw),
                        coalesce(jobAddrNo, '') AS area_code, coalesce(jobAddrNoDesc, '') AS area_name,
                        {X.sql_city("jobAddrNoDesc")} AS city, {X.sql_district("jobAddrNoDesc")} AS district
                 FROM {name}_ex WHERE jobNo IS NOT NULL) p LEFT JOIN {name}_kw w USING (jobNo))"""


def _crawl_day_sql(batches, closed_by):
    """Snapshot after ``batches`` (later ones win), delisting what none of them saw, as ``closed_by`` says."""
    names = [f"b{k}" for k in range(len(batches))]
    later = names[::-1]

    def pick(c):
        return "CASE " + " ".join(f"WHEN {b}.jobNo IS NOT NULL THEN {b}.{c}" for b in later) + f" ELSE st.{c} END AS {c}"

    crawled = ", ".join(_crawled_sql(pages, name) for pages, name in zip(batches, names, strict=True))
    ids = " UNION ".join(f"SELECT jobNo FROM {n}" for n in ["st", *names])
    joins = " ".join(f"LEFT JOIN {n} ON ids.jobNo = {n}.jobNo" for n in ["st", *names])
    columns = ", ".join(pick(c) for c in [*ROW[1:], "search_keyword"])
    return f"""WITH hits AS ({HITS_SQL}), jobs AS ({JOBS_SQL}),
st AS (SELECT * REPLACE (array_to_string(search_keyword, '|') AS search_keyword) FROM jobs WHERE CAST(jobNo AS BIGINT) % 3 <> 0),
{crawled}, ids AS ({ids}),
j AS (SELECT ids.jobNo, {columns}, st.jobNo IS NOT NULL AS in_s, {" OR ".join(f"{n}.jobNo IS NOT NULL" for n in names)} AS in_b,
             st.status AS s_status, st.delisted_date AS s_del, st.discovery_date AS s_disc, st.last_update_date AS s_upd,
             st.crawl_date AS s_crawl
      FROM ids {joins}),
c AS (SELECT *, in_s AND NOT in_b AND s_status = 'active' AND {closed_by} AS gone FROM j)
SELECT * EXCLUDE (in_s, in_b, s_status, s_del, s_disc, s_upd, s_crawl, gone),
       CASE WHEN in_b THEN 'active' WHEN gone THEN 'inactive' ELSE s_status END AS status,
       CASE WHEN gone THEN strftime({AS_OF_SQL}, '%Y-%m-%d') WHEN in_b AND s_status = 'active' THEN s_del
            WHEN in_b THEN NULL ELSE s_del END AS delisted_date,
       CASE WHEN in_s THEN s_disc ELSE {AS_OF_SQL} END AS discovery_date,
       CASE WHEN in_b OR gone THEN {AS_OF_SQL} ELSE s_upd END AS last_update_date,
       CASE WHEN in_b THEN {AS_OF_SQL} ELSE s_crawl END AS crawl_date FROM c"""


def _stored(spark, sf):
    """A snapshot folder whose newest version holds two thirds of the postings."""
    base = scratch_path(spark, "snapshots")
    with shuffles_released(spark):
        SN.write_snapshot(X.jobs_df(spark, sf).where(F.col("jobNo").cast("long") % 3 != 0), SN.next_path(spark, base))
    return base


def _pages_file(spark, sf, where):
    path = scratch_path(spark, "responses")
    with shuffles_released(spark):
        X.responses_df(spark, sf).where(where).write.json(path, compression="gzip")
    return path


def _snapshot_rows(spark, base):
    return SN.latest_snapshot(spark, base).select(*ROW, *LIFE, F.array_join("search_keyword", "|").alias("search_keyword"))


@register("crawl_day_snapshot", _crawl_day_sql(["true"], "(SELECT count(*) FROM b0) > 0"))
def q_crawl_day_snapshot(spark, sf):
    """All columns of the next snapshot after ``run_crawl_day``."""
    base = _stored(spark, sf)
    path = _pages_file(spark, sf, "true")
    run_crawl_day(spark, path, base, AS_OF)
    drop_scratch(spark, path)  # the day's files are read
    return _snapshot_rows(spark, base)


@register("closed_day_snapshot", _crawl_day_sql(
    ["page_key % 2 = 0", "page_key % 2 = 1"],
    f"s_upd < {AS_OF_SQL} AND ((SELECT count(*) FROM b0) + (SELECT count(*) FROM b1) > 0 OR EXISTS (SELECT 1 FROM st WHERE last_update_date = {AS_OF_SQL}))"))
def q_closed_day_snapshot(spark, sf):
    """R6 as a stream runs it: two parts of a day upserted, then the day closed; postings that the day updated stay."""
    base = _stored(spark, sf)
    for half in (0, 1):
        path = _pages_file(spark, sf, f"page_key % 2 = {half}")
        apply_batch(spark, spark.read.schema(I.OPEN_RESPONSE_TYPE).json(path), base, as_of=AS_OF)
        drop_scratch(spark, path)  # its files are read
    close_crawl_day(spark, base, AS_OF)
    return _snapshot_rows(spark, base)


@register("existing_status_rows", f"""WITH jobs AS ({JOBS_SQL}) SELECT jobNo, coalesce(status, 'active') AS status FROM jobs""")
def q_existing_status_rows(spark, sf):
    return L.existing_statuses(X.jobs_df(spark, sf))


@register("crawl_log_rows", with_hits(f"""
, pages AS (SELECT search_keyword AS keyword, page_key, page_block, count(*) AS n FROM hits GROUP BY ALL)
SELECT '{AS_OF.isoformat()}' AS today, keyword, {URL_SQL.format(kw='keyword', page='page_block + 1', area='CAST(page_key AS VARCHAR)')} AS first_url,
       {URL_SQL.format(kw='keyword', page='page_block + 1', area='CAST(page_key AS VARCHAR)')} AS crawl_url,
       CASE WHEN page_key % 2 = 0 OR page_key % 29 <> 0 THEN 'ok' ELSE 'error' END AS status,
       CAST(CASE WHEN page_key % 2 = 0 THEN page_block WHEN page_key % 29 <> 0 THEN n END AS INTEGER) AS total_count,
       CASE WHEN page_key % 2 = 0 THEN 1 ELSE 0 END AS seq
FROM pages"""))
def q_crawl_log_rows(spark, sf):
    """The whole log after a second fetch of the even pages."""
    r = X.responses_df(spark, sf)
    again = r.where(F.col("page_key") % 2 == 0).select(
        "today", "keyword", "first_url", "crawl_url", F.lit("ok").alias("status"),
        F.col("page_block").cast("int").alias("total_count"), F.lit(1).alias("seq"))
    return L.crawl_log_upsert(I.crawl_log_from_responses(r, seq=0), again)


@register("daily_ingest_batch", f"""
WITH jobs AS ({JOBS_SQL}), hits AS ({HITS_SQL}),
st AS (SELECT jobNo, status FROM jobs),
bt AS (SELECT DISTINCT jobNo FROM hits WHERE jobNo IS NOT NULL AND page_key % 29 <> 0),
j AS (SELECT st.jobNo IS NOT NULL AS in_s, bt.jobNo IS NOT NULL AS in_b, coalesce(st.status, 'active') AS s_status
      FROM st FULL OUTER JOIN bt ON st.jobNo = bt.jobNo)
SELECT CASE WHEN in_s AND in_b AND s_status = 'inactive' THEN 'reactivated' WHEN in_s AND in_b THEN 'kept'
            WHEN in_b THEN 'new' WHEN s_status = 'active' THEN 'delisted' ELSE 'untouched' END AS change,
       count(*) AS n
FROM j GROUP BY 1""")
def q_daily_ingest_batch(spark, sf):
    """Responses -> posting batch -> lifecycle merge against the stored state."""
    from hirelens.plans.reports import daily_ingest
    return daily_ingest(X.responses_df(spark, sf), X.jobs_df(spark, sf), as_of=AS_OF)["change_counts"]
