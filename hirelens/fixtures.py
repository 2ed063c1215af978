"""Derive job-market inputs from the driver tables (orders, customer, lineitem, nation).

The rules are plain key arithmetic, stated once here and twice in code: as
Spark DataFrames (``hits_df``, ``jobs_df``, ``responses_df``) and as
DuckDB SQL (``HITS_SQL``, ``JOBS_SQL``, ...) so every operator can be checked
against an independent SQL engine on the same parquet files.

* ``raw_hits``  one row per search hit  <- lineitem ⋈ orders ⋈ customer
* ``jobs``      one row per posting     <- orders ⋈ customer, keywords merged from raw_hits
* ``responses`` one row per fetched search page <- raw_hits grouped by (keyword, l_suppkey)

``AS_OF`` (2001-08-02) replaces every "now".
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens import constants as C
from hirelens.functions import parsing as P

AS_OF = dt.date(2001, 8, 2)
AS_OF_SQL = "DATE '2001-08-02'"

# Fixture vocabularies (test data only; chosen to hit every parser branch).
ADDRESSES = ["台北市大安區", "台北市信義區", "新北市板橋區", "桃園市中壢區", "新竹市",
             "新竹縣竹北市", "台中市西屯區", "高雄市", "日本", "台北市大安區信義路"]
SALARIES = ["月薪40,000~60,000元", "月薪50,000元", "時薪200元", "待遇面議",
            "月薪40,000元以上", "", None, "月薪1~2~3元"]
APPLY_BANDS = ["0~5人應徵", "6~10人應徵", "11~30人應徵", "大於30人應徵", None]
EXPERIENCE = ["不拘", "1年以上", "3年以上", None]
EDUCATION = ["高中", "專科", "大學", "碩士"]
KEYWORDS = ["Python", "django", "fastapi", "flask", "DevOps", "SRE", "K8S", "JAVA"]
LINK_HOST = "//www.104.com.tw"
# A fetched page holds the hits of one (keyword, supplier, block of PAGE_ORDERS
# orders): page size stays bounded however large the tables grow.
PAGE_ORDERS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_PLANS: dict = {}
_PUBLISHED: dict = {}


def _memo(fn):
    """Reuse the (immutable) fixture DataFrame per (session, folder, args).

    Only the logical plan object is reused — building it costs hundreds of
    py4j calls.  When ``publish_fixtures`` has written the derived tables
    (the production shape: derive once a day, query many times), the
    published Parquet copy is read instead of deriving again.
    """
    def wrapper(spark, sf_dir, *args):
        key = (fn.__name__, id(spark), sf_dir, args)
        hit = _PLANS.get(key)
        if hit is None or hit[0] is not spark:
            path = _PUBLISHED.get((fn.__name__, sf_dir, args))
            df = spark.read.parquet(path) if path else fn(spark, sf_dir, *args)
            hit = (spark, df)
            _PLANS[key] = hit
        return hit[1]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    wrapper.derive = fn
    return wrapper


def publish_fixtures(spark: SparkSession, sf_dir: str, base_path: str) -> dict[str, str]:
    """Derive ``jobs``, ``raw_hits`` and ``responses`` once and publish them as
    Parquet under ``base_path``; later fixture calls for ``sf_dir`` read them.
    Returns name -> path.
    """
    out = {}
    for fn in (jobs_df, hits_df, responses_df):  # responses reads the just-published hits
        path = f"{base_path.rstrip('/')}/{fn.__name__}"
        fn.derive(spark, sf_dir).write.mode("overwrite").parquet(path)
        _PUBLISHED[(fn.__name__, sf_dir, ())] = path
        out[fn.__name__] = path
        for k in [k for k in _PLANS if k[2] == sf_dir]:
            del _PLANS[k]
    return out


def unpublish_fixtures(sf_dir: str) -> None:
    """Forget published copies for ``sf_dir`` (derive from the driver tables again)."""
    for k in [k for k in _PUBLISHED if k[1] == sf_dir]:
        del _PUBLISHED[k]
    for k in [k for k in _PLANS if k[2] == sf_dir]:
        del _PLANS[k]


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
def _pick(values, idx: Column) -> Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string") if v is not None else F.lit(None).cast("string")
        expr = F.when(idx == i, lit) if expr is None else expr.when(idx == i, lit)
    return expr


def _posting_cols(k: Column, odate: Column, ostatus: Column, prio: Column,
                  custkey: Column, cname: Column, seg: Column, nationkey: Column) -> dict:
    """Posting fields that depend only on the order (k) and its customer."""
    inactive = ostatus == "F"
    kmod = lambda m: k % m
    delisted = (F.when(~inactive, F.lit(None).cast("string"))
                .when(kmod(41) == 0, F.lit(None).cast("string"))
                .when(kmod(53) == 0, F.lit("n/a"))
                .when(kmod(50) == 0, F.date_format(F.date_sub(odate, 3), "yyyy-MM-dd"))
                .otherwise(F.date_format(F.date_add(odate, kmod(120).cast("int")), "yyyy-MM-dd")))
    addr = _pick(ADDRESSES, nationkey % 10)
    return {
        "jobNo": k.cast("string"),
        "jobName": F.concat(F.lit("role-"), kmod(40).cast("string")),
        "custName": cname,
        "coIndustryDesc": F.when(kmod(97) == 0, F.lit(None).cast("string")).otherwise(seg),
        "jobDetail": F.when(kmod(11) == 0, F.lit(None).cast("string")).otherwise(prio),
        "jobAddrNo": (F.lit(6001001000) + nationkey % 10).cast("string"),
        "jobAddrNoDesc": addr,
        "appearDate": F.date_format(odate, "yyyyMMdd"),
        "salaryDesc": _pick(SALARIES, kmod(8)),
        "applyDesc": _pick(APPLY_BANDS, kmod(5)),
        "periodDesc": _pick(EXPERIENCE, kmod(4)),
        "optionEdu": _pick(EDUCATION, F.floor(k / 4) % 4),
        "link": F.struct(
            F.concat(F.lit(LINK_HOST + "/jobs/apply/analysis/"), k.cast("string")).alias("applyAnalyze"),
            F.concat(F.lit(LINK_HOST + "/job/"), k.cast("string")).alias("job"),
            F.when(kmod(3) == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("https://www.104.com.tw/company/"), custkey.cast("string"))).alias("cust")),
        "status": F.when(inactive, F.lit("inactive")).otherwise(F.lit("active")),
        "delisted_date": delisted,
    }


def _orders_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("o_orderdate"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey, "inner")


def _hit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit with its order and customer."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    oc = _orders_customers(spark, sf_dir)
    return li.join(oc, li.l_orderkey == oc.o_orderkey, "inner")


def _keyword_no() -> Column:
    """Place of a hit's keyword in KEYWORDS; null for no keyword."""
    no = (F.col("l_partkey") % len(KEYWORDS)).cast("tinyint")
    return F.when(F.col("l_suppkey") % 37 == 0, F.lit(None).cast("tinyint")).when(no >= 0, no)


def _hit_place() -> dict[str, Column]:
    """Keyword, page and arrival ordinal of a hit."""
    return {
        "search_keyword": F.when(F.col("l_suppkey") % 37 == 0, F.lit(None).cast("string"))
        .otherwise(_pick(KEYWORDS, F.col("l_partkey") % 8)),
        "ord": F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                        F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"),
                        F.col("l_orderkey").alias("okey")),
        "page_key": F.col("l_suppkey"), "page_block": F.floor(F.col("l_orderkey") / PAGE_ORDERS)}


def _hit_posting_cols(k: Column, part: Column, order) -> dict[str, Column]:
    """A hit's posting fields; ``order`` gives the columns of its order and customer by name."""
    cols = _posting_cols(k, order("o_orderdate"), order("o_orderstatus"), order("o_orderpriority"), order("o_custkey"),
                         order("c_name"), order("c_mktsegment"), order("c_nationkey"))
    cols["jobNo"] = F.when(part % 101 == 0, F.lit(None).cast("string")).otherwise(cols["jobNo"])
    return cols


@_memo
def hits_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_hits: one row per hit, with the arrival ordinal ``ord``."""
    cols = _hit_posting_cols(F.col("o_orderkey"), F.col("l_partkey"), F.col) | _hit_place()
    return _hit_orders(spark, sf_dir).select(*[c.alias(n) for n, c in cols.items()])


ORDER = ("o_orderdate", "o_orderstatus", "o_orderpriority", "o_custkey", "c_name", "c_mktsegment", "c_nationkey")
POSTING = ("jobNo", "jobName", "custName", "coIndustryDesc", "jobDetail", "jobAddrNo", "jobAddrNoDesc",
           "link", "appearDate", "salaryDesc", "applyDesc", "periodDesc", "optionEdu")


def _hit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword_no, page_key, page_block and ``h``: ordinal, and the order's columns that the posting is made of.

    What is dealt by page are the tables' own columns and the keyword's number; ordinal and structs, which repeat
    them, and the keyword's text come after.
    """
    place = _hit_place()
    rows = _hit_orders(spark, sf_dir).select(_keyword_no().alias("keyword_no"), "l_linenumber", "l_partkey", "l_suppkey",
                                             "l_extendedprice", "l_orderkey", *ORDER)
    return rows.repartition("keyword_no", place["page_key"], place["page_block"]).select(
        "keyword_no", place["page_key"].alias("page_key"), place["page_block"].alias("page_block"), F.struct(place["ord"].alias("o"), F.struct(*ORDER).alias("order")).alias("h"))


@_memo
def hit_keywords_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (jobNo, search_keyword, ord) part of raw_hits, from lineitem alone.

    Enough for the keyword lists of ``jobs``: hits whose order does not exist
    drop out in the left join onto orders, so no lineitem ⋈ orders join is
    needed here.

    ``ord`` is a BIGINT ``line * 2^40 + part``.  Within one posting a
    non-null keyword is a function of (line, part) — it depends on part and,
    for NULL, on supplier — so two hits that tie on (line, part) carry the
    same keyword, and ordering keywords by (line, part) equals ordering by
    the full (line, part, supplier, price) tuple.  A numeric ordinal lets
    ``min`` run as a hash aggregation (a struct ordinal forces sort-based
    aggregation).  Part keys stay below 2^40 up to ~5 million scale factor.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return li.select(
        F.when(F.col("l_partkey") % 101 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("l_orderkey").cast("string")).alias("jobNo"),
        F.when(F.col("l_suppkey") % 37 == 0, F.lit(None).cast("string"))
         .otherwise(_pick(KEYWORDS, F.col("l_partkey") % 8)).alias("search_keyword"),
        (F.col("l_linenumber").cast("bigint") * F.lit(1 << 40) + F.col("l_partkey")).alias("ord"))


def link_string(link: Column) -> Column:
    """String form of the link struct (as stored by older crawls)."""
    parts = [F.concat(F.lit("'applyAnalyze': "), link.applyAnalyze),
             F.concat(F.lit("'job': "), link.job),
             F.when(link.cust.isNotNull(), F.concat(F.lit("'cust': "), link.cust))]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def keyword_lists_df(hits: DataFrame) -> DataFrame:
    """jobNo -> distinct keywords in first-seen order (A26, keyword half).

    Two aggregations, both with map-side partial aggregation: duplicates of
    (jobNo, keyword) collapse before the first shuffle, so a hot posting
    never ships all of its hits; the second one only sees distinct keywords.
    """
    per_kw = (hits.where(F.col("jobNo").isNotNull() & F.col("search_keyword").isNotNull())
              .groupBy("jobNo", "search_keyword").agg(F.min("ord").alias("kord")))
    return (per_kw.groupBy("jobNo")
            .agg(F.sort_array(F.collect_list(F.struct("kord", "search_keyword"))).alias("kw"))
            .select("jobNo", F.transform("kw", lambda e: e["search_keyword"]).alias("search_keyword")))


@_memo
def jobs_df(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> DataFrame:
    """jobs / news_jobs snapshot: one row per posting (unique jobNo)."""
    # keywords join the orders' own columns; a posting's texts come after the shuffles
    kws = keyword_lists_df(hit_keywords_df(spark, sf_dir))
    oc = _orders_customers(spark, sf_dir).withColumn("jobNo", F.col("o_orderkey").cast("string")).join(kws, "jobNo", "left")
    k = F.col("o_orderkey")
    cols = _posting_cols(k, F.col("o_orderdate"), F.col("o_orderstatus"), F.col("o_orderpriority"),
                         F.col("o_custkey"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey"))
    link = cols.pop("link")
    urls = P.link_urls_from_struct(link)
    ao = F.lit(as_of)
    base = oc.select(
        *[c.alias(n) for n, c in cols.items()],
        cols["jobAddrNo"].alias("area_code"),  # P21: area fields copy the address fields
        cols["jobAddrNoDesc"].alias("area_name"),
        urls.applyAnalyze.alias("applyAnalyze"),
        urls.job.alias("job"),
        urls.cust.alias("cust"),
        F.date_sub(ao, (k % 10).cast("int")).alias("crawl_date"),
        F.date_sub(ao, (k % 10).cast("int")).alias("last_update_date"),
        F.col("o_orderdate").alias("discovery_date"),
        F.coalesce("search_keyword", F.array().cast("array<string>")).alias("search_keyword"),
    )
    base = P.with_city_district(base)
    return base.select(*[c for c in base.columns if c != "search_keyword"], "search_keyword")


@_memo
def responses_df(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> DataFrame:
    """One fetched search page per (keyword, l_suppkey, l_orderkey div 1000) group of hits.

    Pages with ``l_suppkey % 29 == 0`` are failed fetches (error text, null data).
    A page holds at most the hits of 1,000 orders, so the collected list per
    group is bounded no matter how large (or skewed) the tables are.
    """

    def posting(h: Column) -> Column:
        cols = _hit_posting_cols(h["o"]["okey"], h["o"]["part"], lambda c: h["order"][c])
        return F.struct(*[cols[c].alias(c) for c in POSTING])

    # a page's list is built from its hits' source columns, which are narrow; the posting's texts come after the shuffle
    g = _hit_sources(spark, sf_dir).groupBy("keyword_no", "page_key", "page_block").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.collect_list("h").alias("hits")) \
        .withColumn("keyword", _pick(KEYWORDS, F.col("keyword_no")))
    items = F.sort_array(F.transform("hits", lambda h: F.struct(h["o"].alias("o"), posting(h).alias("p"))))
    failed = F.col("page_key") % 29 == 0
    data = F.struct(F.lit(1).alias("totalPage"), F.col("n").alias("totalCount"), F.transform(items, lambda e: e["p"]).alias("list"))
    url = P.search_url(F.col("keyword"), F.col("page_block") + 1, F.col("page_key"))
    return g.select(
        F.lit(as_of.isoformat()).alias("today"),
        url.alias("url"), url.alias("first_url"), url.alias("crawl_url"),
        "keyword", "page_key", "page_block",
        F.when(failed, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.struct(F.when(failed, F.lit("upstream error")).alias("error"),
                 F.when(~failed, data).alias("data")).alias("result"))


# ---------------------------------------------------------------------------
# DuckDB side (oracle twins)
# ---------------------------------------------------------------------------
def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def _sql_pick(values, idx: str) -> str:
    return "CASE " + " ".join(f"WHEN {idx} = {i} THEN {_sql_lit(v)}" for i, v in enumerate(values)) + " END"


_P1 = C.ADDR_CITY_DISTRICT
_P2 = C.ADDR_CITY_ONLY


def sql_city(a: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR {a} = '' THEN NULL "
            f"WHEN regexp_matches({a}, '{_P1}') THEN regexp_extract({a}, '{_P1}', 1) "
            f"WHEN regexp_matches({a}, '{_P2}') THEN regexp_extract({a}, '{_P2}', 1) ELSE '' END")


def sql_district(a: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR {a} = '' THEN NULL "
            f"WHEN regexp_matches({a}, '{_P1}') THEN regexp_extract({a}, '{_P1}', 2) "
            f"WHEN regexp_matches({a}, '{_P2}') THEN '' ELSE {a} END")


def _sql_posting_cols(k: str) -> str:
    od = "CAST(o.o_orderdate AS DATE)"
    return f""",
      CAST({k} AS VARCHAR) AS jobNo_raw,
      'role-' || CAST({k} % 40 AS VARCHAR) AS jobName,
      c.c_name AS custName,
      CASE WHEN {k} % 97 = 0 THEN NULL ELSE c.c_mktsegment END AS coIndustryDesc,
      CASE WHEN {k} % 11 = 0 THEN NULL ELSE o.o_orderpriority END AS jobDetail,
      CAST(6001001000 + c.c_nationkey % 10 AS VARCHAR) AS jobAddrNo,
      {_sql_pick(ADDRESSES, 'c.c_nationkey % 10')} AS jobAddrNoDesc,
      strftime({od}, '%Y%m%d') AS appearDate,
      {_sql_pick(SALARIES, f'{k} % 8')} AS salaryDesc,
      {_sql_pick(APPLY_BANDS, f'{k} % 5')} AS applyDesc,
      {_sql_pick(EXPERIENCE, f'{k} % 4')} AS periodDesc,
      {_sql_pick(EDUCATION, f'(({k}) // 4) % 4')} AS optionEdu,
      CASE WHEN o.o_orderstatus = 'F' THEN 'inactive' ELSE 'active' END AS status,
      CASE WHEN o.o_orderstatus <> 'F' THEN NULL
           WHEN {k} % 41 = 0 THEN NULL
           WHEN {k} % 53 = 0 THEN 'n/a'
           WHEN {k} % 50 = 0 THEN strftime({od} - 3, '%Y-%m-%d')
           ELSE strftime({od} + CAST({k} % 120 AS INTEGER), '%Y-%m-%d') END AS delisted_date,
      'https:{LINK_HOST}/jobs/apply/analysis/' || CAST({k} AS VARCHAR) AS applyAnalyze,
      'https:{LINK_HOST}/job/' || CAST({k} AS VARCHAR) AS job,
      CASE WHEN {k} % 3 = 0 THEN '' ELSE 'https://www.104.com.tw/company/' || CAST(o.o_custkey AS VARCHAR) END AS cust"""


HITS_SQL = f"""
  SELECT CASE WHEN l.l_partkey % 101 = 0 THEN NULL ELSE CAST(o.o_orderkey AS VARCHAR) END AS jobNo,
         CASE WHEN l.l_suppkey % 37 = 0 THEN NULL ELSE {_sql_pick(KEYWORDS, 'l.l_partkey % 8')} END AS search_keyword,
         l.l_linenumber AS ord_line, l.l_partkey AS ord_part, l.l_suppkey AS ord_supp,
         l.l_extendedprice AS ord_price, l.l_orderkey AS ord_okey, l.l_suppkey AS page_key,
         l.l_orderkey // {PAGE_ORDERS} AS page_block{_sql_posting_cols('o.o_orderkey')}
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
"""

KEYWORD_LISTS_SQL = f"""
  SELECT jobNo, list(search_keyword ORDER BY ord_line, ord_part, ord_supp, ord_price) AS search_keyword
  FROM (SELECT *, row_number() OVER (PARTITION BY jobNo, search_keyword
                                     ORDER BY ord_line, ord_part, ord_supp, ord_price) AS rn
        FROM ({HITS_SQL}) h
        WHERE jobNo IS NOT NULL AND search_keyword IS NOT NULL) t
  WHERE rn = 1
  GROUP BY jobNo
"""

JOBS_SQL = f"""
  SELECT b.* EXCLUDE (jobNo_raw, k, odate), b.jobNo_raw AS jobNo,
         {sql_city('b.jobAddrNoDesc')} AS city,
         {sql_district('b.jobAddrNoDesc')} AS district,
         coalesce(kw.search_keyword, []::VARCHAR[]) AS search_keyword
  FROM (SELECT b0.*, b0.jobAddrNo AS area_code, b0.jobAddrNoDesc AS area_name,
               {AS_OF_SQL} - CAST(k % 10 AS INTEGER) AS crawl_date,
               {AS_OF_SQL} - CAST(k % 10 AS INTEGER) AS last_update_date,
               odate AS discovery_date
        FROM (SELECT o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS odate{_sql_posting_cols('o.o_orderkey')}
              FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) b0) b
  LEFT JOIN ({KEYWORD_LISTS_SQL}) kw ON kw.jobNo = b.jobNo_raw
"""


def with_jobs(sql_body: str) -> str:
    """Prefix a query with ``WITH jobs AS (...)``."""
    return f"WITH jobs AS ({JOBS_SQL})\n{sql_body}"


def with_hits(sql_body: str, extra: str = "") -> str:
    return f"WITH hits AS ({HITS_SQL}){extra}\n{sql_body}"
