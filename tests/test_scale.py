"""What tasks move, write and hold stays small: plans and files of the steps that grew faster than the input."""

import datetime as dt

from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.operators import ingest as I
from hirelens.session import scratch_path
from hirelens.sources import partial as PT

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_shuffled_without_the_postings_texts(spark):
    below = plan_of(X.responses_df.derive(spark, SF)).split("Exchange hashpartitioning(keyword", 1)[1]
    assert "role-" not in below


def test_keywords_join_the_orders_own_columns(spark):
    plan = plan_of(X.jobs_df.derive(spark, SF))
    assert "role-" not in plan[plan.index("Join"):]


def test_a_large_partition_is_written_by_several_tasks(spark):
    path = scratch_path(spark, "one-day")
    rows = spark.range(0, 60_000, numPartitions=4).select(F.lit("d").alias("day"), F.sha2(F.col("id").cast("string"), 512).alias("t"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "200000")
    try:
        PT.write_partitioned(rows, path, "day")
    finally:
        spark.conf.set(size, before)
    back = spark.read.parquet(path)
    assert back.count() == 60_000 and len(back.inputFiles()) > 1


def test_merge_moves_a_posting_once(spark):
    pages = spark.createDataFrame([], I.OPEN_RESPONSE_TYPE)
    plan = plan_of(I.prepare_batch(pages, dt.date(2001, 8, 2)))
    for line in plan.splitlines():
        assert not ("min_by" in line and "jobName" in line), line


def test_pages_of_one_keyword_are_spread(spark):
    pages = spark.createDataFrame([(k, "k", f"https://h/s?q=k&p={k}") for k in range(2000)], "id int, keyword string, url string")
    plan = pages.where("id % 2 = 0").select(F.lit("k").alias("keyword"), F.col("url").alias("crawl_url"))
    found = I.page_keyword_match(pages, plan)
    assert "_salt" in plan_of(found)
    assert sorted(r.id for r in found.collect()) == list(range(2000))


def test_planned_urls_with_many_ends(spark):
    urls = [f"https://h/{k}/" + "x" * (k % 5) + str(k * 7919 % 1000) for k in range(300)]
    plan = spark.createDataFrame([(f"w{k}", u) for k, u in enumerate(urls)] + [("bare", "h/7/"), ("none", None), ("empty", "")],
                                 "keyword string, crawl_url string")
    pages = spark.createDataFrame([(None, "http://r/?to=" + u + "&z") for u in urls] + [("w1", "no mark"), (None, None)], "keyword string, url string")
    got = {(r.url, r.matched_keyword) for r in I.page_keyword_match(pages, plan).collect()}
    want = {(p, f"w{k}") for p in (r.url for r in pages.collect()) if p for k, u in enumerate(urls) if u in p}
    want |= {(p, "bare") for p in (r.url for r in pages.collect()) if p and "h/7/" in p} | {("no mark", "w1")}
    assert got == want


def test_the_index_moves_lists_not_postings(spark):
    from hirelens.sources import gram_index as G
    jobs, base = X.jobs_df(spark, SF), scratch_path(spark, "lists")
    G.write_indexed(jobs, base, parts=2)
    grams = spark.read.parquet(f"{base}/grams")
    assert grams.count() * 4 < grams.agg(F.sum(F.size("rows"))).first()[0]


def test_urls_are_cut_by_compiled_code(spark):
    """a URL's pieces are rows of a generator that is compiled, not arrays that are interpreted."""
    pages = spark.createDataFrame([(1, "k", "https://h/a")], "id int, keyword string, url string")
    plan = plan_of(I.page_keyword_match(pages, pages.select("keyword", F.col("url").alias("crawl_url"))))
    assert "inline(_shapes" in plan
    assert not any("substring" in line and "lambdafunction(CASE" in line for line in plan.splitlines())


def test_pieces_of_any_text(spark):
    """places and lengths are bytes; characters of several bytes and repeated pieces give what containment gives."""
    urls = ["台://北/台://北", "é://b", "x台北x", "aaaa", "a://a://a", "://", "北", "台", None, ""]
    plans = [("one", "台://北"), ("two", "é"), ("two", "台北"), ("aa", "aa"), ("a", "a://a"), ("m", "://"), ("cut", "北"), (None, "x"), ("none", None), ("empty", "")]
    pages = spark.createDataFrame([(k, None, u) for k, u in enumerate(urls)], "id int, keyword string, url string")
    for some in (plans, [p for p in plans if p[1] and "://" in p[1]], plans[-2:]):
        got = sorted((r.id, r.matched_keyword) for r in I.page_keyword_match(pages, spark.createDataFrame(some, "keyword string, crawl_url string")).collect())
        assert got == sorted({(k, w) for k, u in enumerate(urls) if u for w, p in some if w and p and p in u})


def test_matched_pages_are_stored_once(spark, sf):
    """pages and plan are read from stored pages, not derived from the tables for each use."""
    from hirelens.plans import q_ingest
    assert not any("lineitem" in f for f in q_ingest.q_page_keyword_match(spark, sf).inputFiles())
