"""Operator semantics on hand-made rows: quirks, invariants, empty inputs."""

import datetime as dt

from pyspark.sql import functions as F

from hirelens.operators import distribution as D
from hirelens.operators import filters as FL
from hirelens.operators import ingest as I
from hirelens.operators import lifecycle as L
from hirelens.operators import trends as T

AS_OF = dt.date(2001, 8, 2)


def _jobs(spark, rows):
    return spark.createDataFrame(rows, "jobNo string, jobName string, custName string, appearDate string, "
                                       "status string, delisted_date string")


def test_duration_buckets_edges(spark):
    appear = dt.date(2001, 1, 1)
    rows = [(str(i), "n", "c", appear.strftime("%Y%m%d"), "inactive",
             (appear + dt.timedelta(days=d)).isoformat()) for i, d in enumerate([-1, 0, 6, 7, 29, 30, 89, 90])]
    got = {r["bucket"]: r["job_count"] for r in T.delisted_duration_buckets(_jobs(spark, rows)).collect()}
    assert got == {"少於7天": 2, "7-30天": 2, "30-90天": 2, "超過90天": 1}


def test_shelf_flags_boundaries(spark):
    rows = [(str(d), "n", "c", (AS_OF - dt.timedelta(days=d)).strftime("%Y%m%d"), "active", None) for d in (29, 30, 31)]
    got = {r["shelf_days"]: (r["recent"], r["long_unfilled"])
           for r in FL.analysis_projection(_jobs(spark, rows), AS_OF).collect()}
    assert got == {29: (True, False), 30: (False, False), 31: (False, True)}


def test_moving_average_last_value(spark):
    base = dt.date(2001, 1, 1)
    rows = []
    for i in range(9):  # day i has i delisted postings -> counts 1..8 (day 0 has none)
        for j in range(i):
            rows.append((f"{i}-{j}", "n", "c", "20000101", "inactive", (base + dt.timedelta(days=i)).isoformat()))
    out = T.delisted_daily_ma7(_jobs(spark, rows)).orderBy("date").collect()
    assert out[-1]["ma7"] == sum(range(2, 9)) / 7


def test_daily_changes_running_total_invariant(spark):
    rows = [("1", "a", "c", "20010101", "inactive", "2001-01-03"), ("2", "b", "c", "20010102", "active", None),
            ("3", "c", "c", "20010102", "inactive", "n/a")]
    out = T.daily_job_changes(_jobs(spark, rows)).orderBy("date").collect()
    assert [r["date"] for r in out] == [dt.date(2001, 1, 1), dt.date(2001, 1, 2), dt.date(2001, 1, 3)]
    assert out[-1]["total_jobs"] == sum(r["new_jobs"] for r in out) - sum(r["removed_jobs"] for r in out)
    assert out[0]["new_delta"] is None


def test_day_over_day_keeps_duplicates(spark):
    rows = [("1", "a", "c", "20010101", "active", None), ("2", "b", "c", "20010102", "active", None),
            ("3", "b", "c", "20010102", "active", None), ("4", "a", "c", "20010102", "active", None)]
    out = T.day_over_day_diff(_jobs(spark, rows)).collect()
    assert sorted((r["change"], r["jobNo"]) for r in out) == [("only_curr", "2"), ("only_curr", "3")]


def test_merge_postings_first_seen(spark):
    hits = spark.createDataFrame(
        [("1", "x", "python", 3), ("1", "y", "django", 1), ("1", "z", "python", 2), ("1", "w", None, 0),
         (None, "q", "java", 0), ("2", "v", None, 5)], "jobNo string, jobName string, search_keyword string, ord int")
    got = {r["jobNo"]: (r["jobName"], r["search_keyword"]) for r in I.merge_postings(hits).collect()}
    assert got == {"1": ("w", ["django", "python"]), "2": ("v", [])}


def _state(spark):
    return spark.createDataFrame(
        [("1", "active", None, dt.date(2001, 1, 1), dt.date(2001, 1, 1)),
         ("2", "inactive", "2001-05-01", dt.date(2001, 1, 1), dt.date(2001, 5, 1)),
         ("3", "active", None, dt.date(2001, 1, 1), dt.date(2001, 1, 1)),
         ("4", "inactive", "2001-04-01", dt.date(2001, 1, 1), dt.date(2001, 4, 1))],
        "jobNo string, status string, delisted_date string, discovery_date date, last_update_date date")


def test_lifecycle_classes_and_idempotence(spark):
    state = _state(spark)
    batch = spark.createDataFrame([("1",), ("2",), ("5",)], "jobNo string")
    nxt = L.sync_snapshot(state, batch, AS_OF)
    got = {r["jobNo"]: (r["change"], r["status"], r["delisted_date"]) for r in nxt.collect()}
    assert got == {"1": ("kept", "active", None), "2": ("reactivated", "active", None),
                   "3": ("delisted", "inactive", "2001-08-02"), "4": ("untouched", "inactive", "2001-04-01"),
                   "5": ("new", "active", None)}
    again = L.sync_snapshot(nxt.drop("change"), batch, AS_OF)
    cols = ["jobNo", "status", "delisted_date", "discovery_date", "last_update_date"]
    assert sorted(again.select(cols).collect()) == sorted(nxt.select(cols).collect())


def test_lifecycle_empty_crawl_is_noop(spark):
    state = _state(spark)
    empty = spark.createDataFrame([], "jobNo string")
    out = L.sync_snapshot(state, empty, AS_OF)
    assert {r["change"] for r in out.collect()} == {"untouched"}
    assert sorted(out.drop("change").select(state.columns).collect()) == sorted(state.collect())


def test_growth_and_empty_inputs(spark):
    empty = spark.createDataFrame([], "jobNo string, coIndustryDesc string, appearDate string, custName string, "
                                      "jobName string, city string, district string, salaryDesc string")
    assert D.industry_share(empty).count() == 0
    assert D.city_salary_top(empty).count() == 0
    assert D.industry_growth(empty).count() == 0


def test_keyword_filter_is_literal_and_all_must_match(spark):
    df = spark.createDataFrame([("1", ["C++", "Go"]), ("2", ["c", "go"]), ("3", None)], "jobNo string, search_keyword array<string>")
    assert [r["jobNo"] for r in FL.keyword_filter(df, ["c++", "GO"]).collect()] == ["1"]
    assert FL.keyword_filter(df, ["on"]).count() == 0  # null keywords never match


def test_limit_before_filter_parity(spark):
    rows = [(str(i), "n", "c", "20010101", "active", None, "台北市" if i % 2 else "新北市") for i in range(10)]
    df = spark.createDataFrame(rows, "jobNo string, jobName string, custName string, appearDate string, "
                                     "status string, delisted_date string, city string").orderBy("jobNo")
    assert FL.load_jobs(df, as_of=AS_OF, city="台北市", limit=4).count() == 4
    assert FL.load_jobs(df, as_of=AS_OF, city="台北市", limit=4, limit_before_filter=True).count() == 2


def test_merge_postings_hot_key(spark):
    """One posting holds a third of all hits: still one row with its distinct keywords, nothing dropped."""
    n = 30000
    rows = [("hot" if i % 3 == 0 else f"j{i}", f"name{i}", ["python", "go", "sre", None][i % 4], i) for i in range(n)]
    hits = spark.createDataFrame(rows, "jobNo string, jobName string, search_keyword string, ord int")
    out = I.merge_postings(hits)
    assert out.count() == 1 + (n - n // 3)
    hot = out.where(F.col("jobNo") == "hot").first()
    assert hot["jobName"] == "name0"
    assert hot["search_keyword"] == ["python", "sre", "go"]  # first-seen order: i=0 python, 3 None, 6 sre, 9 go


def test_day_counts_hot_day(spark):
    rows = [(str(i), "n", "c", "20010101" if i % 3 == 0 else f"200102{(i % 28) + 1:02d}", "active", None)
            for i in range(9000)]
    out = {r["date"]: r["new_jobs"] for r in T.day_counts(_jobs(spark, rows)).collect()}
    assert sum(out.values()) == 9000 and out[dt.date(2001, 1, 1)] == 3000


def test_prepare_batch_metrics(spark, sf):
    from hirelens import fixtures as X
    metrics = {}
    batch = I.prepare_batch(X.responses_df(spark, sf), AS_OF, metrics)
    n = batch.count()
    assert metrics["postings"].get["rows"] == n
    assert metrics["hits"].get["rows"] >= n


def test_keyword_filter_regex_option(spark):
    df = spark.createDataFrame([("1", ["python3"]), ("2", ["pypy"]), ("3", ["java"])],
                               "jobNo string, search_keyword array<string>")
    assert sorted(r["jobNo"] for r in FL.keyword_filter(df, ["^py"], regex=True).collect()) == ["1", "2"]
    assert FL.keyword_filter(df, ["^py"]).count() == 0  # literal by default


def test_keyword_suggest_edges(spark):
    from hirelens.operators import dimensions as DM
    choices = spark.createDataFrame([("Python",), ("pandas",), ("PyTorch",), ("Go",)], "keyword string")
    assert [r["keyword"] for r in DM.keyword_suggest(choices, "go, py").collect()] == ["PyTorch", "Python"]
    assert DM.keyword_suggest(choices, "python,").count() == 0  # nothing typed after the comma
    assert DM.keyword_suggest(choices, "").count() == 0
    assert DM.keyword_suggest(choices, "p", n=2).count() == 2


def test_required_columns_check(spark):
    df = spark.createDataFrame([("1", "a")], "jobNo string, city string")
    assert FL.missing_columns(df, ["jobNo", "salaryDesc", "city", "applyDesc"]) == ["salaryDesc", "applyDesc"]


def test_string_keyword_column_coerced(spark):
    from hirelens.functions import parsing as P
    df = spark.createDataFrame([("1", "Python"), ("2", None), ("3", "")], "jobNo string, search_keyword string")
    got = {r["jobNo"]: r["k"] for r in df.select("jobNo", P.as_keyword_array("search_keyword", "string").alias("k")).collect()}
    assert got == {"1": ["Python"], "2": [], "3": []}
    assert [r["jobNo"] for r in FL.keyword_filter(df, ["python"]).collect()] == ["1"]


def test_table_exists_and_columns(spark):
    from hirelens.sources import io as IO
    df = spark.range(1).withColumnRenamed("id", "jobNo")
    df.createOrReplaceTempView("postings_view")
    assert IO.table_exists(spark, "postings_view") and not IO.table_exists(spark, "no_such_view")
    assert IO.table_columns(df) == ["jobNo"]
    spark.catalog.dropTempView("postings_view")


def test_replaced_table_keeps_older_versions(spark):
    from hirelens.session import scratch_path
    from hirelens.sources import snapshots as SN
    base = scratch_path(spark, "replaced")
    first = SN.replace_table(spark, base, spark.range(3))
    second = SN.replace_table(spark, base, SN.latest_snapshot(spark, base).where("id > 0"))
    assert first != second and spark.read.parquet(first).count() == 3
    assert SN.latest_snapshot(spark, base).count() == 2
