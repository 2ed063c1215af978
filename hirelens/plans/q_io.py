"""Registered source / sink queries (S2–S8, S12–S16): write, read back, compare."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.fixtures import with_jobs
from hirelens.operators import filters as FL
from hirelens.operators import trends as T
from hirelens.plans.catalog import register
from hirelens.plans.q_trends import DELISTED
from hirelens.session import scratch_path
from hirelens.sources import io as IO
from hirelens.sources import snapshots as SN

ROW = ["jobNo", "jobName", "custName", "coIndustryDesc", "jobDetail", "jobAddrNo", "jobAddrNoDesc", "area_code",
       "area_name", "appearDate", "salaryDesc", "applyDesc", "periodDesc", "optionEdu", "applyAnalyze", "job", "cust",
       "status", "delisted_date", "city", "district", "crawl_date", "last_update_date", "discovery_date",
       "search_keyword"]
ROW_SQL = ", ".join(c if c != "search_keyword" else "array_to_string(search_keyword, '|') AS search_keyword"
                    for c in ROW)
# CSV cannot tell NULL from '': both come back as NULL (as with the original's CSV files).
CSV_ROW_SQL = ", ".join(f"NULLIF({c}, '') AS {c}" if c not in ("crawl_date", "last_update_date", "discovery_date",
                                                               "search_keyword") else c
                        for c in ROW).replace("search_keyword", "array_to_string(search_keyword, '|') AS search_keyword")


def _row(df):
    """All posting columns, the keywords as text."""
    return df.select(*ROW).withColumn("search_keyword", F.array_join("search_keyword", "|"))


def _csv_back(spark, path, like):
    """A CSV export read with the schema of ``like``; lists are JSON text in it."""
    plain = ", ".join(f"`{n}` {'string' if t.startswith('array') else t}" for n, t in like.dtypes)
    back = IO.read_csv(spark, path, plain)
    return back.select(*[F.from_json(n, t).alias(n) if t.startswith("array") else F.col(n) for n, t in like.dtypes])


@register("parquet_roundtrip", with_jobs("""
SELECT jobNo, status, coIndustryDesc, array_to_string(search_keyword, '|') AS search_keyword, crawl_date
FROM jobs WHERE status = 'active'"""))
def q_parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "news-jobs")
    jobs = X.jobs_df(spark, sf)
    IO.export_parquet(jobs, path, filters={"status": "active"})
    back = IO.read_parquet(spark, path)
    return back.select("jobNo", "status", "coIndustryDesc",
                       F.array_join("search_keyword", "|").alias("search_keyword"), "crawl_date")


@register("publish_snapshot", with_jobs(f"""
SELECT {ROW_SQL}, (SELECT count(*) FROM jobs) AS published_rows FROM jobs"""))
def q_publish_snapshot(spark, sf):
    base = scratch_path(spark, "snapshots")
    _, rows = IO.publish(X.jobs_df(spark, sf), base, version="1")
    return _row(SN.latest_snapshot(spark, base)).withColumn("published_rows", F.lit(rows).cast("long"))


@register("table_replace_parquet", with_jobs(f"SELECT {ROW_SQL} FROM jobs"))
def q_table_replace_parquet(spark, sf):
    """A table of the active postings is replaced by a Parquet file of all."""
    base, path, jobs = scratch_path(spark, "table"), scratch_path(spark, "all-jobs"), X.jobs_df(spark, sf)
    SN.replace_table(spark, base, FL.scan_jobs(jobs))
    IO.export_parquet(jobs, path)
    SN.replace_table(spark, base, IO.read_parquet(spark, path))
    return _row(SN.latest_snapshot(spark, base))


@register("table_replace_csv", with_jobs(f"SELECT {CSV_ROW_SQL} FROM jobs"))
def q_table_replace_csv(spark, sf):
    """S3: the same with a CSV file, read with the table's schema."""
    base, path, jobs = scratch_path(spark, "table"), scratch_path(spark, "all-jobs"), X.jobs_df(spark, sf)
    SN.replace_table(spark, base, FL.scan_jobs(jobs))
    IO.export_csv(jobs, path)
    SN.replace_table(spark, base, _csv_back(spark, path, jobs))
    return _row(SN.latest_snapshot(spark, base))


@register("csv_roundtrip", with_jobs("""
SELECT jobNo, NULLIF(jobName, '') AS jobName, NULLIF(city, '') AS city, NULLIF(salaryDesc, '') AS salaryDesc
FROM jobs WHERE coIndustryDesc = 'MACHINERY'"""))
def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "jobs-csv")
    jobs = X.jobs_df(spark, sf).select("jobNo", "jobName", "city", "salaryDesc", "coIndustryDesc", "search_keyword")
    IO.export_csv(jobs, path, filters={"coIndustryDesc": "MACHINERY"})
    return _csv_back(spark, path, jobs).select("jobNo", "jobName", "city", "salaryDesc")


@register("selected_day_export", with_jobs("""
SELECT jobNo AS job_no, jobName AS job_name, custName AS company_name, NULLIF(city, '') AS city,
       NULLIF(district, '') AS district, appearDate AS appear_date FROM jobs WHERE appearDate = '20010731'"""))
def q_selected_day_export(spark, sf):
    """A selected day's postings as CSV under the dashboard's headers."""
    path = scratch_path(spark, "selected-day")
    day = FL.selected_day_jobs(X.jobs_df(spark, sf), "2001-07-31", X.AS_OF).select(
        "job_no", "job_name", "company_name", "city", "district", F.date_format("appear_date", "yyyyMMdd").alias("appear_date"))
    IO.export_csv(FL.with_display_labels(day), path)
    return IO.read_csv(spark, path, day.schema)


@register("delisted_export", with_jobs(DELISTED + """
SELECT jobNo, jobName, custName, appear_dt, delisted_dt, shelf_days_before_delisting FROM dl"""))
def q_delisted_export(spark, sf):
    """The whole delisted list as CSV, newest first."""
    path = scratch_path(spark, "delisted")
    gone = T.delisted_sorted(X.jobs_df(spark, sf), "latest", None).select(
        "jobNo", "jobName", "custName", "appear_dt", "delisted_dt", "shelf_days_before_delisting")
    IO.export_csv(gone, path)
    return IO.read_csv(spark, path, gone.schema)


def _run_files(spark, sf):
    return IO.save_run_files(X.jobs_df(spark, sf).select("jobNo", "custName", "city", "search_keyword"),
                             scratch_path(spark, "runs"), "r1")


@register("json_roundtrip", with_jobs("""
SELECT jobNo, custName, city, array_to_string(search_keyword, '|') AS search_keyword FROM jobs"""))
def q_json_roundtrip(spark, sf):
    back = spark.read.schema("jobNo string, custName string, city string, search_keyword array<string>") \
        .json(_run_files(spark, sf)["json"])
    return IO.doc_scan(back, limit=0).withColumn("search_keyword", F.array_join("search_keyword", "|"))


@register("run_files_csv", with_jobs("""
SELECT jobNo, custName, city, array_to_string(search_keyword, '|') AS search_keyword FROM jobs WHERE city = '高雄市'"""))
def q_run_files_csv(spark, sf):
    """S12 + S8: the run's CSV read back, then filtered as a document scan."""
    like = X.jobs_df(spark, sf).select("jobNo", "custName", "city", "search_keyword")
    return IO.doc_scan(_csv_back(spark, _run_files(spark, sf)["csv"], like), filters={"city": "高雄市"}) \
        .withColumn("search_keyword", F.array_join("search_keyword", "|"))


@register("recent_50_json", with_jobs(f"""
SELECT {ROW_SQL} FROM jobs ORDER BY appearDate DESC NULLS LAST, jobNo DESC LIMIT 50"""))
def q_recent_50_json(spark, sf):
    """The newest rows exported as JSON, all columns."""
    path, newest = scratch_path(spark, "recent"), IO.recent_rows(X.jobs_df(spark, sf))
    IO.export_json(newest, path)
    return _row(spark.read.schema(newest.schema).json(path))


@register("table_recent_50", with_jobs(f"""
SELECT {ROW_SQL} FROM jobs ORDER BY last_update_date DESC NULLS LAST, jobNo DESC LIMIT 50"""))
def q_table_recent_50(spark, sf):
    """S7 + S16: by table name; the catalog's columns tell what to sort by (here the update date comes first)."""
    jobs, name = X.jobs_df(spark, sf), f"news_jobs_{uuid.uuid4().hex}"
    first = ["jobNo", "last_update_date"]
    jobs.select(*first, *[c for c in jobs.columns if c not in first]).write \
        .option("path", scratch_path(spark, "news-jobs-table")).saveAsTable(name)
    path = scratch_path(spark, "recent")
    try:
        IO.export_recent_table(spark, name, path)
    finally:
        spark.sql(f"DROP TABLE {name}")
    return _row(spark.read.schema(jobs.schema).json(path))


@register("csv_inferred", with_jobs(f"""
SELECT CAST(jobNo AS INTEGER) AS jobNo, NULLIF(jobName, '') AS jobName, NULLIF(city, '') AS city, CAST(appearDate AS INTEGER) AS appearDate,
       crawl_date, TRY_CAST(jobNo AS BIGINT) % 2 = 0 AS even, CAST(jobNo AS DOUBLE) / 4 AS quarter FROM jobs"""))
def q_csv_inferred(spark, sf):
    """S3: a CSV table read with inferred types (integer, text, date, boolean, double)."""
    k, path = F.col("jobNo").cast("long"), scratch_path(spark, "inferred-csv")
    rows = X.jobs_df(spark, sf).select("jobNo", "jobName", "city", "appearDate", "crawl_date", (k % 2 == 0).alias("even"), (k / 4).alias("quarter"))
    IO.export_csv(rows, path)
    return IO.read_csv(spark, path) if not rows.isEmpty() else rows


@register("recent_50", with_jobs("""
SELECT jobNo, appearDate FROM jobs ORDER BY appearDate DESC NULLS LAST, jobNo DESC LIMIT 50"""))
def q_recent_50(spark, sf):
    return IO.recent_rows(X.jobs_df(spark, sf)).select("jobNo", "appearDate")


@register("file_store_lookup", with_jobs("SELECT jobNo, jobName, custName FROM jobs WHERE jobNo = '4242'"))
def q_file_store_lookup(spark, sf):
    return IO.file_store_get(X.jobs_df(spark, sf), job_no="4242").select("jobNo", "jobName", "custName")


@register("incremental_published", with_jobs(f"""
SELECT {ROW_SQL} FROM jobs WHERE crawl_date >= DATE '2001-08-02' - 3"""))
def q_incremental_published(spark, sf):
    """S14 on the published table: partitioned by crawl_date, so the slice prunes partitions."""
    src = X.jobs_df(spark, sf)
    path, _ = IO.publish(src, scratch_path(spark, "news-jobs-by-day"), version="1", partition_by=["crawl_date"])
    return _row(FL.incremental_slice(IO.read_parquet(spark, path, schema=src.schema), as_of=X.AS_OF, days_ago=3))


@register("file_store_first", with_jobs("SELECT jobNo, jobName FROM jobs ORDER BY jobNo LIMIT 100"))
def q_file_store_first(spark, sf):
    return IO.file_store_get(X.jobs_df(spark, sf), limit=100).select("jobNo", "jobName")
