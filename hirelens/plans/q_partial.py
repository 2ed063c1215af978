"""Registered queries of partial rewrites and upsert publishing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.fixtures import AS_OF, AS_OF_SQL, with_jobs
from hirelens.plans.catalog import register
from hirelens.plans.pipeline import publish_news_jobs
from hirelens.plans.q_io import ROW_SQL, _row
from hirelens.session import scratch_path
from hirelens.sources import partial as PT
from hirelens.sources import snapshots as SN
from hirelens.sources.io import read_parquet

NEXT_DAY = AS_OF + dt.timedelta(days=1)

# The batch: postings of day 0 that change (of those, every fourth moves to the next day), and all of day 9, which
# move to day 8.  Days are counted back from AS_OF.
BATCH_SQL = f""",
bt AS (SELECT * REPLACE (jobName || ' (again)' AS jobName,
                         CASE WHEN k % 10 = 9 THEN {AS_OF_SQL} - 8 WHEN k % 40 = 0 THEN {AS_OF_SQL} + 1 ELSE crawl_date END AS crawl_date)
       FROM (SELECT *, CAST(jobNo AS BIGINT) AS k FROM jobs) WHERE k % 20 = 0 OR k % 10 = 9),
tb AS (SELECT * FROM jobs WHERE jobNo NOT IN (SELECT jobNo FROM bt) UNION ALL BY NAME SELECT * EXCLUDE (k) FROM bt)
"""


def _published(spark, sf, by="crawl_date"):
    path, jobs = scratch_path(spark, "news-jobs"), X.jobs_df(spark, sf)
    PT.write_partitioned(jobs if by in jobs.columns else jobs.withColumn(by, PT.bucket_of("jobNo", 16)), path, by)
    return path, jobs


def _with_bucket(jobs):
    return jobs.withColumn("bucket", PT.bucket_of("jobNo", 16)).schema


def _batch(jobs):
    k = F.col("jobNo").cast("long")
    day = F.when(k % 10 == 9, F.date_sub(F.lit(AS_OF), 8)).when(k % 40 == 0, F.lit(NEXT_DAY)).otherwise(F.col("crawl_date"))
    return jobs.where((k % 20 == 0) | (k % 10 == 9)).withColumns(
        {"jobName": F.concat("jobName", F.lit(" (again)")), "crawl_date": day})


@register("partial_upsert_rows", with_jobs(BATCH_SQL + f"SELECT {ROW_SQL} FROM tb"))
def q_partial_upsert_rows(spark, sf):
    """The table after an upsert that rewrites the touched crawl dates: equal to a full rewrite."""
    path, jobs = _published(spark, sf)
    PT.upsert_partitions(spark, path, _batch(jobs), "crawl_date")
    return _row(spark.read.schema(jobs.schema).parquet(path))


@register("partial_upsert_files", with_jobs(BATCH_SQL + f"""
, days AS (SELECT crawl_date, true AS had, false AS has FROM jobs UNION ALL SELECT crawl_date, false, true FROM tb)
SELECT crawl_date, bool_or(had) AS had_files, bool_or(has) AS has_files,
       bool_or(had) AND crawl_date NOT IN (SELECT crawl_date FROM bt)
       AND crawl_date NOT IN (SELECT crawl_date FROM jobs WHERE jobNo IN (SELECT jobNo FROM bt)) AS untouched
FROM days GROUP BY 1"""))
def q_partial_upsert_files(spark, sf):
    """Which crawl dates keep their very files (name and time) through the upsert."""
    path, jobs = _published(spark, sf)
    if jobs.isEmpty():  # no partition, no files
        return jobs.select("crawl_date", *[F.lit(False).alias(c) for c in ("had_files", "has_files", "untouched")])
    seen = scratch_path(spark, "files")
    PT.table_files(spark, path, "crawl_date").write.parquet(seen)
    PT.upsert_partitions(spark, path, _batch(jobs), "crawl_date")
    before = spark.read.parquet(seen).groupBy("partition").agg(F.sort_array(F.collect_set(F.struct("file_name", "written"))).alias("old"))
    after = PT.table_files(spark, path, "crawl_date").groupBy("partition").agg(
        F.sort_array(F.collect_set(F.struct("file_name", "written"))).alias("new"))
    return before.join(after, "partition", "full_outer").select(
        F.col("partition").alias("crawl_date"), F.col("old").isNotNull().alias("had_files"),
        F.col("new").isNotNull().alias("has_files"), F.coalesce(F.col("old") == F.col("new"), F.lit(False)).alias("untouched"))


@register("partial_upsert_buckets", with_jobs(BATCH_SQL + f"SELECT {ROW_SQL} FROM tb"))
def q_partial_upsert_buckets(spark, sf):
    """The same upsert on a snapshot partitioned by a hash of jobNo: rows never move there."""
    path, jobs = _published(spark, sf, "bucket")
    PT.upsert_partitions(spark, path, _batch(jobs).withColumn("bucket", PT.bucket_of("jobNo", 16)), "bucket")
    return _row(spark.read.schema(_with_bucket(jobs)).parquet(path))


def _changed_snapshot(spark, sf):
    """A published version of all postings, and a later snapshot in which the postings of the last three days changed."""
    first, base, snap = _stored(spark, X.jobs_df(spark, sf)), scratch_path(spark, "published"), scratch_path(spark, "snapshot")
    publish_news_jobs(spark, first, base, as_of=AS_OF, version="1")
    jobs = read_parquet(spark, first, schema=X.jobs_df(spark, sf).schema)  # derived once, like the day's snapshot that it stands for
    k = F.col("jobNo").cast("long")
    SN.write_snapshot(jobs.withColumns({
        "jobName": F.concat("jobName", F.lit(" (new)")),
        "crawl_date": F.when(k % 30 == 9, F.lit(AS_OF)).otherwise(F.col("crawl_date"))}), snap)
    return jobs, base, snap


def _stored(spark, jobs):
    path = scratch_path(spark, "snapshot")
    SN.write_snapshot(jobs, path)
    return path


PUBLISH_SQL = f""",
nw AS (SELECT * REPLACE (jobName || ' (new)' AS jobName,
                         CASE WHEN CAST(jobNo AS BIGINT) % 30 = 9 THEN {AS_OF_SQL} ELSE crawl_date END AS crawl_date) FROM jobs),
sl AS (SELECT * FROM nw WHERE crawl_date >= {AS_OF_SQL} - 3)
"""


@register("publish_upsert_rows", with_jobs(PUBLISH_SQL + f"""
SELECT {ROW_SQL} FROM (SELECT * FROM jobs WHERE jobNo NOT IN (SELECT jobNo FROM sl) UNION ALL SELECT * FROM sl)"""))
def q_publish_upsert_rows(spark, sf):
    """The recent slice upserted into the published table, as a new version."""
    jobs, base, snap = _changed_snapshot(spark, sf)
    publish_news_jobs(spark, snap, base, as_of=AS_OF, days_ago=3, version="2")
    return _row(read_parquet(spark, SN.newest_path(spark, base), schema=jobs.schema))


@register("publish_in_place_rows", with_jobs(PUBLISH_SQL + f"""
SELECT {ROW_SQL} FROM (SELECT * FROM jobs WHERE jobNo NOT IN (SELECT jobNo FROM sl) UNION ALL SELECT * FROM sl)"""))
def q_publish_in_place_rows(spark, sf):
    """The same slice upserted in place: only the crawl dates that it touches are rewritten."""
    jobs, base, snap = _changed_snapshot(spark, sf)
    path, _ = publish_news_jobs(spark, snap, base, as_of=AS_OF, days_ago=3, mode="in_place")
    return _row(read_parquet(spark, path, schema=jobs.schema))


@register("publish_replace_rows", with_jobs(PUBLISH_SQL + f"SELECT {ROW_SQL} FROM sl"))
def q_publish_replace_rows(spark, sf):
    """The slice published alone, as the original's transfer does: the table is what was selected."""
    jobs, base, snap = _changed_snapshot(spark, sf)
    publish_news_jobs(spark, snap, base, as_of=AS_OF, days_ago=3, mode="replace", version="2")
    return _row(read_parquet(spark, SN.newest_path(spark, base), schema=jobs.schema))
