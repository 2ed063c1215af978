"""Sources and sinks: S2–S8, S12–S16, publish.

Writers never overwrite the directory a plan is reading: a published
snapshot goes to a new versioned folder and readers resolve the newest
complete one (``hirelens.sources.snapshots``: those with the ``_SUCCESS``
marker of Spark's committer).  Paths
are taken as given (``s3a://``, ``hdfs://`` or local); intermediate data
goes under the session's shared checkpoint folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hirelens import constants as C
from hirelens.operators.documents import find
from hirelens.operators.filters import equality_predicate

DATE_LIKE = ("date", "time", "created", "updated", "timestamp")


def _filtered(df: DataFrame, filters: dict | None, limit: int | None) -> DataFrame:
    pred = equality_predicate(filters)
    out = df.where(pred) if pred is not None else df
    return out.limit(int(limit)) if limit else out


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet read (filters / projections push down into the scan).

    Give ``schema`` when the folder may hold no data file (an empty
    partitioned write) — there is nothing to infer it from.
    """
    r = spark.read
    return (r.schema(schema) if schema is not None else r).parquet(path)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S3: CSV with header; schema inferred unless given (give one in production)."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def _flat_for_csv(df: DataFrame) -> DataFrame:
    """Arrays / structs JSON-encoded so the CSV writer accepts them."""
    cols = []
    for name, dtype in df.dtypes:
        if dtype.startswith(("array", "struct", "map")):
            cols.append(F.to_json(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def export_parquet(df: DataFrame, path: str, filters: dict | None = None, limit: int | None = None,
                   mode: str = "overwrite") -> None:
    """Parquet export with equality filters and optional limit."""
    _filtered(df, filters, limit).write.mode(mode).parquet(path)


def export_csv(df: DataFrame, path: str, filters: dict | None = None, limit: int | None = None,
               mode: str = "overwrite") -> None:
    """CSV export with header."""
    _flat_for_csv(_filtered(df, filters, limit)).write.mode(mode).option("header", True).csv(path)


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (unicode kept as is)."""
    df.write.mode(mode).json(path)


def publish(df: DataFrame, base_path: str, version: str | None = None,
            partition_by: list[str] | None = None) -> tuple[str, int]:
    """Write a new snapshot version and return (path, row count).

    The count comes from an ``Observation`` collected during the write — no
    second pass over the data.
    """
    version = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = f"{base_path.rstrip('/')}/version={version}"
    obs = Observation("publish")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path, int(obs.get["rows"])


def publish_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "jobNo") -> None:
    """Snapshot as a table bucketed (and sorted) by ``key``.

    A later join / merge on ``key`` against an equally bucketed side reads
    the snapshot without shuffling it: the daily lifecycle merge then moves
    only the day's batch, not the whole stored state.
    """
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
       .option("path", path).saveAsTable(table))


def recent_rows(df: DataFrame, n: int = C.RECENT_EXPORT_ROWS, key: str = "jobNo") -> DataFrame:
    """S7 + S16 + O2: newest ``n`` rows by the first date-like column
    (else ``key``), descending, nulls last, ties broken by ``key`` desc.
    """
    col = next((c for c in df.columns if any(t in c.lower() for t in DATE_LIKE)), key)
    order = [F.col(col).desc_nulls_last()]
    if col != key and key in df.columns:
        order.append(F.col(key).desc_nulls_last())
    return df.orderBy(*order).limit(n)


def doc_scan(df: DataFrame, filters: dict | None = None, limit: int = 0) -> DataFrame:
    """Rows that match a filter document (``hirelens.operators.documents``); ``limit=0`` means unlimited."""
    return find(df, filters, limit)


def save_run_files(df: DataFrame, base_path: str, run_stamp: str) -> dict:
    """One CSV and one JSON output per run, under a run-stamped folder."""
    out = {"csv": f"{base_path.rstrip('/')}/jobs_{run_stamp}_csv", "json": f"{base_path.rstrip('/')}/jobs_{run_stamp}_json"}
    export_csv(df, out["csv"], mode="errorifexists")
    export_json(df, out["json"], mode="errorifexists")
    return out


def file_store_get(df: DataFrame, job_no: str | None = None, limit: int = 100) -> DataFrame:
    """Point lookup by jobNo, else the first ``limit`` rows (by jobNo)."""
    if job_no:
        return df.where(F.col("jobNo") == job_no)
    return df.orderBy("jobNo").limit(limit)


def date_like_column(spark: SparkSession, table: str, key: str = "jobNo") -> str:
    """The first column of a catalog table whose name looks like a date, else ``key``; no job runs."""
    names = [c.name for c in spark.catalog.listColumns(table)]
    return next((c for c in names if any(t in c.lower() for t in DATE_LIKE)), key)


def export_recent_table(spark: SparkSession, table: str, path: str, n: int = C.RECENT_EXPORT_ROWS, key: str = "jobNo") -> bool:
    """S7 + S16: the newest ``n`` rows of a catalog table as JSON; False, and nothing written, if there is no such table."""
    if not table_exists(spark, table):
        return False
    by = date_like_column(spark, table, key)
    order = [F.col(by).desc_nulls_last(), *([F.col(key).desc_nulls_last()] if by != key else [])]
    export_json(spark.table(table).orderBy(*order).limit(n), path)
    return True


def table_columns(df: DataFrame) -> list[str]:
    """Column introspection (schema only, no job)."""
    return list(df.columns)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Catalog table existence."""
    return spark.catalog.tableExists(name)
