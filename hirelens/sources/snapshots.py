"""Snapshot versions: folders ``version=<v>`` that Spark's committer has marked with ``_SUCCESS``.

Only a missing base folder counts as "no snapshot yet"; any other failure to
list or read it is raised.

A snapshot may be bucketed by ``jobNo``; an empty file ``_buckets-<n>`` says so,
written after the data.  Without it the same files are read as plain Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def complete_versions(spark: SparkSession, base: str) -> list[str]:
    """Versions whose write was committed, oldest first (numbers by value, others by text)."""
    files, folder = _folder(spark, base)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    found = [n.removeprefix("version=") for n in names
             if n.startswith("version=") and files.exists(_folder(spark, f"{base.rstrip('/')}/{n}/_SUCCESS")[1])]
    return sorted(found, key=lambda v: (int(v), "") if v.isdigit() else (-1, v))


def version_path(base: str, version: str | int) -> str:
    return f"{base.rstrip('/')}/version={version}"


def newest_path(spark: SparkSession, base: str) -> str | None:
    found = complete_versions(spark, base)
    return version_path(base, found[-1]) if found else None


def latest_snapshot(spark: SparkSession, base: str) -> DataFrame | None:
    """Newest complete snapshot, or None if there is none; no older version is scanned."""
    path = newest_path(spark, base)
    return None if path is None else read_snapshot(spark, path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot, with its bucketing if it has one (a join on ``jobNo`` then doesn't shuffle it)."""
    files, folder = _folder(spark, path)
    marks = [s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().startswith("_buckets-")]
    df = spark.read.parquet(path)
    if not marks:
        return df
    name = f"snapshot_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    buckets = int(marks[0].removeprefix("_buckets-"))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (jobNo) SORTED BY (jobNo) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return _unnamed(spark, name)


def _unnamed(spark: SparkSession, name: str) -> DataFrame:
    """The table's frame; its entry in the catalog goes, its files stay."""
    df = spark.table(name)
    df.schema  # resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return df


def write_snapshot(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write ``df`` as the snapshot ``path``, bucketed and sorted by ``jobNo`` if ``buckets`` is given."""
    if buckets is None:
        df.write.mode("overwrite").parquet(path)  # at most an uncommitted try is there
        return
    spark, name = df.sparkSession, f"snapshot_{uuid.uuid4().hex}"
    df.repartition(buckets, "jobNo").write.mode("overwrite").bucketBy(buckets, "jobNo").sortBy("jobNo") \
        .option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    files, mark = _folder(spark, f"{path}/_buckets-{buckets}")
    files.create(mark).close()


def next_path(spark: SparkSession, base: str) -> str:
    """Folder after the newest complete version, whatever a stream's checkpoint counts."""
    found = [int(v) for v in complete_versions(spark, base) if v.isdigit()]
    return version_path(base, found[-1] + 1 if found else 0)


def replace_table(spark: SparkSession, base: str, df: DataFrame) -> str:
    """``df`` replaces the table under ``base`` as its next version; returns that version's folder.

    Older versions stay, so a reader of the old table, or ``df`` itself, can go on reading it.
    """
    path = next_path(spark, base)
    write_snapshot(df, path)
    return path
