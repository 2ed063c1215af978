"""The crawl log as a stream (S10, J11): fetched pages arrive as JSON files, in any order and more than once.

Event time is when a page was fetched.  Repeated deliveries are dropped within
the watermark; what is left is merged into the log, a table partitioned by crawl
day, of which a micro-batch rewrites only its own days.  Per (today, keyword,
first_url, crawl_url) the fetch that is last in event time stays (of equal times
one that succeeded, then the larger count), so the log doesn't depend on the
order of arrival, and a retried micro-batch changes nothing.

Late pages: a page fetched more than ``delay`` before the newest one seen by an
earlier micro-batch is not logged.  Its URL then stays pending in the frontier
(``hirelens.operators.ingest.frontier_pending`` on the log) and is fetched again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.operators.ingest import OPEN_RESPONSE_TYPE, crawl_log_from_responses
from hirelens.session import settings, shuffles_released
from hirelens.sources.partial import merge_partitions
from hirelens.sources.snapshots import _folder

KEY = ("today", "keyword", "first_url", "crawl_url")
LOG = "keyword string, first_url string, crawl_url string, status string, total_count int, fetched_at timestamp, today string"
PAGE_TYPE = T.StructType([*OPEN_RESPONSE_TYPE.fields, T.StructField("fetched_at", T.TimestampType())])

STORE = "spark.sql.streaming.stateStore.providerClass"
IN_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
#: The keys seen within the watermark are kept on disk: in memory (Spark's default) they take all of the executors' heap.
ON_DISK = {STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
           "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def _state_store(spark: SparkSession) -> dict[str, str]:
    """Settings of a stream's state: on disk, unless the session names another store than Spark's default."""
    return ON_DISK if spark.conf.get(STORE, IN_MEMORY).rsplit(".", 1)[1] == IN_MEMORY.rsplit(".", 1)[1] else {}


def log_rows(pages: DataFrame) -> DataFrame:
    """Log rows of fetched pages; a page without a time counts as fetched when its day began, one without a day is dropped."""
    rows = crawl_log_from_responses(pages.withColumn("today", F.struct("today", "fetched_at")))
    return rows.select("keyword", "first_url", "crawl_url", "status", "total_count",
                       F.coalesce("today.fetched_at", F.try_to_timestamp("today.today")).alias("fetched_at"),
                       F.col("today.today").alias("today")).where("today IS NOT NULL AND fetched_at IS NOT NULL")


def last_fetches(rows: DataFrame) -> DataFrame:
    """One row per key: the last fetch, whatever the order of the rows and however often they come."""
    last = F.max(F.struct("fetched_at", (F.col("status") == "ok").alias("good"), "total_count", "status"))
    return rows.groupBy(*KEY).agg(last.alias("r")).select(*KEY, "r.status", "r.total_count", "r.fetched_at")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log so far; empty before the first page."""
    files, folder = _folder(spark, path)
    return spark.read.schema(LOG).parquet(path) if files.exists(folder) else spark.createDataFrame([], LOG)


def start_crawl_log_stream(spark: SparkSession, landing_dir: str, log_path: str, checkpoint_location: str,
                           delay: str = "1 day", available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(PAGE_TYPE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = log_rows(reader.json(landing_dir)).withWatermark("fetched_at", delay)
    fresh = rows.dropDuplicatesWithinWatermark([*KEY, "fetched_at", "status", "total_count"])

    def each(batch: DataFrame, batch_id: int) -> None:
        merge_partitions(batch.sparkSession, log_path, batch, "today", last_fetches)

    w = fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    with settings(spark, _state_store(spark)), shuffles_released(spark):  # the stream keeps the settings of its start
        return w.start()
