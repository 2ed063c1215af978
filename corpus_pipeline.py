"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's result as Parquet in the shared folder and reads it
back as the next one's docs.  SQL can't express the stages (ORACLE_SQL is None);
tests compare them with brute-force versions.

Nulls, empty texts, repeated rows and empty tables: as the operators say.  The
near-duplicate stage keeps one row of a doc_id, and one of the rows without a
doc_id that have equal sets; near copies among the latter pass.  Mixing may take
a document in several epochs, as rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import jaccard_join, mixing, packing, quality_rules, suffix_index
from hirelens.llm.common import cut, table

ORACLE_SQL = None
#: Texts are long: batches of fewer rows than Spark's defaults, (default, here), for what tasks hold of them at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, 1000), "spark.sql.parquet.columnarReaderBatchSize": (4096, 512)}
#: Bytes of a repeated passage, and of the places its anchor may have: 99 % of the runs of 51 words in sf0.01 have 254 bytes
#: or more, so the operator's own 400 would leave passages of 50 words and more in place.
PASSAGE, PLACES = 250, 170
ROW_GROUP = {"parquet.block.size": str(16 << 20)}  # what a task's writer holds of a stage's texts


def _small_batches(spark: SparkSession) -> None:
    """Set BATCHES on the session where it has Spark's defaults."""
    for name, (default, rows) in BATCHES.items():
        if int(spark.conf.get(name, str(default))) == default:
            spark.conf.set(name, str(rows))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return quality_rules.filter_documents(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return jaccard_join.drop_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    left = suffix_index.remove_repeats(docs, PASSAGE, PLACES)
    return left.withColumn("n_chars", F.char_length("text").cast(left.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return mixing.mix(docs, mixing.production_plan(budget_share=1000)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.op8_query(docs)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("suffix_dedup", repeated_passages),
          ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", **ROW_GROUP)
    return STAGES[-1][1](spark, docs, sf_dir)
