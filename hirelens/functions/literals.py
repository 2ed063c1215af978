"""Small fixed dimensions as JVM-side DataFrames.

``spark.createDataFrame(list)`` ships pickled rows and needs Python workers
at run time; a fixed dimension (a few labelled buckets, city coordinates,
built-in code dictionaries) is instead built as ``inline`` over a one-row
range, which plans as a local, codegen-friendly relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_frame(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """``rows`` of Python values as a DataFrame with ``columns`` = [(name, type), ...]."""
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, columns)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
