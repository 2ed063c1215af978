"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() without arguments cuts at the same six characters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later jobs start from files."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``text`` column holds about ``limit`` bytes (one row at least)."""
    n, at = batch.num_rows, 0
    size = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    while at < n:
        end, held = at, 0
        while end < n and (end == at or held + size[end] <= limit):
            held += size[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t)
                                       for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key`` as batches that never cut a key's rows apart, each of ``least`` rows or more but the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key].to_numpy()
        end = int(np.searchsorted(keys, keys[-1]))
        if end:
            yield table.slice(0, end).combine_chunks().to_batches()[0]
            held = table.slice(end).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bounds(keys: np.ndarray) -> np.ndarray:
    """Places where a sorted key changes, with both ends."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
