"""P4 / P5 on an index: postings whose text contains every keyword, found through three-character grams.

``write_indexed`` numbers the postings and stores them, as they come, in ``parts``
partitions by a hash of their block (2**15 numbers in a row), and beside them
posting lists: one row per (field, gram, batch of postings) with the places in the
block of the batch's postings that have the gram.  Each task sorts the lists of the
postings it read by gram and writes them as a file of its own, so that a lookup reads
the row groups of its grams only, and neither postings nor lists are shuffled.  A
text gives a gram for each of its characters (two pad characters follow its end),
so a keyword of one or two characters is the beginning of some gram.  Lists are
made per Arrow batch, so they are bounded.

``find_containing`` reads the postings of a keyword's grams and keeps those that
have all of them; these are candidates, whose partitions alone are then read and
whose texts are verified.  It gives the same rows as the scan for any keyword.
Sets of postings are masks of 64 numbers each: lists are joined to masks with
partial aggregation, and a posting is looked up in its mask.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions import parsing as P
from hirelens.operators.filters import keyword_text_fallback
from hirelens.session import scratch_path

GRAM = 3
BLOCK_BITS = 15  # a place in a block is a smallint
WORD_BITS = 6  # a mask is a bigint
CHARACTERS = 1 << 22  # that are sorted at once
PAD = "\u0000"
FIELDS = ("keywords", "text")


def field_texts(jobs: DataFrame) -> dict[str, Column]:
    """The texts that keywords are looked for in: the keyword list (P4), and name, detail and company (P5)."""
    return {"keywords": P.keywords_text("search_keyword"), "text": keyword_text_fallback(jobs)}


def _gram_lists(texts: list[str | None], places: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """The grams of some postings' texts, where each one's list ends, and the lists' places, joined.

    (gram, posting) pairs are sorted as one number each, with the texts' characters numbered by those that occur;
    where that takes more than 64 bits, or the texts are long, the postings are halved.
    """
    held = [k for k, t in enumerate(texts) if t]
    if not held:
        return
    halves = held[:len(held) // 2], held[len(held) // 2:]
    if len(held) > 1 and sum(len(texts[k]) for k in held) > CHARACTERS:
        for half in halves:
            yield from _gram_lists([texts[k] for k in half], places[half])
        return
    codes = np.frombuffer("".join(texts[k] + PAD * (GRAM - 1) for k in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.flatnonzero(np.bincount(codes)).astype(np.uint32)
    bits, low = int(len(known) - 1).bit_length(), int(len(held) - 1).bit_length()
    if GRAM * bits + low > 64:
        for half in halves:
            yield from _gram_lists([texts[k] for k in half], places[half])
        return
    number = np.zeros(int(known[-1]) + 1, np.uint64)
    number[known] = np.arange(len(known), dtype=np.uint64)
    codes = number[codes]
    sizes = np.array([len(texts[k]) + GRAM - 1 for k in held])
    owner = np.repeat(np.arange(len(held), dtype=np.uint64), sizes)
    key = np.zeros(len(codes) - (GRAM - 1), np.uint64)
    for k in range(GRAM):
        key = key << np.uint64(bits) | codes[k:k + len(key)]
    pairs = key << np.uint64(low) | owner[:len(key)]
    own = np.ones(len(pairs) + GRAM - 1, bool)  # a gram for each own character
    for k in range(1, GRAM):
        own[np.cumsum(sizes) - k] = False
    pairs = np.sort(pairs[own[:len(pairs)]])
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    gram = pairs >> np.uint64(low)
    ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
    found, mask = gram[ends - 1], np.uint64((1 << bits) - 1)
    letters = np.stack([known[(found >> np.uint64(bits * k) & mask).astype(np.int64)] for k in reversed(range(GRAM))], axis=1)
    joined = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    at = (pairs & np.uint64((1 << low) - 1)).astype(np.int64)
    yield [joined[k:k + GRAM] for k in range(0, len(joined), GRAM)], ends, places[held][at]


def _lists(rows: DataFrame) -> DataFrame:
    """field, gram, part, block, rows: the posting lists of each batch of stored rows, as places in their block."""
    schema = pa.schema([("field", pa.string()), ("gram", pa.string()), ("part", pa.int32()), ("block", pa.int64()),
                        ("rows", pa.list_(pa.int16()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, parts = batch["_row"].to_numpy(), batch["_part"].to_numpy()
            blocks, places = numbers >> BLOCK_BITS, (numbers & (1 << BLOCK_BITS) - 1).astype(np.int16)
            for name in FIELDS:
                texts = [None if t is None else t.decode("utf-8", "replace") for t in batch[name].cast(pa.binary()).to_pylist()]
                for block in np.unique(blocks):
                    own = np.flatnonzero(blocks == block)
                    for names, ends, lists in _gram_lists([texts[k] for k in own], places[own]):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([name] * len(names), pa.string()), pa.array(names, pa.string()),
                            pa.array(np.full(len(names), parts[own[0]], np.int32)), pa.array(np.full(len(names), block, np.int64)),
                            pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(lists))], schema=schema)

    texts = field_texts(rows)
    return rows.select("_row", "_part", *[texts[name].alias(name) for name in FIELDS]).mapInArrow(
        run, "field string, gram string, part int, block bigint, rows array<smallint>")


def write_indexed(jobs: DataFrame, base: str, parts: int = 64, index_tasks: int | None = None) -> None:
    """Store ``jobs`` and the gram index of their texts under ``base``; extra columns go along.

    A task indexes the postings it reads.  ``index_tasks`` deals the lists to as many files by their grams instead.
    """
    spark = jobs.sparkSession
    numbered = jobs.withColumn("_row", F.monotonically_increasing_id()) \
        .withColumn("_part", F.pmod(F.xxhash64(F.shiftright("_row", BLOCK_BITS)), F.lit(parts)).cast("int"))
    numbered.write.partitionBy("_part").parquet(f"{base}/rows")
    found, by = _lists(_rows(spark, base, jobs)), ["field", "gram", "block"]
    spread = found.repartitionByRange(index_tasks, *by) if index_tasks else found
    spread.sortWithinPartitions(*by).write.option("parquet.block.size", 4 << 20).parquet(f"{base}/grams")


def _rows(spark: SparkSession, base: str, like: DataFrame) -> DataFrame:
    columns = ", ".join(f"`{n}` {t}" for n, t in like.dtypes)
    return spark.read.schema(f"{columns}, _row bigint, _part int").parquet(f"{base}/rows")


def gram_conditions(keyword: str) -> list[Column]:
    """One condition on ``gram`` for each of the keyword's grams; a shorter keyword has one, on a gram's beginning."""
    if len(keyword) < GRAM:
        return [F.col("gram").startswith(keyword)]
    return [F.col("gram") == g for g in sorted({keyword[k:k + GRAM] for k in range(len(keyword) - GRAM + 1)})]


def candidates(grams: DataFrame, field: str, keywords: list[str]) -> DataFrame:
    """part, word, mask: the postings that have a gram for every condition of every keyword, a bit each.

    Bit k of a mask is posting number 64 * word + k.
    """
    conditions = [c for k in keywords for c in gram_conditions(k)]
    hits = grams.where((F.col("field") == field) & functools.reduce(operator.or_, conditions))
    rows = hits.select("gram", "part", "block", F.explode("rows").alias("at"))
    bit = F.expr(f"shiftleft(1L, at % {1 << WORD_BITS})")
    word = (F.shiftleft("block", BLOCK_BITS - WORD_BITS) + F.shiftright("at", WORD_BITS)).alias("word")
    met = [F.bit_or(F.when(c, bit)).alias(f"c{k}") for k, c in enumerate(conditions)]
    every = functools.reduce(lambda a, b: a.bitwiseAND(b), [F.col(f"c{k}") for k in range(len(conditions))])
    return rows.groupBy("part", word).agg(*met).select("part", "word", every.alias("mask")).where("mask <> 0")


def find_containing(spark: SparkSession, base: str, like: DataFrame, keywords: list[str], field: str = "keywords") -> DataFrame:
    """The stored postings whose ``field`` contains every keyword (literal, any case); ``like`` has their columns.

    Without keywords all postings are returned.
    """
    kws = [k.lower() for k in keywords or [] if k]
    rows = _rows(spark, base, like)
    if not kws:
        return rows.select(*like.columns)
    grams = spark.read.schema("field string, gram string, part int, block bigint, rows array<smallint>").parquet(f"{base}/grams")
    path = scratch_path(spark, "candidates")
    candidates(grams, field, kws).write.parquet(path)  # read twice
    found = spark.read.schema("part int, word bigint, mask bigint").parquet(path)
    parts = [r.part for r in found.select("part").distinct().collect()]  # as many as there are partitions at most
    rows = rows.where(F.col("_part").isin(parts) if parts else F.lit(False)).join(
        found, F.expr(f"shiftright(_row, {WORD_BITS}) = word and getbit(mask, cast(_row % {1 << WORD_BITS} as int)) = 1"), "left_semi")
    text = field_texts(rows)[field]
    return rows.where(functools.reduce(operator.and_, [text.contains(k) for k in kws])).select(*like.columns)
