"""Exact duplicates through a minimal perfect hash over the digests seen before.

The index is a table of shards.  A shard (by a hash of the digest) holds about
SHARD_KEYS distinct digests, and one segment for each batch that brought it new
ones.  A segment is a minimal perfect hash (levels of bit arrays: a key that is
alone at its place in a level ends there, the others go on to the next level; a
key's slot is the number of bits set before its own) and its slots: the full
SHA-256, the locator of the text that stays (doc_id, row) and the group's size.

``absorb`` looks a batch's distinct digests up: the hash sends any key to some
slot, and only equality of all 32 bytes makes it a member.  Members update their
slot's locator and size; nonmembers are grouped apart as a segment of their own.
``lookup`` gives each row its group from the slots.  Texts never leave the first
scan; digests are aggregated before they are shuffled, so a text that makes up a
third of all rows is one row per task there, and shards with many rows are
looked up by several tasks, each with a copy of the shard.

Texts are equal when identical after lower-casing A-Z.  Of equal texts the row
with the largest doc_id stays; rows without doc_id count as smaller than all
others, and of rows that share it too the one read last stays (``row`` numbers
rows in the written digest table).  A null text is empty.  An empty table gives
no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import cut, lower_ascii

SHARD_KEYS = 4096
TASK_ROWS = 8192
HEAVY_SHARDS = 10_000  # at most so many shards are split, so their table may be broadcast
SEGMENTS = 4
LEVELS = 256
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

INDEX = "shard int, segment int, sizes binary, bits binary, digests binary, ids binary, known binary, rows binary, counts binary"
GROUP = "digest binary, doc_id long, row long, n long"
SINGLE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}  # a row may be a whole shard


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.array([level], np.uint64) * GOLDEN
    return (_mix(words[:, 0] ^ _mix(words[:, 1] + salt)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct digests, given as rows of four 64-bit words."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        seen = 0
        for bits in levels:
            self.ranks.append(seen + np.cumsum(bits) - bits)
            seen += int(bits.sum())
        self.n = seen

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        levels, left = [], words
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("digests are not distinct")
            size = 2 * len(left)
            at = _place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key; a key outside the set gets -1 or some member's slot."""
        slot = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _place(words[left], level, len(bits))
            here = bits[at]
            slot[left[here]] = rank[at[here]]
            left = left[~here]
            if not len(left):
                break
        return slot


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    joined = b"".join(digests.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(-1, 4)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(0).to_numpy().astype(np.int64, copy=False)


class Segment:
    """A perfect hash with its slots."""

    def __init__(self, hashed: PerfectHash, words, ids, known, rows, counts):
        self.hashed, self.words, self.ids, self.known, self.rows, self.counts = hashed, words, ids, known, rows, counts

    @classmethod
    def of(cls, words, ids, known, rows, counts) -> Segment:
        hashed = PerfectHash.of(words)
        order = np.argsort(hashed.slots(words))
        return cls(hashed, words[order], ids[order], known[order], rows[order], counts[order])

    @classmethod
    def read(cls, r: dict) -> Segment:
        levels, at = [], 0
        for size in np.frombuffer(r["sizes"], "<i8").tolist():
            held = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(r["bits"], np.uint8, held, at), count=size).astype(bool))
            at += held
        return cls(PerfectHash(levels), np.frombuffer(r["digests"], "<u8").reshape(-1, 4),
                   np.frombuffer(r["ids"], "<i8").copy(), np.frombuffer(r["known"], bool).copy(),
                   np.frombuffer(r["rows"], "<i8").copy(), np.frombuffer(r["counts"], "<i8").copy())

    def row(self, shard: int, segment: int) -> dict:
        levels = self.hashed.levels
        return {"shard": shard, "segment": segment, "sizes": np.array([len(b) for b in levels], "<i8").tobytes(),
                "bits": b"".join(np.packbits(b).tobytes() for b in levels),
                "digests": self.words.astype("<u8").tobytes(), "ids": self.ids.astype("<i8").tobytes(),
                "known": self.known.astype(bool).tobytes(), "rows": self.rows.astype("<i8").tobytes(),
                "counts": self.counts.astype("<i8").tobytes()}

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys found, their slots): a key is found where all 32 bytes of its slot's digest agree."""
        slot = self.hashed.slots(words)
        tried = np.flatnonzero(slot >= 0)
        same = (self.words[slot[tried]] == words[tried]).all(axis=1)
        return tried[same], slot[tried[same]]

    def update(self, slot, ids, known, rows, counts) -> None:
        """Groups of known digests: sizes add up, the larger (doc_id, row) stays; a slot comes once."""
        self.counts[slot] += counts
        newer = (known & ~self.known[slot]) | ((known == self.known[slot]) & (
            (ids > self.ids[slot]) | ((ids == self.ids[slot]) & (rows > self.rows[slot]))))
        at = slot[newer]
        self.ids[at], self.known[at], self.rows[at] = ids[newer], known[newer], rows[newer]


def _segments(table: pa.Table) -> list[Segment]:
    return [Segment.read(r) for r in sorted(table.to_pylist(), key=lambda r: r["segment"])]


def _merged(parts: list[Segment]) -> Segment:
    return Segment.of(*(np.concatenate([getattr(p, name) for p in parts])
                        for name in ("words", "ids", "known", "rows", "counts")))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest of every row, written: ``row`` numbers the rows for good."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    return cut(docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                           F.unhex(F.sha2(text, 256)).alias("digest")), "digests")


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: its locator (largest doc_id, then row) and size; aggregated before the shuffle."""
    last = F.max(F.struct("doc_id", "row"))
    return rows.groupBy("digest").agg(last.alias("last"), F.count(F.lit(1)).alias("n")).select(
        "digest", "last.doc_id", "last.row", "n")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


class Index:
    """The shards' table; ``shards`` is fixed when the index is begun."""

    def __init__(self, table: DataFrame, shards: int):
        self.table, self.shards = table, shards


def begin(spark, keys: int) -> Index:
    """An empty index for about ``keys`` distinct digests."""
    return Index(spark.createDataFrame([], INDEX), max(1, -(-keys // SHARD_KEYS)))


def absorb(index: Index, found: DataFrame) -> Index:
    """Look the distinct digests of a batch up, update their slots, add a segment of those that are new."""
    schema = T.StructType.fromDDL(INDEX)

    def one(old: pa.Table, new: pa.Table) -> pa.Table:
        shard = (old if old.num_rows else new)["shard"][0].as_py()
        parts = _segments(old)
        words = _words(new["digest"])
        known = new["doc_id"].is_valid().to_numpy()
        fields = (_numbers(new["doc_id"]), known, _numbers(new["row"]), _numbers(new["n"]))
        left = np.ones(len(words), bool)
        for part in parts:
            at, slot = part.find(words)
            part.update(slot, *(f[at] for f in fields))
            left[at] = False
        if left.any():
            parts.append(Segment.of(words[left], *(f[left] for f in fields)))
        if len(parts) > SEGMENTS:
            parts = [_merged(parts)]
        return pa.Table.from_pylist([p.row(shard, k) for k, p in enumerate(parts)], schema=_arrow(schema))

    batch = found.select(_shard(index.shards), "digest", "doc_id", "row", "n")
    table = index.table.groupBy("shard").cogroup(batch.groupBy("shard")).applyInArrow(one, schema)
    return Index(cut(table, "digest-index", **SINGLE_ROWS), index.shards)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def lookup(index: Index, rows: DataFrame) -> DataFrame:
    """doc_id, row, digest of each row with its group's keep_id, keep_row and group_size (nulls for nonmembers).

    Shards with more rows than a task should read are looked up in parts.
    """
    rows = rows.select(_shard(index.shards), "doc_id", "row", "digest")
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(TASK_ROWS, total // HEAVY_SHARDS)
    heavy = F.broadcast(sizes.where(F.col("n") > limit)
                        .select("shard", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    asked = rows.join(heavy, "shard", "left").select(
        "shard", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), "doc_id", "row", "digest")
    held = index.table.join(heavy, "shard", "left").select(
        *index.table.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    schema = T.StructType.fromDDL("doc_id long, row long, digest binary, keep_id long, keep_row long, group_size long")

    def one(old: pa.Table, new: pa.Table) -> pa.Table:
        n = new.num_rows
        ids, keep, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        no_id, missing = np.ones(n, bool), np.ones(n, bool)
        words = _words(new["digest"])
        for part in _segments(old.drop_columns(["part"])):
            at, slot = part.find(words)
            ids[at], keep[at], size[at] = part.ids[slot], part.rows[slot], part.counts[slot]
            no_id[at], missing[at] = ~part.known[slot], False
        return pa.Table.from_arrays([new["doc_id"], new["row"], new["digest"], pa.array(ids, mask=no_id | missing),
                                     pa.array(keep, mask=missing), pa.array(size, mask=missing)], schema=_arrow(schema))

    return held.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(one, schema)


def index_of(history: DataFrame, batch: DataFrame) -> Index:
    """Index of the digests of ``history``, then ``batch`` absorbed into it."""
    old, new = cut(groups(history), "history-groups"), cut(groups(batch), "batch-groups")
    index = begin(history.sparkSession, max(old.count(), new.count()))
    return absorb(absorb(index, old), new)


def judge(rows: DataFrame, upto: int | None) -> DataFrame:
    """Every row of the digest table with its group; rows up to ``upto`` are history, the others a new batch."""
    old = F.coalesce(F.col("doc_id") <= F.lit(upto).cast("long"), F.lit(False))
    return lookup(index_of(rows.where(old), rows.where(~old)), rows)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole; the older half of the ids is history."""
    name = "_row" + "_" * max(len(c) for c in docs.columns)
    held = cut(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    rows = cut(held.select("doc_id", F.col(name).alias("row"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    stay = judge(rows, middle(rows)).where(F.col("row") == F.col("keep_row")).select(F.col("row").alias(name))
    return held.join(stay, name, "left_semi").select(*docs.columns)


def middle(rows: DataFrame) -> int | None:
    """The middle of the range of doc_ids: up to it documents count as history."""
    least, most = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return None if least is None else least + (most - least) // 2


def op13_query(docs: DataFrame) -> DataFrame:
    """Each document's group.  The older half of the id range is the history, the rest the batch looked up in it."""
    rows = digests(docs)
    return judge(rows, middle(rows)).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
