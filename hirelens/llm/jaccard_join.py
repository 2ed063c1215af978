"""N-gram Jaccard join: prefix filtering with rare shingles first, then links and their components.

A text's set holds its distinct shingles of ``words`` words (A-Z lower-cased,
as 64-bit hashes); with fewer words the whole sequence is one shingle; without
words the set is empty.  Two texts link when 100 * |intersection| >= percent *
|union|.

1. Shingles are ordered rare first: by how many shingle occurrences share their
   hash slot in a table of 2**SLOT_BITS counts over all documents (a fixed size,
   sent to all tasks), then by hash.  Any fixed order gives the same links.
2. Equal sets form a class by their digest; its least doc_id stands for it.
3. Each document posts its prefix: the first |x| - ceil(t|x|) + 1 shingles.
   Linked texts share one.  Postings of shingles that only one document posts go.
4. Leader round: in each shingle's list, the document with fewest rarer shingles
   leads; every other one is paired with it alone, so a list of any length gives
   as many pairs.  Pairs that pass the length and positional filters are
   verified once, and links are joined to components.
5. Rest round: where a list still holds several components, each document
   outside its leader's component is paired with the list's documents of other
   components, under the length, positional and index-prefix filters; new pairs
   are verified once.  Links inside a component need no check.  So every link
   between different components is found and the components are exact.

Before verification, a suffix filter: each document has a sketch, the numbers of
its shingles in equal parts of the hash range (about four in a part); the sum of
the parts' smaller numbers bounds the overlap from above.  Only pairs that may
still link have their sets made from the texts and compared.

Nulls: a null text is empty; rows with a null doc_id get component null and
link with nothing.  Repeated rows with one doc_id count as one document, with
the text whose hash is least.  Empty tables give no rows.  Extra columns are
ignored, or kept by ``drop_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from hirelens.llm.common import cut, slices, to_batch
from hirelens.llm.components import components

SLOT_BITS = 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


def _hashed(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    out = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ ids[k:len(ids) - n + 1 + k]) * _BASE
        out ^= out >> np.uint64(29)
    return out


def occurrences(texts: list[str | None], words: int, known: _WordHashes) -> list[np.ndarray]:
    """The hashes (uint64) of each text's shingles, as they come."""
    tokens = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.uint64, int(sizes.sum()))
    flat = _hashed(ids, words) if len(ids) >= words else np.empty(0, np.uint64)
    starts = (np.cumsum(sizes) - sizes).tolist()
    return [flat[a:a + n - words + 1] if n >= words else _hashed(ids[a:a + n], n) if n else flat[:0]
            for a, n in zip(starts, sizes.tolist(), strict=True)]


def shingles(texts: list[str | None], words: int, known: _WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    return [np.unique(h) for h in occurrences(texts, words, known)]


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _own(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def slot_counts(docs: DataFrame, words: int) -> np.ndarray:
    """Shingle occurrences per slot over all documents; 2**SLOT_BITS numbers."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _WordHashes(), np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                held = occurrences(part["text"].to_pylist(), words, known)
                counts += np.bincount(slots(np.concatenate(held)), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield to_batch(schema, [pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())])

    found = _own(docs).select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    got = found.toArrow()
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return counts


def _ceil(n: int, a: int, b: int) -> int:
    return -(-n * a // b)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def postings(docs: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Two kinds of rows: a document's (digest not null) and its prefix shingles' (shingle, pos)."""
    rank = docs.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("sketch", pa.binary()),
                        ("th", pa.int64()), ("shingle", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = _WordHashes(), rank.value
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                sizes, digests, sketches, out_ids, out_n, out_s, out_p = [], [], [], [], [], [], []
                ids = part["doc_id"].to_pylist()
                for doc, own in zip(ids, shingles(part["text"].to_pylist(), words, known), strict=True):
                    n = len(own)
                    sizes.append(n)
                    sketches.append(sketch(own))
                    digests.append(_digest(own))
                    if n and doc is not None:
                        own = own[np.argsort(table[slots(own)], kind="stable")]
                        length = n - _ceil(n, percent, 100) + 1
                        out_s.append(own[:length].view(np.int64))
                        out_p.append(np.arange(length, dtype=np.int32))
                        out_ids.append(np.full(length, doc, np.int64))
                        out_n.append(np.full(length, n, np.int32))
                k = len(ids)
                yield to_batch(schema, [ids, sizes, digests, sketches, part["th"], pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())])
                if out_s:
                    s = np.concatenate(out_s)
                    yield to_batch(schema, [pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_n)),
                                            pa.nulls(len(s), pa.binary()), pa.nulls(len(s), pa.binary()),
                                            pa.nulls(len(s), pa.int64()), pa.array(s),
                                            pa.array(np.concatenate(out_p))])

    return _own(docs).mapInArrow(run, "doc_id long, n int, digest binary, sketch binary, th long, shingle long, pos int")


def overlap_needed(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of n and m that link."""
    return _ceil(n + m, percent, 100 + percent)


def sketch(own: np.ndarray) -> bytes:
    """Shingles in each of 2**k equal parts of the hash range, a byte each; empty if a byte can't hold one."""
    bits = min(16, max(4, (len(own) // 4).bit_length()))
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def overlap_bound(a: bytes, b: bytes, n: int, m: int) -> int:
    """Upper bound of the intersection of sets of n and m, from their sketches."""
    if not a or not b:
        return min(n, m)
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)).sum())


def screened(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their sketches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch[c].to_pylist() for c in ("ka", "kb", "na", "nb")), strict=True)
            keep = [overlap_bound(x, y, n, m) >= overlap_needed(n, m, percent) for x, y, n, m in sides]
            part = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield to_batch(schema, [part["a"], part["b"]])

    sides = [heads.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"k{c}"), F.col("n").alias(f"n{c}"))
             for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)") \
        .select("a", "b", "ka", "kb", "na", "nb").mapInArrow(run, "a long, b long")


def _needed(n: str, m: str, percent: int) -> str:
    return f"(({n} + {m}) * {percent} + {99 + percent}) div {100 + percent}"


def _possible(a: str, b: str, percent: int) -> str:
    """Length filter, and the positional filter at a shared shingle."""
    return (f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and "
            f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {_needed(f'{a}.n', f'{b}.n', percent)}")


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose sets link.  Each set is made from its text once."""
    wanted = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "jaccard-wanted")
    sets = cut(_sets(docs, wanted, words), "jaccard-sets")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "sa", 16_000_000):
                keep = []
                for sa, sb in zip(part["sa"].to_pylist(), part["sb"].to_pylist(), strict=True):
                    x, y = np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8")
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    keep.append(int((both[1:] == both[:-1]).sum()) >= overlap_needed(len(x), len(y), percent))
                part = part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                yield to_batch(schema, [part["a"], part["b"]])

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles of the wanted documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                own = shingles(part["text"].to_pylist(), words, known)
                yield to_batch(schema, [part["doc_id"], [x.astype("<u8").tobytes() for x in own]])

    own = _own(docs).join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("th", "text")).alias("m"))
    return own.select("doc_id", "m.text").mapInArrow(run, "doc_id long, shingles binary")


def stored_postings(docs: DataFrame, words: int, percent: int) -> DataFrame:
    return cut(postings(docs, words, percent, slot_counts(docs, words)), "jaccard-postings")


def link_components(docs: DataFrame, words: int = 5, percent: int = 80, found: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text); ``found``: its stored postings."""
    found = stored_postings(docs, words, percent) if found is None else found
    heads = found.where("digest is not null").select("doc_id", "n", "digest", "sketch", "th")
    heads = heads.where("doc_id is null").drop("th").unionByName(
        heads.where("doc_id is not null").groupBy("doc_id").agg(
            F.min(F.struct("th", "digest", "n", "sketch")).alias("h")).select("doc_id", "h.n", "h.digest", "h.sketch"))
    classes = heads.where("doc_id is not null and n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    heads = cut(heads.join(classes, "digest", "left").select("doc_id", "n", "rep", "sketch"), "jaccard-classes")
    members = heads.select("doc_id", "n", "rep")

    per_shingle = Window.partitionBy("shingle")
    lists = found.where("shingle is not null").select("shingle", "doc_id", "n", "pos").withColumn(
        "lead", F.min(F.struct("pos", "doc_id", "n")).over(per_shingle)) \
        .withColumn("listed", F.count(F.lit(1)).over(per_shingle)).where("listed > 1").drop("listed")
    reps = members.where("rep = doc_id").select(F.col("doc_id").alias("rep_id"))
    lists = cut(lists.join(reps, F.col("doc_id") == F.col("rep_id"), "left_semi"), "jaccard-lists")

    to_rep = members.where("rep is not null").select(F.col("doc_id").alias("lead_id"), F.col("rep").alias("lead_rep"))
    # the positional filter would wrongly drop a pair that meets again under another leader
    led = lists.where(f"100 * least(n, lead.n) >= {percent} * greatest(n, lead.n) and lead.doc_id <> doc_id") \
        .select("doc_id", F.col("lead.doc_id").alias("lead_id")).distinct().join(to_rep, "lead_id") \
        .select(F.greatest("doc_id", "lead_rep").alias("a"), F.least("doc_id", "lead_rep").alias("b")) \
        .where("a > b").distinct()
    led = cut(led, "jaccard-led")
    links = cut(verified(cut(screened(led, heads, percent), "jaccard-likely"), docs, words, percent), "jaccard-links")
    roots = components(links)

    placed = lists.select("shingle", "doc_id", "n", "pos").join(
        roots, F.col("doc_id") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "doc_id"))
    main = F.min(F.struct("pos", "doc_id", "comp")).over(per_shingle)["comp"]
    mixed = placed.select("shingle", "doc_id", "n", "pos", "comp") \
        .withColumn("main", main).withColumn("outside", F.col("comp") != F.col("main")) \
        .withColumn("any_outside", F.max("outside").over(per_shingle)).where("any_outside").drop("any_outside")
    mixed = cut(mixed, "jaccard-mixed")
    index = f"n - {_needed('n', 'n', percent)} + 1"
    x = mixed.where("outside").withColumn("i", F.expr(index)).alias("x")
    y = mixed.withColumn("i", F.expr(index)).alias("y")
    short = "if(y.n < x.n or (y.n = x.n and y.doc_id < x.doc_id), y.pos < y.i, x.pos < x.i)"
    rest = x.join(y, F.expr(f"x.shingle = y.shingle and x.comp <> y.comp and {short} and "
                            f"{_possible('x', 'y', percent)}")) \
        .select(F.expr("greatest(x.doc_id, y.doc_id)").alias("a"), F.expr("least(x.doc_id, y.doc_id)").alias("b")) \
        .distinct().join(led, ["a", "b"], "left_anti")
    rest = cut(screened(rest, heads, percent), "jaccard-rest")
    more = cut(verified(rest, docs, words, percent), "jaccard-links")
    final = components(links.unionByName(more)).select(F.col("node").alias("rep"), "root")
    return members.join(final, "rep", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("root", "rep", "doc_id").alias("component_id"))


def _with_digest(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (text, row) with the ``digest`` of the text's set; null if the set is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                own = [_digest(x) if len(x) else None for x in shingles(part["text"].to_pylist(), words, known)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.binary())],
                                                 names=[*part.schema.names, "digest"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("digest", BinaryType())]))


def drop_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each doc_id that is the least of its component; without doc_id, one of those with equal sets.

    Of repeated rows the one with the least text hash stays, whose text the links
    are of.  A row without doc_id goes if a document with one has an equal set;
    rows without doc_id and words all stay.
    """
    found = stored_postings(docs, words, percent)
    gone = link_components(docs, words, percent, found).where("component_id <> doc_id").select(
        F.col("doc_id").alias("gone"))
    gone = cut(gone, "jaccard-gone")
    repeated = cut(docs.groupBy(F.col("doc_id").cast("long").alias("gone")).count()
                   .where("gone is not null and count > 1").select("gone"), "jaccard-repeated")
    number = docs["doc_id"].cast("long")
    single = docs.where(number.isNotNull()).join(gone.union(repeated), number == F.col("gone"), "left_anti")

    text = F.col("text").cast("string")
    rows = docs.select(number.alias("id"), text.alias("text"), F.struct(*docs.columns).alias("row"))
    least = F.min_by("row", F.struct(F.xxhash64("text"), F.to_json("row"))).alias("row")
    out = single
    if not repeated.isEmpty():
        again = rows.join(repeated.join(gone, "gone", "left_anti"), F.col("id") == F.col("gone"), "left_semi")
        out = out.unionByName(again.groupBy("id").agg(least).select("row.*"))
    if not docs.where(number.isNull()).isEmpty():
        bare = _with_digest(rows.where("id is null").drop("id"), words)
        held = found.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(
            F.min(F.struct("th", "digest")).alias("h")).select("h.digest")
        copies = bare.where("digest is not null").join(held, "digest", "left_anti").groupBy("digest").agg(least)
        out = out.unionByName(copies.select("row.*")).unionByName(bare.where("digest is null").select("row.*"))
    return out


def op3_query(docs: DataFrame) -> DataFrame:
    return link_components(docs, words=4, percent=85)
