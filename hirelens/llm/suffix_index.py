"""Suffix-array dedup: a logarithmic family of sparse suffix indexes.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts
anywhere else, in the same or another text.

Anchors.  Of the first WINDOW positions of a LENGTH-byte window, the one whose
8-byte gram has the least hash (the leftmost of equals) is its anchor.  It
depends on the window's bytes alone, so equal windows have their anchors at the
same place, and from there on at least LENGTH - WINDOW + 1 equal bytes.  About
two in WINDOW positions are anchors; the suffixes that start there are indexed.

Index family.  A batch's suffix array holds its anchors in the order of their
suffixes by the hash of their first LENGTH - WINDOW + 1 bytes (the order of
suffixes that differ there doesn't matter for matches, and a hash deals them
evenly).  A new batch is merge-scanned against the existing levels: what shares
a key with another suffix and has a new one among them is a match, on both
sides.  Then levels of equal size merge, so that n batches leave about log2(n)
levels.  Texts are dealt to batches by their hash, so copies meet in one.

Exact check.  Each matched anchor gives the bytes of all windows it anchors.
Contexts with the same bytes are repeated as a whole; one of each and all single
ones are compared window by window within their key, by hashes of all LENGTH
bytes.  Keys with very many different contexts go another exact way: a row per
window, counted by a grouping.

Texts are told apart by a 64-bit hash; a text that occurs twice is removed as a
whole (if it has LENGTH bytes), and its windows still count for others.

Nulls: a null text is empty, and kept with nothing removed; so is a text of
fewer than LENGTH bytes.  A null doc_id stays null.  Repeated rows are repeated
texts.  Empty tables give no rows.  Extra columns are ignored by the query and
kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import cut, slices, to_batch

LENGTH = 400
WINDOW = 200
BATCHES = 4
HOT = 4000
_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**k and r**-k modulo 2**64 for k < n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, r in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            p = np.full(size, np.uint64(r))
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the sum of (byte + 1) * r**k over i <= k < j."""
    up, _ = _powers(len(b) + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=out[1:])
    return out


def hash_at(prefix: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each place, wherever they stand."""
    _, down = _powers(len(prefix))
    return (prefix[at + length] - prefix[at]) * down[at]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def anchors(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, window: int):
    """For texts joined in ``b``: text, anchor, first and last window start of each anchor, and its suffix's hash."""
    windows = sizes - length + 1
    prefix = prefix_hashes(b)
    n = len(b) - 8 + 1
    if n <= 0 or not (windows > 0).any():
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)]
    grams = _mixed(hash_at(prefix, np.arange(n), 8))
    order = grams >> np.uint64(31) << np.uint64(31) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= window:  # least of the next ``span`` positions
        order = np.minimum(order[:-span], order[span:])
        span *= 2
    if window > span:
        order = np.minimum(order[:len(order) - (window - span)], order[window - span:])
    text = np.repeat(np.arange(len(starts)), np.maximum(windows, 0))
    first = np.cumsum(np.maximum(windows, 0)) - np.maximum(windows, 0)
    at = np.arange(len(text)) - first[text] + starts[text]
    anchor = (order[at] & np.uint64((1 << 31) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    own = anchor[new]
    base = starts[text[new]]
    return text[new], own - base, at[new] - base, at[last] - base, hash_at(prefix, own, length - window + 1)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def _bytes(part: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t or b"" for t in part[name].cast(pa.binary()).to_pylist()]


def suffix_array(texts: DataFrame, length: int, window: int) -> DataFrame:
    """fp, key, pos, lo, hi of each anchor of (key, text), in the order of fp within each file."""
    schema = pa.schema([("fp", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()),
                        ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                of, pos, lo, hi, fp = anchors(*_joined(_bytes(part)), length, window)
                keys = part["key"].to_numpy(zero_copy_only=False)
                yield to_batch(schema, [pa.array(fp.view(np.int64)), pa.array(keys[of], pa.int64()),
                                        pa.array(pos.astype(np.int32)), pa.array((pos - hi).astype(np.int32)),
                                        pa.array((pos - lo).astype(np.int32))])

    return texts.mapInArrow(run, "fp long, key long, pos int, lo int, hi int") \
        .dropDuplicates(["fp", "key", "pos"]).sortWithinPartitions("fp")


class IndexFamily:
    """Levels of suffix arrays; a level holds 1, 2, 4, ... batches."""

    def __init__(self, length: int = LENGTH, window: int = WINDOW):
        self.length, self.window = length, window
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, texts: DataFrame) -> DataFrame:
        """Index a batch (key, text); returns the matches that have one of its suffixes among them."""
        new = cut(suffix_array(texts, self.length, self.window), "suffix-batch")
        scanned = new.select("*", F.lit(True).alias("new"))
        for _, level in self.levels:
            scanned = scanned.unionByName(level.select("*", F.lit(False).alias("new")))
        shared = scanned.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("any_new")) \
            .where("n > 1 and any_new").select("fp")
        found = cut(scanned.drop("new").join(shared, "fp", "left_semi"), "suffix-matches")
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, last = self.levels.pop()
            new = last.unionByName(new)
            size *= 2
        if size > 1:
            new = cut(new.repartition("fp", "key").sortWithinPartitions("fp"), "suffix-level")
        self.levels.append((size, new))
        return found


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text.alias("text")).withColumn("key", F.xxhash64("text", F.octet_length("text"))) \
        .select("key", "text")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """(key, text, anchors) -> fp, key, pos, lo, hi, same (hash of the context), bytes."""
    schema = pa.schema([("fp", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()),
                        ("hi", pa.int32()), ("same", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                rows = []
                for key, text, own in zip(part["key"].to_pylist(), _bytes(part), part["anchors"].to_pylist(),
                                          strict=True):
                    for a in own:
                        seen = text[a["pos"] - a["hi"]:a["pos"] - a["lo"] + length]
                        same = hashlib.blake2b(seen + bytes([a["lo"] & 255, a["hi"] & 255]), digest_size=8).digest()
                        rows.append((a["fp"], key, a["pos"], a["lo"], a["hi"],
                                     int.from_bytes(same, "little", signed=True), seen))
                for at in range(0, len(rows), 10_000):
                    yield to_batch(schema, list(zip(*rows[at:at + 10_000], strict=True)))

    return texts.mapInArrow(run, "fp long, key long, pos int, lo int, hi int, same long, bytes binary")


def _window_hashes(part: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context's windows: context, window start in the text, hash of (fp, place of the anchor, bytes)."""
    b, starts, sizes = _joined(_bytes(part, "bytes"))
    lo, hi = (part[c].to_numpy().astype(np.int64) for c in ("lo", "hi"))
    count = sizes - length + 1
    of = np.repeat(np.arange(len(starts)), count)
    k = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    h = _mixed(hash_at(prefix_hashes(b), starts[of] + k, length))
    h = _mixed(h ^ part["fp"].to_numpy().view(np.uint64)[of]) + (hi[of] - k).astype(np.uint64)
    return of, part["pos"].to_numpy()[of] - hi[of] + k, h


def _marks(part: pa.RecordBatch, of: np.ndarray, start: np.ndarray, hit: np.ndarray, schema: pa.Schema):
    """Runs of repeated window starts as (key, first, last)."""
    of, start = of[hit], start[hit]
    if not len(of):
        return to_batch(schema, [[], [], []])
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(of)]]) - 1
    return to_batch(schema, [pa.array(part["key"].to_numpy()[of[at]]), pa.array(start[at]), pa.array(start[last])])


_MARK = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Marks among the contexts of each fp; a task sees whole groups, in slices of a few thousand contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(held: pa.Table):
            part = held.combine_chunks().to_batches()[0]
            of, start, h = _window_hashes(part, length)
            _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            return _marks(part, of, start, count[inverse] > 1, _MARK)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                held.append(batch.slice(at, 1000))
                rows = pa.Table.from_batches(held)
                fp = rows["fp"].to_numpy()
                cut_at = int(np.searchsorted(fp, fp[-1]))  # the last group may go on
                if cut_at >= 1000:
                    yield judged(rows.slice(0, cut_at))
                    held = rows.slice(cut_at).combine_chunks().to_batches()
        if held and sum(x.num_rows for x in held):
            yield judged(pa.Table.from_batches(held))

    return contexts.repartition("fp").sortWithinPartitions("fp").mapInArrow(run, "key long, first long, last long")


def _compared_by_rows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many contexts: a row per window, grouped by its hash."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                of, start, h = _window_hashes(part, length)
                yield to_batch(schema, [pa.array(part["key"].to_numpy()[of]), pa.array(start),
                                        pa.array(h.view(np.int64))])

    rows = contexts.mapInArrow(run, "key long, start long, h long")
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return rows.join(shared, "h", "left_semi").select("key", F.col("start").alias("first"), F.col("start").alias("last"))


def marks_of(contexts: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(key, first, last): runs of repeated window starts, from stored contexts."""
    narrow = contexts.select("fp", "key", "pos", "lo", "hi", "same")
    classes = cut(narrow.groupBy("fp", "same").agg(F.count(F.lit(1)).alias("n"),
                                                   F.min(F.struct("key", "pos")).alias("rep")), "suffix-classes")
    alike = narrow.join(classes.where("n > 1").select("fp", "same"), ["fp", "same"]).select(
        "key", (F.col("pos") - F.col("hi")).cast("long").alias("first"),
        (F.col("pos") - F.col("lo")).cast("long").alias("last"))
    groups = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    reps = classes.join(groups, "fp").select("fp", "rep.key", "rep.pos", "m")
    chosen = contexts.join(reps, ["fp", "key", "pos"])
    few = _compared(chosen.where(F.col("m") <= hot).drop("m", "same"), length)
    many = _compared_by_rows(chosen.where(F.col("m") > hot).drop("m", "same"), length)
    return alike.unionByName(few).unionByName(many)


def _placed(docs: DataFrame, length: int, window: int, batches: int, slim: bool) -> tuple[DataFrame, DataFrame]:
    """Stored rows and stored repeated window starts by key.

    Rows: ``row`` (struct of the other columns), key, size, whole (removed as a whole), open (marks decide), text.
    ``slim``: the text only where it is still needed, and the digest of those kept unchanged.
    """
    texts = _keyed(docs)
    family, found = IndexFamily(length, window), None
    for k in range(batches):
        more = family.add(texts.where(F.pmod(F.col("key"), F.lit(batches)) == k))
        found = more if found is None else found.unionByName(more)
    own = found.groupBy("key").agg(F.collect_set(F.struct("pos", "lo", "hi", "fp")).alias("found"))
    others = [c for c in docs.columns if c.lower() != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").alias("was"),
                       text.alias("text")).withColumn("size", F.octet_length("text")) \
        .withColumn("key", F.xxhash64("text", "size"))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("row.doc_id").alias("first_id"))
    heads = cut(copies.join(own, "key", "left").where("copies > 1 or found is not null")
                .select(F.col("key").alias("k"), "copies", "first_id", "found"), "suffix-heads")
    rows = rows.join(heads, F.col("key") == F.col("k"), "left").withColumn(
        "whole", (F.coalesce("copies", F.lit(1)) > 1) & (F.col("size") >= length)).withColumn(
        "open", ~F.col("whole") & F.col("found").isNotNull()).withColumn(
        "anchors", F.when(F.col("row.doc_id").eqNullSafe(F.col("first_id")), F.col("found")))
    shown = F.when(F.col("open") | F.col("anchors").isNotNull(), F.col("text")) if slim else F.col("was")
    digest = F.when(F.col("whole"), F.lit(EMPTY_SHA)).when(~F.col("open"), F.sha2(F.col("text").cast("binary"), 256)) \
        if slim else F.lit(None).cast("string")
    rows = cut(rows.select("row", "key", "size", "whole", "open", "anchors", shown.alias("text"),
                           digest.alias("digest")), "suffix-rows")
    contexts = cut(_contexts(rows.where("anchors is not null").select("key", "text", "anchors"), length),
                   "suffix-contexts")  # a repeated row's come twice, which marks its own text alone
    marks = marks_of(contexts, length).groupBy("key").agg(
        F.collect_list(F.struct("first", "last")).alias("runs")).withColumnRenamed("key", "k")
    return rows, cut(marks, "suffix-marks")


def kept(raw: bytes, runs: list[dict] | None, length: int) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs) of a text."""
    out, spans, removed, at, end = [], 0, 0, 0, -1
    for first, last in sorted((r["first"], r["last"] + length) for r in runs or []):
        if first > end:
            out.append(raw[at:first])
            spans += 1
            removed += last - first
        else:
            removed += max(0, last - end)
        end = max(end, last)
        at = end
    out.append(raw[at:])
    return b"".join(out), removed, spans


def _cut_open(rows: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """row, text, removed, spans, digest of the open rows; a cut character at an edge goes from the text."""
    own = rows.where("open").join(marks, F.col("key") == F.col("k"), "left").select("row", "text", "runs")
    kind = own.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                done = [kept(raw, runs, length) for raw, runs in zip(_bytes(part), part["runs"].to_pylist(),
                                                                     strict=True)]
                yield pa.record_batch({
                    "row": part["row"], "text": pa.array([x[0].decode(errors="ignore") for x in done], pa.string()),
                    "removed": pa.array([x[1] for x in done], pa.int64()),
                    "spans": pa.array([x[2] for x in done], pa.int64()),
                    "digest": pa.array([hashlib.sha256(x[0]).hexdigest() for x in done], pa.string())})

    return own.mapInArrow(run, f"row {kind}, text string, removed long, spans long, digest string")


def removed_spans(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of (doc_id, text)."""
    rows, marks = _placed(docs.select("doc_id", "text").withColumn("n_bytes", F.octet_length(
        F.coalesce(F.col("text").cast("string"), F.lit("")))), length, window, batches, slim=True)
    size, whole = F.col("size").cast("long"), F.col("whole")
    done = rows.where("not open").select(
        "row.doc_id", size.alias("n_bytes"), F.when(whole, size).otherwise(0).alias("n_removed"),
        whole.cast("long").alias("n_spans"), F.col("digest").alias("kept_sha256"))
    return done.unionByName(_cut_open(rows, marks, length).select(
        "row.doc_id", F.col("row.n_bytes").cast("long").alias("n_bytes"), F.col("removed").alias("n_removed"),
        F.col("spans").alias("n_spans"), F.col("digest").alias("kept_sha256")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` without repeated bytes; rows of which only blanks are left go."""
    rows, marks = _placed(docs, length, window, batches, slim=False)
    same = rows.where("not whole and not open").select("row", "text")
    both = same.unionByName(_cut_open(rows, marks, length).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
                            .select("row", "text"))
    return both.select(*[F.col("text") if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op10_query(docs: DataFrame) -> DataFrame:
    return removed_spans(docs)
