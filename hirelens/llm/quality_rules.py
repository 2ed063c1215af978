"""Quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

The features of a text are its byte ``n``-grams (words joined by single blanks, a
blank before and after), hashed to 2**BITS buckets.  Two multinomials are
counted: ``raw`` over all documents, ``target`` over all trusted ones, which a
join of documents and labels finds.  A
bucket's weight is log((target + a) / (target total + a * buckets)) minus the
same for raw, kept as a whole number of 2**-20, so a document's sum is exact
and does not depend on the order of summation.  A document's score is the sum
over its n-grams divided by their number.

The threshold is found once, from the scores of all labelled documents counted in
BINS fixed bins: among the cuts that keep at least ``keep`` of the trusted
documents, the one that rejects most of the others, in the middle where several
do the same.  Without labels of both kinds the threshold is minus infinity, and
only the base rules reject.

Base rules, by words (runs of characters other than blank and \\t to \\r): fewer
than ``least_words`` words, or more than half of the words inside 3-word
windows that occur twice or more in the text.

Nulls and empty texts have no words and fail the base rules.  A null doc_id is
unlabelled; a document is trusted if all its label rows say quality 1 and none
says toxic 1 (where labels have that column).  Repeated
rows are judged (and counted) each.  Extra columns are kept by
``filter_documents`` and ignored by the query; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import slices, to_batch

N = 4
BITS = 16
BINS = 4096
SPAN = 4.0  # scores beyond +-SPAN count in the outer bins
ALPHA = 0.5
UNIT = 1 << 20
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[bytes]) -> np.ndarray:
    """Buckets of the byte n-grams of a text."""
    if not words:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    if len(b) < N:
        return np.empty(0, np.int64)
    key = np.zeros(len(b) - N + 1, np.uint64)
    for k in range(N):
        key |= b[k:len(b) - N + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    return (key * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def measures(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    inner = b"".join(words)
    chars = len(inner) - len(inner.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split():
            seen.add(line)
    return len(words), chars, len(_SYMBOLS.findall(raw)), dup, repeated(words)


def _texts(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text", limit)


def _raw(part: pa.RecordBatch) -> Iterator[bytes]:
    for text in part["text"].cast(pa.binary()).to_pylist():
        yield text or b""


class Labels:
    """doc_id -> trusted, for a bounded number of documents."""

    def __init__(self, known: dict[int, bool]):
        self.ids = np.array(sorted(known), np.int64)
        self.trusted = np.array([known[k] for k in sorted(known)], bool)

    def of(self, doc_ids: pa.Array) -> np.ndarray:
        """1: trusted, 0: not, -1: without a label."""
        if not len(self.ids):
            return np.full(len(doc_ids), -1)
        ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        found = (self.ids[at] == ids) & doc_ids.is_valid().to_numpy(zero_copy_only=False)
        return np.where(found, self.trusted[at], -1)


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, trusted: a row per labelled document."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    if "toxic" in labels.columns:
        good = good & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("trusted"))


def label_sample(labels: DataFrame, sample: int) -> Labels:
    """The labels of at most ``sample`` documents, for a look at them; ``fit`` uses all."""
    known = known_labels(labels)
    total = known.count()
    if total > sample:  # a little less than the bound, so that the hash's spread stays below it
        place = F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) / (1 << 30)
        known = known.where(place < 0.97 * sample / total)
    return Labels({r.doc_id: r.trusted for r in known.collect()})


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def count_grams(docs: DataFrame, labels: Labels | DataFrame) -> DataFrame:
    """bucket, raw, target: sums over all documents and over the trusted ones, a row per bucket.

    ``labels`` is a frame of ``known_labels`` of any size, or a few labels that the tasks hold.
    """
    if isinstance(labels, DataFrame):
        nothing, trusted = Labels({}), labels.where("trusted").select("doc_id")
        # one kind of join at every size: a plan that broadcasts few ids and moves the texts of many grows faster than the input
        held = _own(docs).join(trusted.hint("shuffle_merge"), "doc_id", "left_semi")
        both = count_grams(docs, nothing).unionByName(count_grams(held, nothing).select(
            "bucket", F.lit(0).cast("long").alias("raw"), F.col("raw").alias("target")))
        return both.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for part in _texts(batches):
            held: tuple[list, list] = ([], [])
            for raw, label in zip(_raw(part), labels.of(part["doc_id"]), strict=True):
                held[int(label == 1)].append(grams(raw.split()))
            for k, some in enumerate(held):
                if some:
                    counts[k] += np.bincount(np.concatenate(some), minlength=1 << BITS)
        used = np.flatnonzero(counts.any(0))
        yield to_batch(schema, [pa.array(used, pa.int32()), pa.array(counts[:, used].sum(0), pa.int64()),
                                pa.array(counts[1, used], pa.int64())])

    return _own(docs).mapInArrow(run, "bucket int, raw long, target long") \
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(counts: DataFrame) -> np.ndarray:
    """Weight of each bucket in units of 1 / UNIT; 2**BITS numbers whatever the input."""
    held = np.zeros((2, 1 << BITS))
    for r in counts.collect():
        held[:, r.bucket] = r.raw, r.target
    logs = np.log((held + ALPHA) / (held.sum(1, keepdims=True) + ALPHA * (1 << BITS)))
    return np.round((logs[1] - logs[0]) * UNIT).astype(np.int64)


def score(raw: bytes, table: np.ndarray, words: list[bytes] | None = None) -> float:
    own = grams(raw.split() if words is None else words)
    return int(table[own].sum()) / UNIT / len(own) if len(own) else 0.0


def _bin(value: float) -> int:
    return min(BINS - 1, max(0, math.floor((value + SPAN) * BINS / (2 * SPAN))))


def threshold(docs: DataFrame, known: DataFrame, table: np.ndarray, keep: float) -> float:
    """The lower edge of the best bin, from the scores of all labelled documents; only ids and bins meet the labels."""
    schema = pa.schema([("doc_id", pa.int64()), ("bin", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches):
            words = [raw.split() for raw in _raw(part)]
            bins = [_bin(score(b"", table, w)) if w else None for w in words]
            yield to_batch(schema, [part["doc_id"], bins])

    sums = _own(docs).mapInArrow(run, "doc_id long, bin int").where("bin is not null").join(known, "doc_id").groupBy("bin") \
        .agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad")).collect()
    n = np.zeros((BINS + 1, 2), np.int64)
    for r in sums:
        n[r.bin + 1] = r.good, r.bad
    if not n[:, 0].sum() or not n[:, 1].sum():
        return -math.inf
    below = np.cumsum(n, 0)  # row k: documents below the lower edge of bin k
    allowed = np.flatnonzero(below[:, 0] <= (1 - keep) * below[-1, 0])
    gain = below[allowed, 1] - 10 * below[allowed, 0]
    ties = allowed[gain == gain.max()]
    best = int(ties[len(ties) // 2])
    return best * 2 * SPAN / BINS - SPAN if best else -math.inf


class Model:
    """Weights and threshold; the same size whatever the corpus."""

    def __init__(self, table: np.ndarray, least: float, least_words: int = 50):
        self.table, self.least, self.least_words = table, least, least_words

    def judge(self, raw: bytes) -> tuple[int, int, int, int, int, bool, bool, float]:
        words = raw.split()
        found = measures(raw, words)
        failed = found[0] < self.least_words or 100 * found[4] > 50 * found[0]
        value = score(raw, self.table, words)
        return *found, failed, not failed and value >= self.least, value


def fit(docs: DataFrame, labels: DataFrame, keep: float = 0.995) -> Model:
    """Counts over all documents; target and threshold from all labelled ones."""
    known = known_labels(labels)
    table = weights(count_grams(docs, known))
    return Model(table, threshold(docs, known, table, keep))


def judge_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the measures, base_failed, kept, score of every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches):
            rows = [model.judge(raw) for raw in _raw(part)]
            yield to_batch(schema, [part["doc_id"], *(zip(*rows, strict=True) if rows else [[]] * 8)])

    return _own(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, base_failed boolean, kept boolean, score double")


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns; only the text goes to Python, and a verdict back."""
    def keeps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            verdicts = [model.judge(raw)[6] for part in _texts(iter([batch])) for raw in _raw(part)]
            yield pa.array(verdicts, pa.bool_())

    return docs.where(F.arrow_udf(keeps, "boolean")("text"))


def op2_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge_documents(docs, fit(docs, labels))
