"""Spelling variants of the corpus' words, found in a reduced alphabet.

Letters are hashed to a few symbols.  One edit of a word is at most one edit of
its reduced word, so the full one-edit neighbourhood of each reduced word is
joined with the reduced vocabulary, and pairs that meet are verified on the
original strings (after a look at their sets of letters, which needs no strings).  A neighbour is the 64-bit polynomial hash of its symbols: all
of a word's are made from prefix sums, so a word of any length costs its length
times the number of symbols.  A pair of words is met from one side only: equal
reduced words from the smaller word, a replaced symbol from the word with the
smaller symbol, an inserted or deleted one from the longer word (of a run of
equal symbols only the first is deleted).  Equal hashes of different symbols
give candidates that fail the verification, nothing else.

The number of symbols grows with the sixth root of the vocabulary (the shortest
words have six letters), so that candidates per word stay about even; it changes
what is verified, not what is found.

A word's form is its near word with the largest count, if that is at least RATIO
times its own; its root is where the chain of forms ends.  Counts grow along a
chain by RATIO at each step, so chains are short and pointer doubling ends soon.

Words are counted in tasks before they are shuffled.  Null texts have no words;
a null doc_id reads as an empty one.  Rows that occur twice count twice.  Of
equal counts the word that is smallest in code-point order is the form.  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import cut, slices, to_batch

LETTERS = 6  # words have so many code points at least
LEAST = 5
RATIO = 5
DROPPED = 199
HELD_WORDS = 200_000
BATCH_KEYS = 1 << 20
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LETTERS)  # after lower-casing A-Z; shorter runs give no word
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    counts: Counter[str] = Counter()

    def out():
        return to_batch(schema, [list(counts), list(counts.values())])

    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DROPPED == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < LETTERS:
                            continue
                    counts[run] += n
            if len(counts) > HELD_WORDS:
                yield out()
                counts.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """id, word, n: the words with LEAST occurrences or more, written; ids are any numbers."""
    found = docs.select("doc_id", "text").mapInArrow(_count, "word string, n long")
    words = found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return cut(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def symbol_count(words: int) -> int:
    """Smallest number of symbols whose sixth power reaches the vocabulary, 4 to 16."""
    return next((k for k in range(4, 16) if k ** LETTERS >= words), 16)


def symbols_of(points: np.ndarray, symbols: int) -> np.ndarray:
    """The letters' symbols, 1 and up: a multiplicative hash of the code point."""
    return ((points.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(symbols)) + np.uint64(1)


def _hashes(reduced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of BASE, prefix sums and whole hashes of equally long reduced words (a row each)."""
    m, length = reduced.shape
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(length, BASE)]))
    before = np.zeros((m, length + 1), np.uint64)
    np.cumsum(reduced * power[:length], axis=1, out=before[:, 1:])
    return power, before, before[:, -1]


def _key(hashes: np.ndarray, length: int) -> np.ndarray:
    return (hashes ^ np.uint64(length * 0xBF58476D1CE4E5B9 % (1 << 64))).view(np.int64)


def neighbours(reduced: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, keys, kind) of the words' own keys (0), replacements (1) and deletions (2)."""
    m, length = reduced.shape
    power, before, whole = _hashes(reduced)
    yield np.arange(m), _key(whole, length), 0
    for more in range(1, symbols):  # the symbol at a place grows by ``more``
        row, at = np.nonzero(reduced + np.uint64(more) <= symbols)
        yield row, _key(whole[row] + np.uint64(more) * power[at], length), 1
    first = np.ones((m, length), bool)
    first[:, 1:] = reduced[:, 1:] != reduced[:, :-1]
    row, at = np.nonzero(first)
    yield row, _key(before[row, at] + (whole[row] - before[row, at + 1]) * INVERSE, length - 1), 2


def _by_length(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, code points as a matrix) of words of the same length, in blocks of bounded size."""
    for whole in batches:
        for batch in slices(whole, "word", 1 << 18):
            lengths = np.array([len(w) for w in batch["word"].to_pylist()], np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                step = max(1, BATCH_KEYS // (length * symbols))
                for k in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[k:k + step]))
                    text = "".join(part["word"].to_pylist())
                    yield part["id"], np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(part.num_rows, length)


def _letters(points: np.ndarray) -> np.ndarray:
    """The set of a word's letters in 64 bits; one edit changes two bits at most."""
    return np.bitwise_or.reduce(np.uint64(1) << (points.astype(np.uint64) & np.uint64(63)), axis=1).view(np.int64)


def _own_keys(symbols: int):
    schema = pa.schema([("key", pa.int64()), ("near", pa.int64()), ("near_letters", pa.int64())])

    def run(batches):
        for ids, points in _by_length(batches, symbols):
            reduced = symbols_of(points, symbols)
            yield to_batch(schema, [pa.array(_key(_hashes(reduced)[2], reduced.shape[1])), ids, pa.array(_letters(points))])
    return run


def _neighbour_keys(symbols: int):
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("letters", pa.int64()), ("same", pa.bool_())])

    def run(batches):
        for ids, points in _by_length(batches, symbols):
            letters = _letters(points)
            for rows, keys, kind in neighbours(symbols_of(points, symbols), symbols):
                yield to_batch(schema, [pa.array(keys), ids.take(pa.array(rows)), pa.array(letters[rows]),
                                        pa.array(np.full(len(keys), kind == 0))])
    return run


def near_pairs(vocab: DataFrame, symbols: int) -> DataFrame:
    """Each unordered pair of near words once: word, n, near, near_n.  ``vocab`` has word, n and an id.

    Keys are joined without the words (a long word has many neighbours); pairs whose sets of letters differ too
    much go at once, the others get their words and are verified.
    """
    asked = vocab.mapInArrow(_neighbour_keys(symbols), "key long, id long, letters long, same boolean")
    held = vocab.mapInArrow(_own_keys(symbols), "key long, near long, near_letters long")
    met = asked.join(held, "key").where((~F.col("same") | (F.col("id") < F.col("near")))
                                        & (F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters"))) <= 2))
    pairs = met.select(F.least("id", "near").alias("id"), F.greatest("id", "near").alias("near_id")).distinct()
    words = vocab.select("id", "word", "n")
    others = vocab.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.join(words, "id").join(others, "near_id").where(F.levenshtein("word", "near", 1) == 1) \
        .select("word", "n", "near", "near_n")  # levenshtein over 1 is -1


def forms(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: a word without near words has n_near 0 and no form."""
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("other_n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p"))
    best = both.groupBy("p.word").agg(F.count(F.lit(1)).alias("n_near"),
                                      F.min(F.struct((-F.col("p.other_n")).alias("less"), "p.other")).alias("best"))
    most = -F.col("best.less")
    has = most >= RATIO * F.col("n")
    return vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best.other")).alias("form"), F.when(has, most).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: pointers are doubled until none moves."""
    step = cut(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "word-forms")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                        F.col("next").isNotNull().alias("moved")), "word-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocab = vocabulary(docs)
    pairs = near_pairs(vocab, symbol_count(vocab.count()))
    formed = cut(forms(vocab, pairs), "words")
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def members(variants: DataFrame) -> DataFrame:
    """root, word, n, rank of each group of spellings, most frequent first; a root without variants is a group of one."""
    w = Window.partitionBy("root").orderBy(F.desc("n"), "word")
    return variants.select("root", "word", "n", F.row_number().over(w).alias("rank"))


def op12_query(docs: DataFrame) -> DataFrame:
    return group_variants(docs)
