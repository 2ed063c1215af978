"""Ranked lexical search with geometric blocks of posting lists.

An index is made for a set of queries.  Documents become vectors over the
queries' terms, are ordered by the signs of a random projection (similar ones
lie together, copies are spread over tasks by a hash) and cut into chunks.  In a
chunk each term's posting list is clustered: evenly spaced documents of the list
are centres, each document joins the centre nearest by projection, and a cluster
is a block (cut where it has more than 4 * BLOCK documents).  A block's summary
holds the largest value of each term over its documents, for the terms that
share a query with the list's term; no other query visits the list.

Search goes through a chunk's blocks in the order of their bounds (the summary's
score).  A bound is at least the score of each document in its block, so once
it is below the query's K-th best score so far, the remaining blocks are skipped;
an equal bound may hide a tie and is read.  Found documents are scored in full,
in whole numbers.  Each task goes on with its best from chunk to chunk; the
tasks' best are ranked once more.

Queries come in groups of at most MAX_TERMS distinct terms (a longer query is a
group of its own), MAX_ITEMS queries and MAX_PAIRS (query, term) pairs; a group's
terms and queries go to all tasks, and each group has its own index.

Only A-Z are lower-cased.  Null texts have no terms.  Rows that occur twice are
ranked twice; a row without doc_id ranks after others of the same score, and a
query row that occurs twice is answered twice.  Documents without terms and
queries without terms or matches give no rows; so do empty tables.  Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import cut, slices, to_batch

K = 10
BLOCK = 64
CELLS = 1 << 23
MAX_DOCS = 4096
TASK_DOCS = 16_384
DIMENSIONS = 32
MAX_TERMS = 4096
MAX_ITEMS = 4096
MAX_PAIRS = 1 << 18
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

FORWARD = "doc_id long, n long, terms binary, counts binary"
CHUNK = ("ids binary, known binary, ends binary, terms binary, factors binary, list_terms binary, list_blocks binary, "
         "block_sizes binary, block_docs binary, summary_sizes binary, summary_terms binary, summary_tops binary")
SINGLE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20), "compression": "zstd"}


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


class Queries:
    """A group of queries over one list of terms: each has its terms' numbers and how often it holds them."""

    def __init__(self, items: list[tuple[int, int | None, Counter]]):
        self.numbers = [number for number, _, _ in items]
        self.item_ids = [item_id for _, item_id, _ in items]
        self.terms = sorted({t for _, _, held in items for t in held})
        self.place = {t: k for k, t in enumerate(self.terms)}
        self.held, self.times = [], []
        for _, _, held in items:
            order = sorted((self.place[t], n) for t, n in held.items())
            self.held.append(np.array([t for t, _ in order], np.int64))
            self.times.append(np.array([n for _, n in order], np.int64))

    def company(self) -> list[np.ndarray]:
        """For each term, the terms that share a query with it, itself included, in ascending order."""
        met: list[list[np.ndarray]] = [[] for _ in self.terms]
        for held in self.held:
            for t in held.tolist():
                met[t].append(held)
        return [np.unique(np.concatenate(m)) for m in met]


def query_groups(items: DataFrame) -> Iterator[Queries]:
    """The queries with terms in groups of bounded size, in the order of their ids."""
    group, terms, pairs = [], set(), 0
    rows = items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    for number, r in enumerate(rows):
        held = Counter(terms_of((r.text or "").encode()))
        if not held:
            continue
        if group and (len(terms | held.keys()) > MAX_TERMS or len(group) == MAX_ITEMS or pairs + len(held) > MAX_PAIRS):
            yield Queries(group)
            group, terms, pairs = [], set(), 0
        group.append((number, r.item_id, held))
        terms |= held.keys()
        pairs += len(held)
    if group:
        yield Queries(group)


# ---- vectors

def _forward(place: dict[bytes, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                rows = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                    found = terms_of(text or b"")
                    if found:
                        held = sorted((place[t], n) for t, n in Counter(found).items() if t in place)
                        rows.append((doc_id, len(found), np.array([t for t, _ in held], "<u4").tobytes(),
                                     np.array([n for _, n in held], "<u4").tobytes()))
                yield to_batch(schema, list(map(list, zip(*rows, strict=True))) if rows else [[], [], [], []])
    return run


def forward(docs: DataFrame, queries: Queries) -> DataFrame:
    """One row per document that has terms: all its terms counted in ``n``, those of the queries with their counts."""
    return docs.select("doc_id", "text").mapInArrow(_forward(queries.place), FORWARD)


def _document_counts(size: int):
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), "<u4"), minlength=size)
        at = np.flatnonzero(df)
        yield to_batch(schema, [pa.array(at, pa.int32()), pa.array(df[at])])
    return run


class Weights:
    """Corpus counts: N documents, L terms in all, each query term's weight."""

    def __init__(self, documents: int, length: int, df: np.ndarray):
        self.documents, self.length = documents, length
        self.w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def factors(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 75 + (75 * n * self.documents) // self.length
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)  # under 1,000,000


def weigh(vectors: DataFrame, queries: Queries) -> Weights:
    documents, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(queries.terms), np.int64)
    counted = vectors.select("terms").mapInArrow(_document_counts(len(df)), "term int, df long")
    for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per query term at most
        df[r.term] = r.df
    return Weights(documents, length, df)


# ---- index

def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, where each row's terms end, terms, counts) of forward rows."""
    terms = batch["terms"].to_pylist()
    return (batch["n"].to_numpy().astype(np.int64), np.cumsum([len(t) // 4 for t in terms]),
            np.frombuffer(b"".join(terms), "<u4").astype(np.int64),
            np.frombuffer(b"".join(batch["counts"].to_pylist()), "<u4").astype(np.int64))


def _rows(ends: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def _projection(size: int) -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (size, DIMENSIONS))


def _projected(ends, terms, values, onto: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows' projections."""
    sums = np.zeros((len(ends) + 1, onto.shape[1]), np.float64)
    np.cumsum(onto[terms] * values[:, None].astype(np.float64), axis=0, out=(flat := np.empty((len(terms), onto.shape[1]))))
    sums[1:] = np.concatenate([np.zeros((1, onto.shape[1])), flat])[ends]
    out = np.diff(sums, axis=0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _codes(weights: Weights):
    onto = _projection(len(weights.w))
    schema = pa.schema([("code", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()),
                        ("counts", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "terms", 1 << 18):
                n, ends, terms, tf = _unpacked(batch)
                near = _projected(ends, terms, weights.factors(n[_rows(ends)], tf) * weights.w[terms], onto)
                code = (near[:, :16] > 0) @ (1 << np.arange(15, -1, -1))
                yield to_batch(schema, [pa.array(code, pa.int32()), *batch.columns])
    return run


def blocks_of(docs: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents of a list in the order of its blocks, the blocks' sizes)."""
    if len(docs) <= BLOCK:
        return docs, np.array([len(docs)])
    centres = docs[::BLOCK]
    mine = np.argmax(near[docs] @ near[centres].T, axis=1)
    sizes = np.bincount(mine, minlength=len(centres))
    cutoff = 4 * BLOCK
    return docs[np.argsort(mine, kind="stable")], np.array([min(cutoff, s - k) for s in sizes.tolist() for k in range(0, s, cutoff)])


def _chunk(ids: pa.Array, n, ends, terms, tf, weights: Weights, company: list[np.ndarray], onto: np.ndarray) -> list[bytes]:
    rows = _rows(ends)
    factors = weights.factors(n[rows], tf)
    near = _projected(ends, terms, factors * weights.w[terms], onto)
    table = np.zeros((len(ends), len(weights.w)), np.int32)
    table[rows, terms] = factors
    order = np.argsort(terms, kind="stable")
    listed, starts = np.unique(terms[order], return_index=True)
    list_blocks, sizes, docs, summary_sizes, summary_terms, tops = [], [], [], [], [], []
    for t, held in zip(listed.tolist(), np.split(rows[order], starts[1:]), strict=True):
        held, size = blocks_of(held, near)
        top = np.maximum.reduceat(table[np.ix_(held, company[t])], np.cumsum(size) - size, axis=0)
        block, at = np.nonzero(top)
        list_blocks.append(len(size))
        sizes.append(size)
        docs.append(held)
        summary_sizes.append(np.bincount(block, minlength=len(size)))
        summary_terms.append(company[t][at])
        tops.append(top[block, at])

    def packed(parts, kind="<u4"):
        return np.concatenate(parts).astype(kind).tobytes() if len(parts) else b""

    return [ids.fill_null(0).to_numpy().astype("<i8").tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
            packed([ends]), packed([terms]), packed([factors]), packed([listed]), packed([list_blocks]), packed(sizes),
            packed(docs), packed(summary_sizes), packed(summary_terms), packed(tops)]


def _build(weights: Weights, queries: Queries):
    names = [c.split()[0] for c in CHUNK.split(", ")]
    schema = pa.schema([(name, pa.binary()) for name in names])
    most = max(1, min(MAX_DOCS, CELLS // len(weights.w)))

    def run(batches):
        company, onto = queries.company(), _projection(len(weights.w))

        def chunk(batch):
            return to_batch(schema, [[v] for v in _chunk(batch["doc_id"], *_unpacked(batch), weights, company, onto)])

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == most:
                    yield chunk(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, rows = [], 0
        if rows:
            yield chunk(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    return run


class Index:
    """The chunks' table with the queries it serves and the corpus counts."""

    def __init__(self, table: DataFrame, weights: Weights, queries: Queries):
        self.table, self.weights, self.queries = table, weights, queries


def build(docs: DataFrame, queries: Queries) -> Index:
    vectors = cut(forward(docs, queries), "vectors")
    weights = weigh(vectors, queries)
    coded = vectors.where(F.length("terms") > 0).mapInArrow(_codes(weights), "code int, " + FORWARD)
    tasks = max(1, -(-weights.documents // TASK_DOCS))
    dealt = coded.withColumn("salt", F.xxhash64("doc_id")).repartitionByRange(tasks, "code", "salt") \
        .sortWithinPartitions("code", "salt").drop("code", "salt")
    return Index(cut(dealt.mapInArrow(_build(weights, queries), CHUNK), "lexical-index", **SINGLE_ROWS), weights, queries)


# ---- search

class Chunk:
    """A stored chunk, with each list's summaries as a matrix over the terms that keep its term company."""

    def __init__(self, row: dict, size: int):
        def numbers(name, kind="<u4"):
            return np.frombuffer(row[name], kind).astype(np.int64)

        self.ids, self.known = numbers("ids", "<i8"), np.frombuffer(row["known"], bool)
        ends = numbers("ends")
        self.table = np.zeros((len(ends), size), np.int32)
        self.table[_rows(ends), numbers("terms")] = numbers("factors")
        blocks = np.cumsum(numbers("list_blocks"))
        self.lists = dict(zip(numbers("list_terms").tolist(),
                              zip((blocks - numbers("list_blocks")).tolist(), blocks.tolist(), strict=True), strict=True))
        self.docs, self.block_ends = numbers("block_docs"), np.concatenate([[0], np.cumsum(numbers("block_sizes"))])
        self.summary_ends = np.concatenate([[0], np.cumsum(numbers("summary_sizes"))])
        self.summary_terms, self.tops = numbers("summary_terms"), numbers("summary_tops")
        self.matrices: dict[int, np.ndarray] = {}

    def summaries(self, t: int, company: np.ndarray) -> np.ndarray:
        if t not in self.matrices:
            first, last = self.lists[t]
            ends = self.summary_ends[first:last + 1]
            out = np.zeros((last - first, len(company)), np.int64)
            at = np.searchsorted(company, self.summary_terms[ends[0]:ends[-1]])
            out[np.repeat(np.arange(last - first), np.diff(ends)), at] = self.tops[ends[0]:ends[-1]]
            self.matrices[t] = out
        return self.matrices[t]


class Best:
    """A query's best documents so far, best first."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A score below this can't enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores, ids, known) -> None:
        able = scores >= self.least()
        if able.any():
            scores, ids, known = (np.concatenate([old, new[able]]) for old, new in
                                  ((self.scores, scores), (self.ids, ids), (self.known, known)))
            order = np.lexsort((ids, ~known, -scores))[:self.k]
            self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def search_chunk(chunk: Chunk, held: np.ndarray, gains: np.ndarray, company: list[np.ndarray], best: Best) -> int:
    """Take a chunk's documents into a query's best; returns how many documents were scored."""
    mine = [t for t in held.tolist() if t in chunk.lists]
    if not mine:
        return 0
    bounds = np.concatenate([chunk.summaries(t, company[t])[:, np.searchsorted(company[t], held)] @ gains for t in mine])
    blocks = np.concatenate([np.arange(*chunk.lists[t]) for t in mine])
    order = np.argsort(-bounds, kind="stable")
    bounds, blocks = bounds[order], blocks[order]
    seen = np.zeros(len(chunk.ids), bool)
    at, step = 0, 4
    while at < len(blocks) and bounds[at] >= best.least():
        able = at + int(np.searchsorted(-bounds[at:at + step], -best.least(), side="right"))
        docs = np.unique(np.concatenate([chunk.docs[chunk.block_ends[b]:chunk.block_ends[b + 1]] for b in blocks[at:able]]))
        docs = docs[~seen[docs]]
        seen[docs] = True
        best.add(chunk.table[np.ix_(docs, held)].astype(np.int64) @ gains, chunk.ids[docs], chunk.known[docs])
        at, step = able, step * 2
    return int(seen.sum())


def _search(weights: Weights, queries: Queries, k: int):
    schema = pa.schema([("number", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        company = queries.company()
        gains = [times * weights.w[held] for held, times in zip(queries.held, queries.times, strict=True)]
        best = [Best(k) for _ in queries.held]
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk(batch.slice(row, 1).to_pylist()[0], len(weights.w))
                for held, gain, top in zip(queries.held, gains, best, strict=True):
                    search_chunk(chunk, held, gain, company, top)
        rows = [(number, item_id, int(i) if known else None, int(score))
                for number, item_id, top in zip(queries.numbers, queries.item_ids, best, strict=True)
                for score, i, known in zip(top.scores, top.ids, top.known, strict=True)]
        yield to_batch(schema, list(map(list, zip(*rows, strict=True))) if rows else [[], [], [], []])
    return run


def search(index: Index, k: int = K) -> DataFrame:
    """number (the query's place), item_id, rank, doc_id, score: the k best of each query that have a score above 0."""
    found = index.table.mapInArrow(_search(index.weights, index.queries, k), "number long, item_id long, doc_id long, score long")
    place = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of each query: item_id, rank, doc_id, score."""
    found = [cut(search(build(docs, group), k), "ranked") for group in query_groups(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found).select("item_id", "rank", "doc_id", "score")


def op11_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return rank_documents(docs, items)


PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS_SQL = ("SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              f"'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')) AS term FROM {{table}}")
SQL = f"""
WITH d AS ({_TERMS_SQL.format(key='doc_id', table='documents')}),
q AS ({_TERMS_SQL.format(key='item_id', table='benchmark')}),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS len FROM s),
v AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM v, c),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // len)))) AS BIGINT) AS score
      FROM qt JOIN w USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
