"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node (its least vec_id), so copies don't crowd the graph.

Graph.  A start comes from exact neighbours inside runs of nodes that are next
to each other along a few random projections.  Each round is a Spark join: a
node's neighbours and nearest reverse neighbours meet (neighbours of neighbours),
every pair of them with a new edge is measured, and those nearer than either
one's worst neighbour become candidates; each node keeps its ``k`` nearest.
Rounds end when few edges change.  A node sees at most k + ``reverse`` others in
a round, whatever its popularity.

Search.  A query holds a beam of the ``beam`` nearest nodes seen.  It starts
from a fixed number of entry nodes, and from its own node if it is indexed; each
round expands its ``expand`` nearest nodes not expanded yet, by joins with the
graph and the vectors, until all of the beam are expanded.  The nearest of the
beam are then measured exactly, in double precision on the original vectors, and
nodes are replaced by their rows (as many of the smallest vec_ids as a result can
hold).  Inside the graph, vectors are multiplied by one power of two (so that no
square overflows) and packed as floats if all of them are that exactly, else as
doubles.  Distances are doubles, by differences where two vectors are close;
those below about 1e-150 of the largest component underflow.

Every valid row is indexed.  Vectors that are null, zero, of another length than
the commonest (the shortest of equals), or that hold null or non-finite
components take no part, as query or candidate.  vec_id is a key: of rows that
repeat one, the one with the least vector stays; a null vec_id takes no part.
With no valid rows there are no results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import bounds, cut, to_batch, whole_groups

EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("d", pa.float64()), ("new", pa.bool_())])
EDGE_SQL = "u long, v long, d double, new boolean"
CLOSE = 1e-8  # squared distances below this share of the squared lengths are measured by differences


@dataclass(frozen=True)
class Settings:
    k: int = 32
    reverse: int = 24
    projections: int = 4
    run: int = 512
    rounds: int = 8
    settled: float = 0.01
    per_member: int = 8
    entries: int = 128
    beam: int = 480
    expand: int = 120
    exact: int = 64
    seed: int = 7
    kind: str = "<f8"  # of the packed vectors; ``fitted`` sets it, and
    shift: int = 0  # the power of two


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors as rows."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.empty((0, 0), kind)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, dim, vec (packed doubles), top, low, single of (vec_id, vector).

    top and low: the largest and least exponent; single: whether all components have at most 24 bits.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("top", pa.int32()),
                        ("low", pa.int32()), ("single", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, vecs, tops, lows, singles = [], [], [], [], [], []
            for vec_id, v in zip(batch["vec_id"].to_pylist(), batch["vector"].to_pylist(), strict=True):
                if vec_id is None or not v or None in v:
                    continue
                a = np.array(v, "<f8")
                if np.isfinite(a).all() and a.any():
                    ids.append(vec_id)
                    dims.append(len(a))
                    vecs.append((a + 0.0).tobytes())  # one zero
                    bits, power = np.frexp(a[a != 0])
                    tops.append(int(power.max()))
                    lows.append(int(power.min()))
                    singles.append(bool((np.ldexp(bits, 24) % 1 == 0).all()))
            yield to_batch(schema, [ids, dims, vecs, tops, lows, singles])

    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>")
                        .alias("vector")).mapInArrow(run, "vec_id long, dim int, vec binary, top int, low int, single boolean")
    found = cut(found.groupBy("vec_id").agg(F.min(F.struct("vec", "dim", "top", "low", "single")).alias("m"))
                .select("vec_id", "m.dim", "m.vec", "m.top", "m.low", "m.single"), "nn-valid")
    common = found.groupBy("dim").count().agg(F.max_by("dim", F.struct("count", (-F.col("dim")).alias("d")))
                                              .alias("dim")).select("dim").scalar()
    return found.where(F.col("dim") == common)


def fitted(valid: DataFrame, s: Settings) -> Settings:
    """``s`` with the kind and shift that lose nothing of the valid vectors."""
    top, low, single = valid.agg(F.max("top"), F.min("low"), F.min("single")).first()
    if top is None:
        return s
    return replace(s, shift=-top, kind="<f4" if single and low - top >= -125 else "<f8")


def _nodes(valid: DataFrame, s: Settings) -> DataFrame:
    """node, vec (packed as s.kind), proj (random projections) of each distinct vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.ldexp(_matrix(batch["vec"], "<f8"), s.shift)
            way = np.random.default_rng(s.seed).standard_normal((m.shape[1], s.projections))
            p = m @ way
            yield pa.record_batch({
                "node": batch["node"], "vec": pa.array([x.tobytes() for x in m.astype(s.kind)], pa.binary()),
                "proj": pa.array(list(p), pa.list_(pa.float64()))})

    distinct = valid.groupBy("vec").agg(F.min("vec_id").alias("node"))
    return distinct.select("node", "vec").mapInArrow(run, "node long, vec binary, proj array<double>")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of a to each of b."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    d = size - 2 * a @ b.T
    row, col = np.nonzero(d <= CLOSE * size)
    for k in range(0, len(row), 20_000):
        x = a[row[k:k + 20_000]] - b[col[k:k + 20_000]]
        d[row[k:k + 20_000], col[k:k + 20_000]] = (x * x).sum(1)
    return np.sqrt(d)


def _lengths(d: np.ndarray) -> np.ndarray:
    """Length of each row; a power of two is taken out, so that no square overflows."""
    power = np.frexp(np.abs(d).max(1, initial=0))[1]
    d = np.ldexp(d, -power[:, None])
    return np.ldexp(np.sqrt((d * d).sum(1)), power)


def _start(nodes: DataFrame, s: Settings) -> DataFrame:
    """Edges to the nearest others in a run along each projection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(rows: pa.Table):
            ids, m = rows["node"].to_numpy(), _matrix(rows["vec"].combine_chunks(), s.kind)
            d = _distances(m, m)
            np.fill_diagonal(d, np.inf)
            k = min(s.k, len(ids) - 1)
            at = np.argpartition(d, k - 1, 1)[:, :k] if k else np.empty((len(ids), 0), np.int64)
            return to_batch(EDGE, [pa.array(np.repeat(ids, k)), pa.array(ids[at].ravel()),
                                   pa.array(np.take_along_axis(d, at, 1).ravel()),
                                   pa.array(np.ones(k * len(ids), bool))])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= 2 * s.run:
                rows = pa.Table.from_batches(held)
                yield near(rows.slice(0, s.run))
                held = rows.slice(s.run).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield near(pa.Table.from_batches(held))

    out = None
    for r in range(s.projections):
        line = nodes.select("node", "vec", F.col("proj")[r].alias("at")).repartitionByRange("at") \
            .sortWithinPartitions("at", "node").select("node", "vec").mapInArrow(run, EDGE_SQL)
        out = line if out is None else out.unionByName(line)
    return out


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours of each node."""
    one = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))) \
        .where(F.col("rank") <= k).drop("rank")


def _around(edges: DataFrame, s: Settings) -> DataFrame:
    """u, v, new: neighbours and the nearest reverse neighbours."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "new")
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("new"), "d", "v"))) \
        .where(F.col("rank") <= s.reverse).drop("rank")
    return edges.unionByName(back).groupBy("u", "v").agg(F.max("new").alias("new"))


def _meet(edges: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """One round: candidate edges between those that meet around a node."""
    worst = edges.groupBy("u").agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("n")).select(
        F.col("u").alias("node"), F.when(F.col("n") >= s.k, F.col("worst")).otherwise(F.lit(float("inf")))
        .alias("worst"))
    known = nodes.select("node", "vec").join(worst, "node", "left").select(
        F.col("node").alias("v"), "vec", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    around = _around(edges, s)
    lively = around.groupBy("u").agg(F.max("new").alias("any")).where("any").select("u")
    rows = around.join(lively, "u", "left_semi").join(known, "v").select("u", "v", "new", "vec", "worst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(us, vs, ds):
            u, v, d = np.concatenate(us), np.concatenate(vs), np.concatenate(ds)
            order = np.lexsort((d, v, u))
            u, v, d = u[order], v[order], d[order]
            fresh = np.ones(len(u), bool)
            fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            u, v, d = u[fresh], v[fresh], d[fresh]
            order = np.lexsort((v, d, u))
            u, v, d = u[order], v[order], d[order]
            first = bounds(u)[:-1]
            place = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
            keep = place < s.k
            return u[keep], v[keep], d[keep]

        us, vs, ds, held = [], [], [], 0
        for part in whole_groups(batches, "u"):
            ids, new = part["v"].to_numpy(), part["new"].to_numpy(zero_copy_only=False)
            m, worst = _matrix(part["vec"], s.kind), part["worst"].to_numpy()
            at = bounds(part["u"].to_numpy())
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a < 2:
                    continue
                own = ids[a:b]
                d = _distances(m[a:b], m[a:b])
                ok = (new[a:b, None] | new[None, a:b]) & (d < worst[a:b, None])
                np.fill_diagonal(ok, False)
                d = np.where(ok, d, np.inf)
                few = min(s.per_member, b - a - 1)
                near = np.argpartition(d, few - 1, 1)[:, :few]
                got = np.take_along_axis(d, near, 1)
                row, col = np.nonzero(np.isfinite(got))
                us.append(own[row])
                vs.append(own[near[row, col]])
                ds.append(got[row, col])
                held += len(row)
            if held > 1_000_000:
                u, v, d = best(us, vs, ds)
                us, vs, ds, held = [u], [v], [d], 0
        if us:
            u, v, d = best(us, vs, ds)
            for k in range(0, len(u), 100_000):
                yield to_batch(EDGE, [pa.array(x[k:k + 100_000]) for x in (u, v, d, np.ones(len(u), bool))])

    return rows.repartition("u").sortWithinPartitions("u").mapInArrow(run, EDGE_SQL)


def neighbour_graph(nodes: DataFrame, s: Settings) -> DataFrame:
    """Stored u, v: each node's neighbours and nearest reverse neighbours.  ``nodes`` must be a stored table."""
    edges = cut(_nearest(_start(nodes, s), s.k), "nn-edges")
    for _ in range(s.rounds):
        more = _meet(edges, nodes, s)
        edges = cut(_nearest(edges.withColumn("new", F.lit(False)).unionByName(more), s.k), "nn-edges")
        n, fresh = edges.agg(F.count(F.lit(1)), F.count_if("new")).first()
        if fresh <= s.settled * n:
            break
    return cut(_around(edges, s).select("u", "v"), "nn-graph")


BEAM = "array<struct<d:double,id:long,done:boolean>>"
_BEAM = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("done", pa.bool_())]))


def _merge(seen: dict[int, tuple[float, bool]], ids, d, size: int) -> list[dict]:
    for i, x in zip(ids, d, strict=True):
        if i not in seen:
            seen[i] = (x, False)
    ordered = sorted((x, i, done) for i, (x, done) in seen.items())[:size]
    return [{"d": x, "id": i, "done": done} for x, i, done in ordered]


def _advance(state: DataFrame, graph: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Expand the nearest unexpanded nodes of each beam."""
    todo = F.slice(F.filter("beam", lambda b: ~b["done"]), 1, s.expand)
    moved = state.withColumn("go", F.transform(todo, lambda b: b["id"]))
    moved = moved.withColumn("beam", F.transform("beam", lambda b: F.struct(
        b["d"].alias("d"), b["id"].alias("id"), (b["done"] | F.array_contains("go", b["id"])).alias("done"))))
    steps = moved.select("q", F.explode("go").alias("u")).join(graph, "u").select("q", F.col("v").alias("node"))
    reached = steps.distinct().join(nodes.select("node", "vec"), "node").select(
        "q", F.lit(1).alias("kind"), "node", "vec", F.lit(None).cast(BEAM).alias("beam"))
    rows = moved.select("q", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("node"), F.col("qvec").alias("vec"),
                        "beam").unionByName(reached)
    schema = pa.schema([("q", pa.int64()), ("qvec", pa.binary()), ("beam", _BEAM)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "q", 20_000):
            at = bounds(part["q"].to_numpy())
            m = _matrix(part["vec"], s.kind)
            ids = part["node"].fill_null(-1).to_numpy()
            qs, vecs, beams = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):  # the query's own row is the first
                d = _distances(m[a:a + 1], m[a + 1:b])[0].tolist() if b - a > 1 else []
                seen = {x["id"]: (x["d"], x["done"]) for x in part["beam"][a].as_py()}
                beams.append(_merge(seen, ids[a + 1:b].tolist(), d, s.beam))
                qs.append(part["q"][a].as_py())
                vecs.append(part["vec"][a].as_py())
            yield to_batch(schema, [qs, vecs, beams])

    return rows.repartition("q").sortWithinPartitions("q", "kind").mapInArrow(
        run, f"q long, qvec binary, beam {BEAM}")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, s: Settings) -> DataFrame:
    """q, node: the ``exact`` nearest of each query's beam.  ``queries``: q, qvec (packed as s.kind), own (its node or null)."""
    entries = nodes.orderBy(F.xxhash64("node"), "node").limit(s.entries).select("node", "vec").collect()
    if not entries:
        return queries.select("q", F.col("own").alias("node")).limit(0)
    ids = [r.node for r in entries]
    vecs = np.frombuffer(b"".join(bytes(r.vec) for r in entries), s.kind).reshape(len(ids), -1)
    schema = pa.schema([("q", pa.int64()), ("qvec", pa.binary()), ("beam", _BEAM)])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_matrix(batch["qvec"], s.kind), vecs)
            beams = []
            for row, own in zip(d, batch["own"].to_pylist(), strict=True):
                seen = {} if own is None else {own: (0.0, False)}
                beams.append(_merge(seen, ids, row.tolist(), s.beam))
            yield to_batch(schema, [batch["q"], batch["qvec"], beams])

    state = cut(queries.select("q", "qvec", "own").mapInArrow(begin, f"q long, qvec binary, beam {BEAM}"), "nn-beams")
    open_ = F.exists("beam", lambda b: ~b["done"])
    done = []
    while True:
        state = cut(_advance(state, graph, nodes, s), "nn-beams")
        done.append(state.where(~open_))
        state = state.where(open_)
        if state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("q", F.explode(F.slice("beam", 1, s.exact)).alias("b")).select("q", F.col("b.id").alias("node"))


def nearest(rows: DataFrame, is_query: Column, top: int = 10, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest other rows of each query among (vec_id, vector)."""
    valid = valid_vectors(rows)
    s = fitted(valid, s)
    nodes = cut(_nodes(valid, s), "nn-nodes")
    graph = neighbour_graph(nodes, s)
    place = Window.partitionBy("vec").orderBy("vec_id")
    classes = valid.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top + 1)
    members = cut(classes.withColumn("node", F.min("vec_id").over(Window.partitionBy("vec")))
                  .select("node", "vec_id", "vec"), "nn-members")
    firsts = members.where("node = vec_id")
    queries = valid.where(is_query).select(F.col("vec_id").alias("q"), F.col("vec").alias("full"))
    queries = cut(queries.join(firsts.select(F.col("vec").alias("full"), "node"), "full")
                  .join(nodes.select("node", F.col("vec").alias("qvec")), "node")
                  .select("q", "qvec", F.col("node").alias("own"), "full"), "nn-queries")
    found = search(queries, nodes, graph, s)
    pairs = found.join(queries.select("q", "full"), "q").join(firsts.select("node", "vec"), "node")
    schema = pa.schema([("q", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _matrix(batch["full"], "<f8") - _matrix(batch["vec"], "<f8")
            yield to_batch(schema, [batch["q"], batch["node"], pa.array(_lengths(d) if len(d) else [], pa.float64())])

    scored = pairs.select("q", "node", "full", "vec").mapInArrow(measure, "q long, node long, score double")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return scored.join(members.select("node", "vec_id"), "node").where("vec_id <> q") \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select(F.col("q").alias("query_id"), "rank", "vec_id", "score")


def op4_query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings.select("vec_id", F.col("embedding").alias("vector")), F.col("vec_id") % 100 == 0)
