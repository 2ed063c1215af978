"""Ranked search, spelling variants and exact copies against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hirelens.llm import exact_dedup, lexical_search, spelling
from hirelens.llm.common import table


@pytest.fixture(scope="session", params=["sf", "odd"])
def docs(request, spark, sf, odd_docs):
    return table(spark, sf, "documents") if request.param == "sf" else odd_docs


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- 11: ranked search

def ranked(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(r.doc_id, Counter(pattern.findall(lowered(r.text)))) for r in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item in items:
        asked = Counter(pattern.findall(lowered(item.text)))
        scored = []
        for doc_id, c, n in held:
            m = 25 + (75 * n * n_docs) // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            out[item.item_id, rank, doc_id, -score] += 1
    return out


@pytest.fixture(scope="session")
def items(spark, sf):
    rows = [(900, "w1x w2x W3X w1x shared3 one"), (901, None), (902, ""), (903, "nothing-matches-zzzzq"), (904, "passage1 passage2"),
            (904, "passage1 passage2"), (None, "line one"), (905, "é" * 500), (906, " ".join(f"w{k}x" for k in range(120)))]
    odd = spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, key string")
    return table(spark, sf, "benchmark").select("item_id", "text").unionByName(odd, allowMissingColumns=True).cache()


def test_search_finds_the_best_documents(docs, items):
    got = lexical_search.op11_query(docs, items)
    assert got.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked(docs.collect(), items.collect())


def test_search_with_small_groups_blocks_and_chunks(docs, items, monkeypatch):
    expected = ranked(docs.collect(), items.collect())
    groups = list(lexical_search.query_groups(items))
    assert len(groups) == 1
    monkeypatch.setattr(lexical_search, "MAX_TERMS", 200)
    many = list(lexical_search.query_groups(items))
    assert len(many) > 1 and all(len(g.terms) <= 200 or len(g.held) == 1 for g in many)
    assert Counter(map(tuple, lexical_search.rank_documents(docs, items).collect())) == expected


def test_search_blocks_bound_their_documents_and_are_skipped():
    rng = random.Random(5)
    vocab = [f"t{k}" for k in range(60)]
    topics = [rng.sample(vocab, 8) for _ in range(12)]
    texts = [Counter(rng.choices(rng.choice(topics), k=30) + ["the"] * rng.randint(1, 4)) for _ in range(1500)]
    queries = lexical_search.Queries([(k, k, Counter(t[:4] + ["the"])) for k, t in enumerate(topics)])
    df = np.array([sum(t in c for c in texts) for t in queries.terms])
    n = np.array([sum(c.values()) for c in texts])
    weights = lexical_search.Weights(len(texts), int(n.sum()), df)
    rows = [sorted((queries.place[t], k) for t, k in c.items() if t in queries.place) for c in texts]
    ends = np.cumsum([len(r) for r in rows])
    terms, tf = (np.array([x[k] for r in rows for x in r], np.int64) for k in (0, 1))
    company = queries.company()
    import pyarrow as pa
    packed = lexical_search._chunk(pa.array(range(len(texts))), n, ends, terms, tf, weights, company,
                                   lexical_search._projection(len(queries.terms)))
    names = [c.split()[0] for c in lexical_search.CHUNK.split(", ")]
    chunk = lexical_search.Chunk(dict(zip(names, packed, strict=True)), len(queries.terms))
    scored = []
    for held, times in zip(queries.held, queries.times, strict=True):
        gains = times * weights.w[held]
        exact = chunk.table[:, held].astype(np.int64) @ gains
        for t in held.tolist():
            bounds = chunk.summaries(t, company[t])[:, np.searchsorted(company[t], held)] @ gains
            first, last = chunk.lists[t]
            listed = chunk.docs[chunk.block_ends[first]:chunk.block_ends[last]]
            assert sorted(listed.tolist()) == np.flatnonzero(chunk.table[:, t]).tolist()
            for block, bound in zip(range(first, last), bounds, strict=True):
                assert exact[chunk.docs[chunk.block_ends[block]:chunk.block_ends[block + 1]]].max() <= bound
        best = lexical_search.Best(10)
        scored.append(lexical_search.search_chunk(chunk, held, gains, company, best))
        order = np.lexsort((np.arange(len(texts)), -exact))[:10]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == exact[order].tolist()
    assert sum(scored) < 0.5 * len(texts) * len(scored)


def test_search_empty(docs, items, empty_docs):
    assert lexical_search.op11_query(empty_docs, items).count() == 0
    assert lexical_search.op11_query(docs, items.limit(0)).collect() == []


# ---- 12: spelling variants

def variants(rows):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 6
    n = {w: k for w, k in count.items() if k >= 5}
    letters = sorted({c for w in n for c in w})
    form, near_of = {}, {}
    for w in n:
        near = {w[:i] + w[i + 1:] for i in range(len(w))}
        near |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        near |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near_of[w] = (near - {w}) & n.keys()
        best = min(near_of[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near_of[w]), n.get(form[w])))
    return out


@pytest.fixture(scope="session")
def misspelt(spark):
    """Chains of forms, ties, long words, accents, repeated rows and missing fields."""
    rng = random.Random(3)
    lines = {"abcdefg": 700, "abcdefh": 100, "abcdeh": 14, "abcdefgg": 9, "abdefg": 6, "zzzzzzz": 25, "zzzzzzy": 25, "zzzzzz": 5,
             "école×né": 30, "ecole×né": 6, "École×né": 7, "aaaaaaaa": 40, "aaaaaaa": 8, "aaaaaaaab": 7, "short": 90, "x" * 3000: 30,
             "x" * 2999 + "y": 5, "x" * 2999: 6, "straße": 4, "kitten": 10, "mitten": 50, "bitten": 50, "sitting": 5}
    words = [w.upper() if rng.random() < 0.2 and w.isascii() else w for w, n in lines.items() for _ in range(n)]
    rng.shuffle(words)
    texts = [" ".join(words[k:k + 40]) for k in range(0, len(words), 40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (50, None), (51, ""), (None, None), (52, "Ǆabcdefgł")]
    return spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3).cache()


@pytest.mark.parametrize("which", ["sf", "odd", "misspelt"])
def test_spelling_variants(request, spark, sf, odd_docs, misspelt, which):
    docs = {"sf": lambda: table(spark, sf, "documents"), "odd": lambda: odd_docs, "misspelt": lambda: misspelt}[which]()
    got = spelling.op12_query(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == variants(docs.collect())


@pytest.mark.parametrize("symbols", [1, 4, 16])
def test_spelling_symbols_change_nothing(misspelt, symbols):
    vocab = spelling.vocabulary(misspelt)
    pairs = spelling.near_pairs(vocab, symbols).collect()
    n = {r.word: r.n for r in vocab.collect()}
    assert {frozenset((p.word, p.near)) for p in pairs} == {frozenset((a, b)) for a in n for b in n if one_edit(a, b)}
    assert len(pairs) == len({frozenset((p.word, p.near)) for p in pairs})
    assert all((p.n, p.near_n) == (n[p.word], n[p.near]) for p in pairs)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def test_spelling_groups(misspelt):
    found = spelling.group_variants(misspelt)
    groups = defaultdict(list)
    for r in spelling.members(found).orderBy("root", "rank").collect():
        groups[r.root].append(r.word)
    assert groups["abcdefg"][:3] == ["abcdefg", "abcdefh", "abcdeh"]  # a chain of forms
    assert sum(map(len, groups.values())) == found.count()


def test_spelling_empty(empty_docs):
    assert spelling.op12_query(empty_docs).collect() == []


# ---- 13: exact copies

def copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r.text)].append(r.doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        order = sorted(ids, key=lambda i: (i is not None, i or 0))
        for i in order[:-1]:
            out[i, keep, len(ids), False, digest] += 1
        out[order[-1], keep, len(ids), True, digest] += 1
    return out


@pytest.fixture(scope="session")
def copied(spark):
    """A hot text over a third of the rows, copies across the history's end, case variants, rows that repeat."""
    rng = random.Random(8)
    rows = [(k, "Hot Text") for k in range(0, 900, 3)] + [(k, f"text {rng.randint(0, 250)}") for k in range(900) if k % 3]
    rows += [(5000, "HOT TEXT"), (5000, "HOT TEXT"), (None, "hot text"), (None, "no id"), (None, "no id"), (5001, None), (5002, ""),
             (5003, "É"), (5004, "é"), (5005, "Text 7"), (5005, "other")]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, 1, "x", 7) for i, t in rows], "doc_id long, text string, row int, digest string, _row int") \
        .repartition(4).cache()


@pytest.mark.parametrize("which", ["sf", "odd", "copied"])
def test_exact_copies(request, spark, sf, odd_docs, copied, which, monkeypatch):
    docs = {"sf": lambda: table(spark, sf, "documents"), "odd": lambda: odd_docs, "copied": lambda: copied}[which]()
    expected = copies(docs.collect())
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, exact_dedup.op13_query(docs).select(*names).collect())) == expected
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(exact_dedup, "TASK_ROWS", 20)  # heavy shards are looked up in parts
    assert Counter(map(tuple, exact_dedup.op13_query(docs).select(*names).collect())) == expected
    left = exact_dedup.drop_repeats(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, hashlib.sha256(lowered(r.text).encode()).hexdigest()) for r in left.collect()) == Counter(
        {(key[0], key[4]): n for key, n in expected.items() if key[3]})


def test_exact_batches_build_segments(spark, copied):
    """Several batches: members update their slots, others are found in later segments, which are merged in time."""
    rows = exact_dedup.digests(copied)
    index = exact_dedup.begin(spark, 100)
    parts = 7
    for k in range(parts):
        index = exact_dedup.absorb(index, exact_dedup.groups(rows.where(f"pmod(hash(row), {parts}) = {k}")))
    assert index.table.agg({"segment": "max"}).first()[0] < exact_dedup.SEGMENTS
    got = exact_dedup.lookup(index, rows).collect()
    whole = {bytes(g.digest): g for g in exact_dedup.groups(rows).collect()}
    assert len(got) == rows.count()
    assert all((g.keep_id, g.keep_row, g.group_size) == (w.doc_id, w.row, w.n) for g in got for w in [whole[bytes(g.digest)]])


def test_exact_nonmembers_are_not_found(spark):
    old = exact_dedup.digests(spark.createDataFrame([(k, f"old {k}") for k in range(300)], "doc_id long, text string"))
    new = exact_dedup.digests(spark.createDataFrame([(k, f"new {k}") for k in range(3000)] + [(1, "OLD 5")], "doc_id long, text string"))
    index = exact_dedup.absorb(exact_dedup.begin(spark, 300), exact_dedup.groups(old))
    got = [r for r in exact_dedup.lookup(index, new).collect() if r.group_size is not None]
    assert [(r.doc_id, r.keep_id, r.group_size) for r in got] == [(1, 5, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_exact_hash_is_minimal_and_perfect(n):
    words = np.frombuffer(b"".join(hashlib.sha256(b"%d" % k).digest() for k in range(n)), "<u8").reshape(-1, 4)
    hashed = exact_dedup.PerfectHash.of(words)
    assert sorted(hashed.slots(words).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.of(np.zeros((2, 4), np.uint64))


def test_exact_empty(empty_docs):
    assert exact_dedup.op13_query(empty_docs).collect() == []
    assert exact_dedup.drop_repeats(empty_docs).collect() == []
