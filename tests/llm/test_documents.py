"""Operators on documents against brute force, on sf0.001 and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hirelens.llm import gru_lm, jaccard_join, mixing, packing, quality_rules, rans, suffix_index
from hirelens.llm.common import table, to_batch  # noqa: F401
from hirelens.llm.tokens import ChunkEncoder


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="session", params=["sf", "odd"])
def docs(request, spark, sf, odd_docs):
    return table(spark, sf, "documents") if request.param == "sf" else odd_docs


# ---- 2: quality rules


def base(text):
    raw = (text or "").encode()
    w = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if count[x] > 1 for k in range(3)}
    return (len(w), sum(len(x.decode()) for x in w), sum(raw.count(c) for c in b"#*$%&|<>" for c in [bytes([c])]), dup,
            len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_base_rules_and_verdict(spark, sf, docs):
    labels = table(spark, sf, "labels")
    model = quality_rules.fit(docs, labels)
    got = quality_rules.judge_documents(docs, model).collect()
    rows = docs.collect()
    expected = Counter((r.doc_id, *base(r.text)) for r in rows)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed)
                   for g in got) == expected
    assert all(g.kept == (not g.base_failed and g.score >= model.least) for g in got)
    left = quality_rules.filter_documents(docs, model)
    assert left.columns == docs.columns
    assert left.count() == sum(g.kept for g in got)


def test_quality_toxic_rows_are_not_trusted(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (5, 1, 0), (5, 1, 1), (6, None, 0), (None, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = quality_rules.label_sample(labels, 100)
    assert dict(zip(found.ids.tolist(), found.trusted.tolist())) == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    plain = quality_rules.label_sample(labels.drop("toxic"), 100)  # labels without that column
    assert plain.trusted[plain.ids == 2].all()


def test_quality_weights_are_a_log_ratio(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad $$$ stuff"), (3, "good words there")],
                                 "doc_id long, text string")
    labels = quality_rules.Labels({1: True, 2: False})
    counts = quality_rules.count_grams(docs, labels)
    got = quality_rules.weights(counts)
    raw, target = np.zeros(1 << quality_rules.BITS), np.zeros(1 << quality_rules.BITS)
    for r in docs.collect():
        for g in quality_rules.grams(r.text.encode().split()):
            raw[g] += 1
            target[g] += r.doc_id == 1
    n = quality_rules.ALPHA * len(raw)
    want = np.log((target + quality_rules.ALPHA) / (target.sum() + n)) - np.log(
        (raw + quality_rules.ALPHA) / (raw.sum() + n))
    assert np.abs(got / quality_rules.UNIT - want).max() < 1e-6


def test_quality_separates_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = quality_rules.op2_query(docs, labels.drop("toxic")).where("not base_failed").join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)
    rows = quality_rules.op2_query(docs, labels).where("not base_failed").join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and r.toxic == 0)  # toxic ones are not trusted
    assert not any(r.kept for r in rows if r.quality == 0)


# ---- 3: Jaccard join


def jaccard_brute(rows, n, percent):
    sets = {}
    for r in rows:
        w = words(r.text)
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    by = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    for a, b in {(a, b) for m in by.values() for a in m for b in m if a < b}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {(k, len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 30)])
def test_jaccard_components(docs, n, percent):
    got = jaccard_join.link_components(docs, n, percent).where("doc_id is not null").collect()
    rows = docs.collect()
    assert {(g.doc_id, g.n_shingles, g.component_id) for g in got} == jaccard_brute(rows, n, percent)
    assert len(got) == len({r.doc_id for r in rows if r.doc_id is not None})


def test_jaccard_chains_and_large_groups(spark):
    """A chain of texts, each near the next only, and a group whose members differ from its leader."""
    rng = random.Random(3)
    text = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(25):
        rows.append((1000 - k, " ".join(text)))
        text[rng.randrange(60)] = f"new{k}"
    core = [f"c{k}" for k in range(60)]
    for k in range(60):
        own = core[:]
        for _ in range(rng.randrange(6)):
            own[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((1, 90), (2, 80)):
        got = jaccard_join.link_components(docs, n, percent).collect()
        assert {(g.doc_id, g.n_shingles, g.component_id) for g in got} == jaccard_brute(docs.collect(), n, percent)


def test_jaccard_keeps_one_of_each_group(odd_docs):
    left = jaccard_join.drop_duplicates(odd_docs)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == odd_docs.columns
    assert {4, 5, 6, 17} & set(ids) == {4} and ids.count(None) == 2


def test_repeated_rows_leave_one(spark):
    """Repeated rows of a doc_id, and copies without one, leave one row each, also after the next stage."""
    text = {c: " ".join(f"{c}{k}word" for k in range(80)) for c in "abcdef"}
    rows = [(1, text["a"], "x"), (1, text["a"], "x"), (1, text["a"], "y"), (2, text["b"], "x"), (2, text["c"], "x"),
            (None, text["d"], "x"), (None, text["d"], "x"), (None, text["d"].upper(), "y"), (None, text["a"], "x"),
            (3, text["e"], "x"), (4, text["e"], "x"), (4, text["e"], "x"), (None, text["f"], "x"), (None, "", "x"),
            (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(4)
    left = jaccard_join.drop_duplicates(docs)
    assert left.dtypes == docs.dtypes
    got = [(r.doc_id, (r.text or "")[:1].lower()) for r in left.collect()]
    kept_of_2 = next(c for i, c in got if i == 2)
    assert kept_of_2 in "bc"
    assert Counter(got) == Counter([(1, "a"), (2, kept_of_2), (3, "e"), (None, "d"), (None, "f"), (None, ""), (None, "")])
    whole = suffix_index.remove_repeats(left)
    assert Counter((r.doc_id, (r.text or "")[:1].lower()) for r in whole.collect() if r.text) == Counter(
        g for g in got if g[1])


# ---- 10: suffix index


def removed_brute(rows, length):
    seen = Counter()
    for r in rows:
        b = (r.text or "").encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for r in rows:
        b = (r.text or "").encode()
        hit = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                hit[i:i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~hit[:-1]])
        out[(r.doc_id, len(b), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()),
             hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length,window,hot", [(400, 200, 4000), (40, 20, 4000), (40, 20, 3)])
def test_removed_spans(docs, length, window, hot, monkeypatch):
    monkeypatch.setattr(suffix_index.marks_of, "__defaults__", (hot,))
    docs = docs.where("doc_id is null or doc_id <> 15") if length < 400 else docs
    got = Counter(map(tuple, suffix_index.removed_spans(docs, length, window).collect()))
    assert got == removed_brute(docs.collect(), length)


def test_levels_merge_geometrically(odd_docs):
    family = suffix_index.IndexFamily(40, 20)
    keyed = suffix_index._keyed(odd_docs)
    sizes = []
    for _ in range(5):
        family.add(keyed)
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]


def test_remove_repeats_keeps_columns(odd_docs):
    left = suffix_index.remove_repeats(odd_docs)
    assert left.columns == odd_docs.columns
    by = {r.doc_id: r.text for r in left.collect()}
    assert by[1] is None and by[2] == "" and by[8] == "a b c"
    assert "head12" in by[12] and "passage3" not in by[12] and "shared1" not in by[13]
    assert not {4, 5, 17} & set(by)


# ---- 5: language model


def test_language_model_counts_and_base(docs):
    got = gru_lm.op5_query(docs).collect()
    rows = docs.collect()
    held = {r.doc_id: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    c = Counter()
    for r in rows:
        if not held[r.doc_id]:
            c.update([*words(r.text), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        own = [*words(r.text), None]
        want[(r.doc_id, held[r.doc_id], len(own), sum(w in c for w in own), n,
              round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 4))] += 1
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 4))
                   for g in got) == want
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)


def test_language_model_beats_base_on_held_out(spark):
    got = gru_lm.op5_query(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(g.score for g in got) > 0.97 * sum(g.base_score for g in got)


def _network():
    v = gru_lm.Vocabulary([f"w{k}".encode() for k in range(40)], np.arange(40, 0, -1), np.arange(16), np.arange(16), 9,
                          900, 90)
    return v, gru_lm.Network(v, v.start())


def test_probabilities_sum_to_one_and_state_is_carried(monkeypatch):
    v, net = _network()
    rng = np.random.default_rng(0)
    ids = len(v.class_of)
    prefix = rng.integers(0, ids, 9).astype(np.int32)
    total = 0.0
    for k in range(ids):
        total += math.exp(net.read([np.append(prefix, np.int32(k))], False)[0] - net.read([prefix], False)[0])
    assert abs(total - 1) < 1e-3
    seqs = [rng.integers(0, ids, n).astype(np.int32) for n in (1, 50, 200, 7, 64, 65)]
    whole = net.read(seqs, False)
    monkeypatch.setattr(gru_lm, "STEPS", 7)
    monkeypatch.setattr(gru_lm, "SLOTS", 2)
    assert np.allclose(net.read(seqs, False), whole, rtol=1e-4)


def test_gradient_of_a_window(monkeypatch):
    """Backpropagation against finite differences, through a window."""
    v, net = _network()
    rng = np.random.default_rng(1)
    seq = [rng.integers(0, len(v.class_of), 12).astype(np.int32)]
    found = {}
    monkeypatch.setattr(net, "_tables", lambda: None)
    real = gru_lm.Network._learn

    def spy(self, ids, mask, alive, before, g, u, dx, grads):
        keep = {k: x.copy() for k, x in self.p.items()}
        real(self, ids, mask, alive, before, g, u, dx, grads)
        found.update({k: x * mask.sum() for k, x in grads.items()})  # made means in place
        self.p.update(keep)

    monkeypatch.setattr(gru_lm.Network, "_learn", spy)
    net.read(seq, True)
    monkeypatch.undo()
    words = next(k for k in found if k.startswith("word_w"))
    for name in ("gate", "value", "class_w", words):
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        sides = []
        for step in (1e-2, -1e-2):
            p = {k: x.copy() for k, x in net.p.items()}
            p[name][at] += step
            sides.append(-gru_lm.Network(v, p).read(seq, False)[0])
        assert abs((sides[0] - sides[1]) / 2e-2 - found[name][at]) < 0.03 * abs(found[name][at]) + 1e-3, name


# ---- 7, 8: token files and packing


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding_is_the_library_s(name):
    import public_tokenizers

    enc = ChunkEncoder(public_tokenizers.path(name), cap=50)
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t'aAbßÉéñ1²9_.,!$sİ́漢tre’½\u00a0\x1c") for _ in range(rng.randint(0, 40)))
             for _ in range(3000)] + ["<|endoftext|> a", "don't we'll I'M", "  x", " a", "a ", "x \n y"]
    for t in texts:
        assert enc.encode(t) == np.array(enc.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_of_plain_texts_are_the_library_s(name):
    """Texts without rare characters, which take the chunk path: line ends, marks, digits, capitals, accents."""
    import public_tokenizers

    rng = random.Random(2)
    parts = ["the", "Word", "ÉTÉ", "ßig", "naïve", "ªb", "a", "x9", "12", "3_4", ".", ",", "...", "'s", "don't", "(", ")",
             "\"", "-", "\n", "\n", " ", " ", " ", " ", "\t", "\r\n", "ƒx", "Ǆa", "ªº"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["end.\nStart", "a\nb", "a\n\nb", "a \nb", "a\n b", "a,\nB", "a\n", "\na", "a.\n\"B", "x\n'"]
    for cap in (3, 100_000):
        enc = ChunkEncoder(public_tokenizers.path(name), cap=cap)
        for t in texts:
            assert enc.encode(t) == np.array(enc.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_ids_round_trip(docs):
    import public_tokenizers

    lib = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")).lib
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(map(tuple, rans.op7_query(docs).collect()), key=lambda g: g[1])
    key = lambda rows: Counter((g[0], g[2], g[3]) for g in rows)  # noqa: E731  null ids have no order among them
    assert key(got) == key(want)
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 16_384, 65_536, 65_537, 300_001])
def test_rans_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 5000).astype(np.uint32)
    t = rans.Table(rans.scaled(np.bincount(ids)))
    blocks = list(rans.encode_blocks(ids, t))
    assert np.array_equal(np.concatenate(rans.decode_blocks(blocks, t)), ids)
    assert np.array_equal(rans.decode_blocks(blocks[-1:], t)[0], ids[-(n % rans.BLOCK or rans.BLOCK):])
    broken = [(b[0], b[1], b[2], b[3] ^ 1) for b in blocks[:1]]
    with pytest.raises(ValueError):
        rans.decode_blocks(broken, t)


def test_rans_single_symbol():
    ids = np.full(1000, 7, np.uint32)
    t = rans.Table(rans.scaled(np.bincount(ids)))
    assert np.array_equal(rans.decode_blocks(list(rans.encode_blocks(ids, t)), t)[0], ids)


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs):
    import public_tokenizers

    lib = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")).lib
    got = packing.op8_query(docs).collect()
    want = Counter()
    total = 0
    for r in docs.collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at:at + 2048]
            want[(r.doc_id, k, at, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    assert check_packing(got, 2048) <= -(-total // 2048) * 1.05 + 1


def test_packing_in_many_rounds(spark):
    rng = random.Random(5)
    rows = [(k, 0, 0, rng.choice([3, 17, 40, 55, 60, 99, 100]), k) for k in range(3000)]
    pieces = spark.createDataFrame(rows, packing.PIECE).repartition(16)
    got = packing.pack(pieces, capacity=100, items_per_task=300).collect()
    assert len(got) == 3000 and len({g.doc_id for g in got}) == 3000
    fit = len(packing.best_fit(sorted((r[3] for r in rows), reverse=True), 100))
    assert check_packing(got, 100) <= 1.03 * fit


# ---- 9: mixing


def test_mixing_by_brute_force(odd_docs):
    plan = mixing.production_plan()
    got = mixing.mix(odd_docs, plan)
    assert got.columns == [*odd_docs.columns, "mix"]
    rows = got.select("doc_id", "mix.*").collect()
    leaves = defaultdict(int)
    for r in odd_docs.collect():
        domain = "web" if r.source and len(r.source) == 4 else "curated"
        leaves[(domain, r.lang or "", r.source or "")] += len(words(r.text))
    total = sum(leaves.values())
    taken = sum(r.take_tokens for r in rows)
    assert taken <= total * 800 // 1000 and taken >= total * 800 // 1000 - len(leaves)
    assert all(0 <= r.take_tokens <= r.n_tokens and r.epoch < 3 for r in rows)


@pytest.mark.parametrize("share", [100, 1500, 9000])
def test_allocation_redistributes_to_siblings_first(spark, share):
    from pyspark.sql import functions as F

    data = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 5), ("b", "y", 5), ("c", "z", 2000)]
    leaves = spark.createDataFrame(data, "domain string, lang string, tokens long")
    plan = mixing.Plan([mixing.Level("domain", F.col("domain"), {"a": 1, "b": 2, "c": 1}),
                        mixing.Level("lang", F.col("lang"))], share, max_epochs=2)
    got = {(r.domain, r.lang): r.quota for r in mixing.allocate(leaves, plan).collect()}

    def fill(budget, kids):  # [(name, weight, cap)]
        out, live = {}, list(kids)
        while live:
            w = sum(k[1] for k in live)
            full = [k for k in live if k[2] * w <= budget * k[1]]
            if not full:
                return out | {k[0]: budget * k[1] // w for k in live}
            for k in full:
                out[k[0]] = k[2]
                budget -= k[2]
                live.remove(k)
        return out

    tops = defaultdict(list)
    for d, lang, t in data:
        tops[d].append((lang, 1, 2 * t))
    of = fill(3020 * share // 1000, [(d, {"a": 1, "b": 2, "c": 1}[d], sum(k[2] for k in v)) for d, v in tops.items()])
    assert got == {(d, k): q for d, v in tops.items() for k, q in fill(of[d], v).items()}


# ---- all: empty tables


def test_empty_tables(spark, sf, empty_docs):
    labels = table(spark, sf, "labels")
    assert quality_rules.op2_query(empty_docs, labels.limit(0)).count() == 0
    assert jaccard_join.op3_query(empty_docs).count() == 0
    assert gru_lm.op5_query(empty_docs).count() == 0
    assert rans.op7_query(empty_docs).count() == 0
    assert packing.op8_query(empty_docs).count() == 0
    assert mixing.op9_query(empty_docs).count() == 0
    assert suffix_index.op10_query(empty_docs).count() == 0
