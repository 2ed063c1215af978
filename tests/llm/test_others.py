"""URL templates, neighbours, archives, catalogue and pipeline."""

import random
import re

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hirelens.llm import catalog, nn_descent, url_templates, warc
from hirelens.llm.common import table
from hirelens.session import scratch_path

URLS = [None, "", "no scheme/x", "http://", "HTTP://A.Org", "http://Example.ORG/es/1", "http://x.example.org/en/12?q#f",
        "http://notexample.org/es/", "https://a.com/fr/", "https://a.com/fr", "https://com/de/x/", "ftp://u@h:80?x=/a",
        "a://b://c/d", "http://h/" + "/".join(f"s{k}" for k in range(40)), "http://org", "http://org/", "http://ÀB.ORG/x",
        "http://q.org\n/x"]


def url_brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({k: k + 32 for k in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for rule, verdict in url_templates.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            best = max(best or ("", ""), (rule, verdict), key=lambda x: len(x[0]))
    return host, path, *(best or (None, None))


def test_url_rules(spark, sf):
    pages = [(r.page_id, r.url) for r in table(spark, sf, "pages").collect()]
    rows = pages + [(10_000 + k, u) for k, u in enumerate(URLS)] + [(None, "http://h/1"), (5, "http://org/")]
    data = spark.createDataFrame([(*r, "x", True) for r in rows], "page_id long, url string, template string, lab boolean")
    got = url_templates.op1_query(data, table(spark, sf, "labels")).collect()
    assert len(got) == len(rows)
    by = {(g.page_id, g.path): g for g in got}
    for page, url in rows:
        host, path, rule, verdict = url_brute(url)
        g = by[page, path]
        assert (g.host, g.rule) == (host, rule) and g.verdict in ("allow", "block")
        assert verdict is None or g.verdict == verdict
    assert url_templates.op1_query(data.limit(0), table(spark, sf, "labels").limit(0)).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rows = [(f"http://h.net/user/u{k}name{'x' * k}/post", True) for k in range(60)]
    rows += [(f"http://h.net/spam/a{k % 3}", False) for k in range(30)] + [(f"http://h.net/{w}/p", True) for w in
                                                                           ("de", "fr") for _ in range(40)]
    pages = spark.createDataFrame([(k, u, g) for k, (u, g) in enumerate(rows)], "page_id long, url string, good boolean")
    got = url_templates.judge_urls(pages, rules=()).collect()
    assert all((g.verdict == "block") == g.path.startswith("/spam") for g in got)
    of = {g.path: g.template for g in got}
    assert of["/spam/a1"].startswith("/spam/")
    assert len({t for p, t in of.items() if p.startswith("/user")}) <= 2
    assert of["/de/p"] == of["/fr/p"]  # alike branches merge


@pytest.mark.parametrize("sections", [31, 32, 60])
def test_bad_sections_are_rejected_at_any_fan_out(spark, sections):
    names = [f"sec{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(sections)]
    rows = [(f"http://h.net/{w}/p", True) for w in names for _ in range(40)]
    rows += [("http://h.net/bad/p", False)] * 60 + [("http://h.net/worse/p", False)] * 6
    rows += [(f"http://h.net/none{chr(97 + k)}/p", None) for k in range(5)]
    pages = spark.createDataFrame([(k, u, g) for k, (u, g) in enumerate(rows)], "page_id long, url string, good boolean")
    got = url_templates.judge_urls(pages, rules=()).collect()
    assert all((g.verdict == "block") == (g.path in ("/bad/p", "/worse/p")) for g in got)


def test_variable_segments_stay_wild(spark):
    rng = random.Random(4)
    rows = [(f"http://h.net/user/{rng.choice('ghijk')}{''.join(rng.choices('ghijklmnop', k=6))}", rng.random() < 0.9)
            for _ in range(3000)]
    pages = spark.createDataFrame([(k, u, g) for k, (u, g) in enumerate(rows)], "page_id long, url string, good boolean")
    got = url_templates.judge_urls(pages, rules=()).collect()
    assert len({g.template for g in got}) <= 3


def _templates_of(spark, sections):
    """{section: template} of one host; ``sections``: name -> (good, bad, unlabelled) pages."""
    rows = [(f"http://h.net/{w}/p", g) for w, n in sections.items() for g, k in zip((True, False, None), n, strict=True)
            for _ in range(k)]
    pages = spark.createDataFrame([(k, u, g) for k, (u, g) in enumerate(rows)], "page_id long, url string, good boolean")
    return {g.path[1:-2]: g.template for g in url_templates.judge_urls(pages, rules=()).collect()}


def test_unlabelled_siblings_bridge_nothing(spark):
    got = _templates_of(spark, {"bad": (0, 5, 0), "bare": (0, 0, 5), "fine": (5, 0, 0)})
    assert len(set(got.values())) == 3
    got = _templates_of(spark, {"a": (5, 0, 0), "b": (5, 0, 0), "bare": (0, 0, 5)})
    assert set(got.values()) == {"/*/p"}  # all with labels are alike


@pytest.mark.parametrize("sections, labels", [(32, 100), (16, 50)])
def test_evenly_spread_sections_make_no_chain(spark, sections, labels):
    good = [round(k * labels / (sections - 1)) for k in range(sections)]
    got = _templates_of(spark, {f"s{chr(97 + k // 26)}{chr(97 + k % 26)}": (g, labels - g, 0) for k, g in enumerate(good)})
    groups = {}
    for k, name in enumerate(sorted(got)):
        groups.setdefault(got[name], []).append(good[k])
    assert 3 <= len(groups) < sections
    assert all(not url_templates._apart((labels, min(g)), (labels, max(g)), 1.96) for g in groups.values())


def test_template_depth_is_bounded(spark):
    path = F.lit("/" + "/".join(f"s{k}" for k in range(40)))
    assert spark.range(1).select(url_templates.shapes(path, 8).alias("s")).first().s == ["s<n>"] * 8 + ["**"]


def neighbours_brute(rows, top=10):
    valid = {}
    for i, v in rows:
        a = None if i is None or not v or None in v else np.array(v, float)
        if a is not None and np.isfinite(a).all() and a.any():
            valid.setdefault(i, a)
    ids = sorted(valid)
    m = np.array([valid[i] for i in ids])
    out = {}
    for q in (i for i in ids if i % 100 == 0):
        d = np.sqrt(((m - valid[q]) ** 2).sum(1))
        order = [(d[k], ids[k]) for k in range(len(ids)) if ids[k] != q]
        out[q] = sorted(order)[:top]
    return out


def test_neighbours_recall_and_scores(spark):
    data = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = neighbours_brute([(r.vec_id, list(r.embedding)) for r in data.collect()])
    got = nn_descent.op4_query(data).collect()
    hits = sum((g.vec_id in {i for _, i in want[g.query_id]}) for g in got)
    assert len(got) == 10 * len(want) and hits >= 0.9 * len(got)
    score = {(q, i): d for q, all_ in want.items() for d, i in all_}
    assert all(abs(score.get((g.query_id, g.vec_id), g.score) - g.score) < 1e-12 for g in got)


def test_neighbours_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(1, 40)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in (100, 101, 102, 200, 201)]  # copies, ties
    rows += [(300, None), (400, [0.0] * 4), (500, [1.0, None, 0.0, 1.0]), (600, [float("nan"), 1.0, 1.0, 1.0]),
             (700, [float("inf"), 1.0, 1.0, 1.0]), (800, []), (900, [1.0, 2.0]), (None, [1.0] * 4), (101, [1.0, 2.0, 3.0, 4.0])]
    data = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, label int, u string")
    got = nn_descent.op4_query(data).collect()
    want = neighbours_brute([r for r in rows if r[0] != 900])
    assert {(g.query_id, g.rank): g.vec_id for g in got} == {(q, k + 1): i for q, all_ in want.items()
                                                            for k, (_, i) in enumerate(all_)}
    few = data.where("vec_id in (100, 1, 2)")
    assert nn_descent.op4_query(few).count() == 2
    assert nn_descent.op4_query(data.limit(0)).count() == 0


def _recall(spark, vectors):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    got = nn_descent.op4_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = neighbours_brute(rows)
    assert len(got) == 10 * len(want) and all(np.isfinite(g.score) for g in got)
    return sum(g.vec_id in {i for _, i in want[g.query_id]} for g in got) / len(got)


def test_neighbours_in_groups_of_near_copies(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(2, 64))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    vectors = np.repeat(centre, 1000, 0) + 3e-5 * rng.normal(size=(2000, 64))
    assert _recall(spark, vectors) >= 0.9
    assert _recall(spark, vectors.astype(np.float32)) >= 0.9


def test_neighbours_of_large_and_small_components(spark):
    rng = np.random.default_rng(6)
    scale = np.repeat([1e6, 1.0, 1e-9, 1e100], 200)
    assert _recall(spark, rng.normal(size=(800, 8)) * scale[:, None]) >= 0.9


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + "same " * 40
    rows = [(1, "http://a/", None), (2, None, ""), (3, "u", "short"), (4, "u", "short"), (7, "u\r\nX: y", body),
            (5, "u", body), (6, "u", body), (6, "u", body + "é"), (8, "ü", "é" * 70_000), (9, "u", "\x1f\x8b\x08 WARC/1.0"),
            (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "x" * 100), (13, "u", "x" * 100)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("split", [61, 1000, 10**7])
def test_archives_by_any_split(spark, pages, split):
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages.repartition(2), folder)
    for files in (manifest.select("path", "bytes"), warc.archive_files(spark, folder)):
        got = warc.read_archives(files, split).collect()
        assert sorted(int(g.headers["x-page-id"]) for g in got) == sorted(r.page_id for r in pages.collect())
        body = {int(g.headers["x-page-id"]): bytes(g.payload) for g in got if g.headers["warc-type"] == "response"}
        assert body[8] == ("é" * 70_000).encode() and body[1] == b"" and body[5].startswith(b"<p>same")


def test_archive_records(spark, pages):
    got = {(g.page_id, g.payload_bytes): g for g in warc.op6_query(pages).collect()}
    assert len(got) == pages.count()
    of = {k[0]: (g.record_type, g.refers_to) for k, g in got.items()}
    assert (of[5], of[7], of[11], of[12], of[13]) == (("response", None), ("revisit", 5), ("response", None),
                                                      ("response", None), ("revisit", 12))
    assert got[7, 203].payload_digest == got[5, 203].payload_digest
    assert warc.op6_query(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_twins(spark, sf, name):
    ok, message = oracle.compare(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)
    assert ok, message


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 14))


def test_pipeline(spark, sf, odd_docs):
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        path = scratch_path(spark, name)
        out.write.parquet(path)
        assert spark.read.parquet(path).count() > 0
        docs = spark.read.parquet(path)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {
        r.doc_id for r in docs.select("doc_id").distinct().collect()}
    path = scratch_path(spark, "odd")
    odd_docs.write.parquet(path)
    docs = spark.read.parquet(path)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        path = scratch_path(spark, "odd")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)


def test_pipeline_batches_are_set_where_the_session_has_defaults(spark):
    import corpus_pipeline

    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = {n: spark.conf.get(n, str(d)) for n, (d, _) in corpus_pipeline.BATCHES.items()}
    try:
        for n, (default, _) in corpus_pipeline.BATCHES.items():
            spark.conf.set(n, str(default))
        spark.conf.set(name, "777")
        corpus_pipeline._small_batches(spark)
        found = {n: int(spark.conf.get(n)) for n in corpus_pipeline.BATCHES}
        assert found == {n: rows for n, (_, rows) in corpus_pipeline.BATCHES.items()} | {name: 777}
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
