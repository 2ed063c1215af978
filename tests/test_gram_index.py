"""The keyword index gives the scan's rows for any keyword, and reads a part of the files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.operators import filters as FL
from hirelens.session import scratch_path
from hirelens.sources import gram_index as G

COLS = "jobNo string, jobName string, jobDetail string, custName string, search_keyword array<string>"
ROWS = [("1", "Data Engineer", "Spark, SQL", "ACME", ["Python", "SRE"]), ("2", "資料工程師", None, "台積電", ["python"]), ("3", None, "x", "y", []),
        ("4", "ab", "", None, None), (None, "a", "b", "c", ["K8S", None, "go"]), ("6", "aaa", "aaaa", "𝄞clef", ["aaaa"]), ("6", "aaa", "aaaa", "𝄞clef", ["aaaa"])]
KEYWORDS = [["python"], ["PYTHON", "sre"], ["n s"], ["資料"], ["台"], ["程師"], ["a"], ["aa"], ["aaaaa"], ["aaa a"], ["b"], ["8s"], ["s go"], ["𝄞c"], ["zzz"], ["x y"],
            ["."], ["%"], [""], [], ["data engineer spark, sql acme"], ["\u0000"], ["e\u0000"], ["k"], ["go"], ["engineer", "zzz"]]


@pytest.fixture(scope="module")
def stored(spark):
    base, jobs = scratch_path(spark, "grams"), spark.createDataFrame(ROWS, COLS)
    G.write_indexed(jobs, base, parts=5, index_tasks=3)
    return base, jobs


@pytest.mark.parametrize("keywords", KEYWORDS, ids=[repr(k) for k in KEYWORDS])
def test_same_rows_as_the_scan(spark, stored, keywords):
    base, jobs = stored
    for field, scan in (("keywords", FL.keyword_filter), ("text", FL.keyword_filter_text)):
        got = sorted(map(str, G.find_containing(spark, base, jobs, keywords, field).collect()))
        assert got == sorted(map(str, scan(jobs, keywords).collect())), field


def scanned(df):
    """(files, bytes) that each Parquet scan of an executed frame read."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            metrics = node.metrics()
            found.append((metrics.apply("numFiles").value(), metrics.apply("filesSize").value()))
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
    walk(plan)
    return found


def test_far_fewer_bytes_are_read(spark):
    sf = "/root/testdata/sf0.01"
    base, jobs = scratch_path(spark, "grams"), X.jobs_df(spark, sf)
    G.write_indexed(jobs, base, parts=64, index_tasks=64)
    keyword = [jobs.where(F.col("jobNo") == "4242").first().custName, "role-2"]
    found = G.find_containing(spark, base, jobs, keyword, "text")
    assert 0 < found.count() < 10
    assert found.count() == FL.keyword_filter_text(jobs, keyword).count()
    whole = sum(b for _, b in scanned(G._rows(spark, base, jobs).drop("_row")))
    read = sum(b for _, b in scanned(G.find_containing(spark, base, jobs, keyword, "text").drop("search_keyword")) if b)
    rows_read = min(b for _, b in scanned(found))
    assert rows_read < 0.2 * whole and read > 0
    plan = G.candidates(spark.read.parquet(f"{base}/grams"), "text", ["customer#000000042"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(field,text)" in plan and "In(gram" in plan or "EqualTo(gram" in plan


def test_empty(spark, stored):
    base, jobs = scratch_path(spark, "grams"), stored[1].limit(0)
    G.write_indexed(jobs, base, parts=4)
    assert G.find_containing(spark, base, jobs, ["a"]).count() == 0 and G.find_containing(spark, base, jobs, []).count() == 0


@pytest.fixture(scope="module")
def blocks(spark):
    """Postings of two tasks, each of more than one block, indexed as the queries do."""
    jobs = spark.range(0, 70_000, numPartitions=2).select(
        F.col("id").cast("string").alias("jobNo"), F.concat(F.lit("Role-"), (F.col("id") % 40).cast("string")).alias("jobName"),
        F.when(F.col("id") % 3 > 0, F.lit("x")).alias("jobDetail"), F.concat(F.lit("C#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("custName"),
        F.when(F.col("id") % 7 > 0, F.array(F.lit("Python"), F.when(F.col("id") % 5 > 0, F.lit("Go")))).alias("search_keyword"))
    base = scratch_path(spark, "blocks")
    G.write_indexed(jobs, base)
    return base, jobs


@pytest.mark.parametrize("keywords", [["#000034567"], ["role-1 x", "69"], ["-7"], ["n go"], ["role-4 "], ["e-39", "39999"], ["zz"]], ids=str)
def test_same_rows_in_many_blocks(spark, blocks, keywords):
    base, jobs = blocks
    for field, scan in (("keywords", FL.keyword_filter), ("text", FL.keyword_filter_text)):
        got = sorted(r.jobNo for r in G.find_containing(spark, base, jobs, keywords, field).select("jobNo").collect())
        assert got == sorted(r.jobNo for r in scan(jobs, keywords).select("jobNo").collect()), field


def test_postings_and_lists_stay_with_their_task(spark, blocks):
    base, jobs = blocks
    stored = G._rows(spark, base, jobs).select(F.shiftright("_row", 15).alias("block"), F.input_file_name().alias("file"))
    lists = spark.read.parquet(f"{base}/grams").select("block", F.input_file_name().alias("file"))
    for rows in (stored, lists):
        files = [r.files for r in rows.groupBy("block").agg(F.countDistinct("file").alias("files")).collect()]
        assert files == [1] * 4


def test_candidates_are_masks(spark, blocks):
    grams = spark.read.parquet(f"{blocks[0]}/grams")
    found = G.candidates(grams, "text", ["role-"])
    assert found.count() <= 70_000 // 64 + 4
    assert found.agg(F.sum(F.bit_count("mask"))).first()[0] == 70_000


def test_texts_of_very_many_characters():
    known = [c for c in range(0x20, 0x40000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, known[k::3000])) for k in range(3000)] + [None, "", "a", "aaaa"]
    places = np.arange(len(texts), dtype=np.int16)[::-1]
    want = {(t + G.PAD * 2)[k:k + 3] for t in texts if t for k in range(len(t))}
    got = {}
    for names, ends, lists in G._gram_lists(texts, places):
        for name, own in zip(names, np.split(lists, ends[:-1]), strict=True):
            got.setdefault(name, []).extend(own.tolist())
    assert set(got) == want
    assert got["aaa"] == [0] and sorted(got["aa" + G.PAD]) == [0] and sorted(got["a" + G.PAD * 2]) == [0, 1]


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(G, "CHARACTERS", 10, raising=False)
    parts = list(G._gram_lists(["abcdefgh", "abcd", None, "abc"], np.array([5, 6, 7, 8], np.int16)))
    assert len(parts) > 1
    assert sorted(p for names, ends, lists in parts for n, own in zip(names, np.split(lists, ends[:-1]), strict=True) if n == "abc" for p in own) == [5, 6, 8]
