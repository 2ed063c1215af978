"""What a crawl day keeps on disk: shuffles go with the write that made them, files of a day once they are read."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from hirelens import fixtures as X
from hirelens.operators import ingest as I
from hirelens.plans import q_day_state, q_ingest
from hirelens.plans.pipeline import run_crawl_day
from hirelens.session import scratch_path, shuffles_released
from hirelens.streaming import ingest_stream as ST

DAY = dt.date(2001, 8, 2)


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


def test_a_crawl_day_leaves_no_shuffle(spark, sf):
    """F4 to F9."""
    path, snapshots, days = (scratch_path(spark, n) for n in ("responses", "snapshots", "days"))
    before = shuffle_files(spark)
    with shuffles_released(spark):
        X.responses_df(spark, sf).write.json(path)
    for k in range(2):
        run_crawl_day(spark, path, snapshots, DAY + dt.timedelta(days=k), days_base=days)
    ST.close_crawl_day(spark, snapshots, DAY + dt.timedelta(days=2), days_base=days)
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize(("module", "query", "files"), [
    (q_day_state, q_day_state.q_day_state_daily, 3), (q_day_state, q_day_state.q_day_state_kpis, 3), (q_ingest, q_ingest.q_open_fields_snapshot, 2),
    (q_ingest, q_ingest.q_closed_day_snapshot, 2), (q_ingest, q_ingest.q_crawl_day_snapshot, 1)])
def test_a_days_files_go_when_they_are_read(spark, sf, monkeypatch, module, query, files):
    """F4 to F9; the lists of keywords, which a batch stores before its merge, go too."""
    made = []

    def noted(session, name):
        made.append((name, scratch_path(session, name).removeprefix("file:")))
        return made[-1][1]

    monkeypatch.setattr(module, "scratch_path", noted)
    monkeypatch.setattr(ST, "scratch_path", noted)
    rows = query(spark, sf)
    assert [n for n, _ in made].count("responses") == files == [n for n, _ in made].count("keyword-lists")
    assert {n for n, p in made if os.path.exists(p)} <= {"snapshots", "days"}
    assert rows.count() > 0


def test_stored_keyword_lists_give_the_same_batch(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(
        f'{{"keyword":{k},"page_key":{p},"page_block":0,"result":{{"data":{{"list":[{{"jobNo":"1","jobName":"n{p}"}},{{"jobNo":"{p}"}},{{"jobNo":""}},{{}}]}}}}}}\n'
        for p, k in enumerate(['"b"', '"a"', "null", '"b"', '""', '"c"'])))
    pages = spark.read.schema(I.OPEN_RESPONSE_TYPE).json(str(tmp_path))
    found = I.batch_keywords(pages)
    assert {r.jobNo: r._kws for r in found.collect()} == {"0": ["b"], "1": ["b", "a", "c"], "3": ["b"], "5": ["c"]}
    stored = scratch_path(spark, "lists")
    found.write.parquet(stored)
    a, b = (I.prepare_batch(pages, DAY, found=f).withColumn("doc", F.to_json("doc")) for f in (None, spark.read.parquet(stored)))
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
