"""The streamed crawl log: any order and repetition of files gives the batch result; late pages stay pending."""

import datetime as dt
import itertools
import json
import os
import random

import pytest

from hirelens.operators.ingest import frontier_pending
from hirelens.session import scratch_path
from hirelens.streaming import crawl_log_stream as CL


def page(url, at, total=None, error=None, day="2001-08-02", keyword="k"):
    result = {"error": error} if error else {"data": {"totalPage": 1, "totalCount": total, "list": [{"jobNo": "1", "any": {"x": 1}}]}}
    return {"today": day, "url": url, "first_url": "f", "crawl_url": url, "keyword": keyword, "page_key": 1, "page_block": 0,
            "fetched_at": at, "status": "ok", "result": result}


T = "2001-08-02T{:02d}:00:00".format
FILES = [[page("a", T(8), error="down"), page("b", T(8), 5)], [page("a", T(9), 7), page("b", T(8), 5), page("c", T(9), 1, keyword=None)],
         [page("b", T(10), error="gone"), page("a", T(9), 9)], [page("d", T(7), 2, day="2001-08-01"), page("c", None, 3, keyword=None)]]
EXPECTED = {("2001-08-02", "k", "a"): ("ok", 9), ("2001-08-02", "k", "b"): ("error", None), ("2001-08-02", None, "c"): ("ok", 1),
            ("2001-08-01", "k", "d"): ("ok", 2)}


def deliver(folder, name, pages):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.json"
    with open(path + "_", "w") as f:
        f.writelines(json.dumps(p) + "\n" for p in pages)
    at = 1_000_000_000 + 1000 * int(name)
    os.utime(path + "_", (at, at))  # files are taken in the order of their times
    os.rename(path + "_", path)


def run(spark, folder, log, checkpoint, **options):
    CL.start_crawl_log_stream(spark, folder, log, checkpoint, **options).awaitTermination()
    return {(r.today, r.keyword, r.crawl_url): (r.status, r.total_count) for r in CL.read_log(spark, log).collect()}


@pytest.mark.parametrize("order", [list(o) for o in random.Random(2).sample(list(itertools.permutations(range(4))), 3)] + [[0, 1, 0, 2, 3, 1, 2]])
def test_any_order_gives_the_batch_result(spark, tmp_path, order):
    for k, f in enumerate(order):
        deliver(f"{tmp_path}/landing", k, FILES[f])
    log = scratch_path(spark, "log")
    assert run(spark, f"{tmp_path}/landing", log, scratch_path(spark, "stream"), max_files_per_trigger=1, delay="3 days") == EXPECTED
    batch = CL.last_fetches(CL.log_rows(spark.read.schema(CL.PAGE_TYPE).json(f"{tmp_path}/landing")))
    assert sorted(map(str, batch.collect())) == sorted(map(str, CL.read_log(spark, log).select(*batch.columns).collect()))


def test_late_pages_are_not_logged_and_stay_pending(spark, tmp_path):
    folder, log = f"{tmp_path}/landing", scratch_path(spark, "log")
    deliver(folder, 0, [page("a", T(12), 1)])
    deliver(folder, 1, [page("b", T(12), 1)])
    deliver(folder, 2, [page("late", T(9), 1), page("in time", T(11), 1)])
    got = run(spark, folder, log, scratch_path(spark, "stream"), max_files_per_trigger=1, delay="2 hours")
    assert {k[2] for k in got} == {"a", "b", "in time"}
    plan = spark.createDataFrame([(u, "f") for u in ("a", "late", "in time")], "crawl_url string, first_url string")
    assert [r.crawl_url for r in frontier_pending(plan, CL.read_log(spark, log), dt.date(2001, 8, 2)).collect()] == ["late"]


def test_a_restarted_stream_goes_on(spark, tmp_path):
    folder, log, checkpoint = f"{tmp_path}/landing", scratch_path(spark, "log"), scratch_path(spark, "stream")
    for k, f in enumerate(FILES):
        deliver(folder, k, f)
        got = run(spark, folder, log, checkpoint, delay="3 days")
    assert got == EXPECTED
    deliver(folder, 9, FILES[0])  # a repeated delivery changes nothing
    assert run(spark, folder, log, checkpoint, delay="3 days") == EXPECTED
    # the same files through a new checkpoint neither
    assert run(spark, folder, log, scratch_path(spark, "stream"), delay="3 days") == EXPECTED


def test_empty(spark, tmp_path):
    deliver(f"{tmp_path}/landing", 0, [])
    deliver(f"{tmp_path}/landing", 1, [page("a", None, 1, day=None)])
    log = scratch_path(spark, "log")
    assert run(spark, f"{tmp_path}/landing", log, scratch_path(spark, "stream")) == {}
