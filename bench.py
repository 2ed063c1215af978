"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Production shape: the daily job derives and publishes the posting tables
once (timed as ``publish_fixtures`` and included in the total), then every
report query reads the published tables.  ``BENCH_DERIVE=1`` instead
re-derives the tables from the driver tables inside every query.
Each query is forced end to end with the ``noop`` sink (full computation,
no driver collect).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hirelens import fixtures  # noqa: E402
from hirelens import get_session  # noqa: E402
from hirelens.plans.catalog import queries  # noqa: E402
from hirelens.session import scratch_path  # noqa: E402

HEADLINE = [
    "daily_job_changes", "trend_stats", "day_over_day_diff", "calendar_month", "delisted_kpis",
    "delisted_duration_buckets", "industry_share", "industry_growth", "top5_industry_trend",
    "city_salary_top10", "district_salary_top10", "applicant_kpis", "salary_range", "analysis_projection",
    "keyword_filter", "merged_keywords", "explode_responses", "lifecycle_sync", "crawl_frontier",
    "code_tree_flat", "recent_50",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or (HEADLINE if os.environ.get("BENCH_ALL") != "1" else None)
    spark = get_session(f"local[{cpus}]", int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
                        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    qs = queries()
    names = names or sorted(qs)
    # warm-up: JVM, parquet footers
    qs["series_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    if os.environ.get("BENCH_DERIVE") != "1":
        t = time.time()
        fixtures.publish_fixtures(spark, sf_dir, scratch_path(spark, "bench-fixtures"))
        times["publish_fixtures"] = round(time.time() - t, 3)
    for n in names:
        t = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))


if __name__ == "__main__":
    main()
