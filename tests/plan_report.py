"""Write PLANS.md: the executed (AQE final) physical plan shape of every registered query.

    python tests/plan_report.py [sf_dir]
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hirelens import get_session  # noqa: E402
from hirelens.plans.catalog import queries  # noqa: E402

PATTERNS = {
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
    "reused": r"ReusedExchange",
    "broadcasts": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "hash_agg": r"\bHashAggregate",
    "sort_agg": r"SortAggregate",
    "obj_agg": r"ObjectHashAggregate",
    "windows": r"\bWindow \[",
    "scans": r"FileScan parquet",
    "python": r"BatchEvalPython|ArrowEvalPython|ExistingRDD",
    "cartesian": r"CartesianProduct|BroadcastNestedLoopJoin",
}


def final_plan(plan: str) -> str:
    """The plan without its initial versions (of the query and of its subqueries)."""
    kept, skip = [], None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and at >= skip:
            continue
        skip = at if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


def main(sf):
    spark = get_session("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    rows = []
    for name, fn in sorted(queries().items()):
        df = fn(spark, sf)
        df.collect()
        plan = final_plan(df._jdf.queryExecution().executedPlan().toString())
        counts = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        pushed = len(re.findall(r"PushedFilters: \[[^\]]+\]", plan))
        rows.append((name, counts, pushed))
        print(name, counts, flush=True)
    head = ["query"] + list(PATTERNS) + ["scans w/ pushed filters"]
    out = ["# PLANS — executed physical plans (AQE final) at " + sf, "",
           "Generated by `tests/plan_report.py`. Counts are plan nodes, including scalar-subquery plans;",
           "`shuffles` counts hash / range / single-partition exchanges, `reused` exchanges reused from another branch.", "",
           "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for name, c, pushed in rows:
        out.append("| " + " | ".join([name] + [str(c[k]) for k in PATTERNS] + [str(pushed)]) + " |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
