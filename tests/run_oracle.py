"""CLI: run registered queries and compare with their SQL twins.

    python tests/run_oracle.py [sf_dir] [name ...]
"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from hirelens import get_session  # noqa: E402
from hirelens.plans.catalog import oracle_sql, queries  # noqa: E402


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = get_session("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    qs, sql = queries(), oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sql:
                ok, msg = oracle.compare(df, sql[name], sf)
            else:
                n = df.count()
                ok, msg = True, f"{n} rows (no SQL twin)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:32s} {time.time()-t:6.1f}s  {msg}", flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
