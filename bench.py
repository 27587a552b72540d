"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (the full plan runs,
nothing is collected to the driver). One warm-up pass over all queries, then the
median of $BENCH_RUNS timed runs per query. Prints ONE JSON line:

    {"metric": "total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from touchpoint.session import get_session
    from touchpoint.plans.catalog import HEADLINE, QUERIES
    from touchpoint.sources.fixtures import forget_plans

    spark = get_session(
        f"local[{cpus}]",
        app_name="touchpoint-bench",
        shuffle_partitions=cpus,
        conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")},
    )
    names = only or list(QUERIES)

    def run(name: str) -> float:
        forget_plans()  # each run lists its files and builds its plan
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    failed: dict[str, str] = {}
    for n in names:  # warm-up: JIT, codegen caches, file listing
        try:
            run(n)
        except Exception as exc:  # noqa: BLE001 - reported, not hidden
            failed[n] = f"{type(exc).__name__}: {str(exc)[:200]}"
    ok = [n for n in names if n not in failed]
    times = {n: round(statistics.median(run(n) for _ in range(runs)), 3) for n in ok}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "failed": failed,
        "headline_sec": round(sum(times[n] for n in HEADLINE if n in times), 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
