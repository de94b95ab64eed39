"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is executed fully with the ``noop`` sink (no collect), from a cold
pipeline cache, so every timing includes reading the parquet tables. One
untimed warm-up query loads the JVM classes first; ``BENCH_REPEATS=n`` reports
the median of n runs per query (default 1).
"""

from __future__ import annotations

import json
import os
import statistics
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "churn_input",            # fixture: orders pre-aggregated per customer + join
    "core_processed",         # E1 end to end (heuristic scorer)
    "core_segment_summary",   # A1 on top of E1
    "core_kpis",              # A3/A4
    "core_top_risk",          # T1
    "core_synthetic_labels",  # D8 synthetic label path
    "lineitem_pct_rank",      # W1 distributed ranks over all lineitem rows
    "dirty_numbers",          # P6/P7 text parsing
    "adaptive_processed",     # E3 end to end
    "adaptive_kpis",          # A5
    "adaptive_clv_dist",      # A9 quintiles
    "v2_kpis",                # release 2.0
    "events_adaptive",        # adaptive lineage on event counts
    "isolation_outliers",     # M11
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidemark.plans import queries as Q
    from tidemark.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "1")))
    Q.REGISTRY["dirty_numbers"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        fn = Q.REGISTRY[name][0]
        runs = []
        for _ in range(repeats):
            Q._core_cache.clear()
            Q._adaptive_cache.clear()
            Q._v2_cache.clear()
            Q._events_cache.clear()
            spark.catalog.clearCache()
            t0 = time.time()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
