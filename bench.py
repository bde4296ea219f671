"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Every query runs once to warm up and then BENCH_REPEATS times (default 3) with a
``noop`` write, which computes every row and column; its median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from workload import load
from workload.session import local_session

HEADLINE = (
    # ingest and nesting
    "build_master", "nest_children", "wide_extract",
    # search
    "search_terms", "compare_families", "search_rollup_entity", "search_occurrences", "search_statistics",
    # profiling
    "profile_numeric", "profile_categorical", "key_coverage", "audit_conversion",
    # description
    "group_distribution", "child_density", "related_distribution", "correlation_matrix",
    "recipient_diversity", "complexity_tiers", "cohort_profile",
    # amounts
    "amount_stats", "top_percent_list", "group_amount_stats", "top_list_report",
    # names
    "reconcile_names",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    queries, _ = load()
    times = {}
    for name in wanted:
        runs = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    conf = spark.conf
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("/", 1)[-1].removeprefix("sf"),
                "cpus": cpus,
                "driver_memory": conf.get("spark.driver.memory"),
                "shuffle_partitions": conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
