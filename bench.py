"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the cores, BENCH_QUERIES a comma-separated
choice. Each query runs once unmeasured (code generation, file listing) and then
BENCH_REPEAT times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "customer_pg_12m", "customer_vector", "class_pg_penetration", "lookalikes", "lookalikes_all", "lookalike_gap",
    "category_gaps", "class_gap", "stale_quotes", "going_quiet", "reorder_due", "new_accounts", "week_list",
    "find_customer", "customers_near", "customer_snapshot", "recent_activity", "open_quotes", "cancelled_quotes",
    "task_view", "resolve_requests", "statement_check",
]


def main() -> None:
    from bookwise.plans.queries import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry(), {}
    for name in chosen:
        times = []
        for _ in range(repeat + 1):
            start = time.perf_counter()
            # every column of every row is computed, nothing reaches the driver
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
