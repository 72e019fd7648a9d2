"""Time the headline queries and print one JSON line.

Each query is built and written whole to the ``noop`` sink: one warm-up, then
the median of ``BENCH_RUNS`` runs. Building counts, as some queries start jobs
while they are built.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from stockroom.plans.catalog import queries
from stockroom.session import build_session

HEADLINE = [
    "low_stock_alerts",
    "inventory_listing",
    "inventory_filter",
    "distinct_products",
    "export_inventory",
    "column_width_profile",
    "scan_lookup",
    "register_decisions",
    "register_new_pieces",
    "status_decisions",
    "status_movements",
    "status_snapshot",
    "checkout_decisions",
    "create_products_decisions",
    "create_users_decisions",
    "edit_users_decisions",
    "toggle_users",
    "login_audit",
    "activity_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else 8,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "4g"),
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=os.environ.get("BENCH_CHECKPOINTS") or tempfile.mkdtemp(prefix="stockroom-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries()
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
