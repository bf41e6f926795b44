"""Benchmark the headline jobs and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3). The six inventory tables are derived from the driver tables and
written once as Parquet (the stored tables a deployment would read); each job then runs
from those files and is executed completely with the ``noop`` sink. Reported per job:
the median wall time of the warm runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfwise.plans import reports, sales  # noqa: E402
from shelfwise.plans.allocation import allocate_sales  # noqa: E402
from shelfwise.plans.checks import check_ledger  # noqa: E402
from shelfwise.session import build_session, scratch_path  # noqa: E402
from shelfwise.sources.derived import DRIVER_AS_OF, load_driver_inventory, materialize  # noqa: E402


def _sf(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    partitions = max(2 * cpus, 8)
    spark = build_session(f"local[{cpus}]", partitions, app_name="shelfwise-bench")
    asof = DRIVER_AS_OF

    t0 = time.perf_counter()
    inv = materialize(spark, load_driver_inventory(spark, sf_dir, asof), scratch_path(spark, "bench-tables"))
    derive_s = time.perf_counter() - t0

    jobs = {
        "r1_product_total_stock": lambda: reports.product_total_stock(inv, asof),
        "r2_expiring_batches": lambda: reports.expiring_batches(inv, asof),
        "r5_inventory_kpis": lambda: reports.inventory_kpis(inv, asof),
        "r7_repurchase_list": lambda: reports.repurchase_list(inv, asof),
        "r9_catalog": lambda: reports.catalog(inv, asof),
        "r11_batch_drilldown": lambda: reports.batch_drilldown(inv, asof),
        "r15_activity_feed": lambda: sales.activity_feed(inv, asof, n=4),
        "m2_fefo_partial": lambda: allocate_sales(inv, asof, "partial").allocations,
        "m2_fefo_strict": lambda: allocate_sales(inv, asof, "strict").allocations,
        "i5_check_ledger": lambda: check_ledger(inv),
    }
    results = {}
    for name, build in jobs.items():
        times = []
        for i in range(runs + 1):          # first run warms up and is not counted
            t = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - t)
        results[name] = round(statistics.median(times), 3)
    total = round(sum(results.values()), 3)
    print(json.dumps({
        "metric": "sum_of_median_job_seconds",
        "value": total,
        "unit": "sec",
        "queries": results,
        "sf": _sf(sf_dir),
        "derive_tables_sec": round(derive_s, 3),
        "config": {"master": f"local[{cpus}]", "shuffle_partitions": partitions, "runs": runs,
                   "spark": spark.version},
    }))


if __name__ == "__main__":
    main()
