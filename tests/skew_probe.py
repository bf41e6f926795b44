"""Skew probe: one key holds a third of the rows; compare the largest task of a plain
per-key window with that of ``operators.scan.ordered_scan``.

Usage: python tests/skew_probe.py [sf_dir] [partitions]
Rows come from the driver's lineitem table; every part key divisible by 3 is mapped to
key 0, so key 0 holds about a third of all rows. Task sizes are read from Spark's event
log, written to a fresh scratch folder. AQE partition coalescing is off so that task
sizes reflect the partitioning itself.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _max_task_records(log_dir: str, job_group: str) -> tuple[int, int]:
    """(largest shuffle-read record count of one task, total) for stages of a job group."""
    stage_jobs, best, total = {}, 0, 0
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            events = [json.loads(line) for line in f]
        for e in events:
            if e.get("Event") == "SparkListenerJobStart":
                props = e.get("Properties", {})
                if props.get("spark.jobGroup.id") == job_group:
                    for sid in e.get("Stage IDs", []):
                        stage_jobs[sid] = True
        for e in events:
            if e.get("Event") == "SparkListenerTaskEnd" and e.get("Stage ID") in stage_jobs:
                m = e.get("Task Metrics") or {}
                read = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                best = max(best, read)
                total += read
    return best, total


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    parts = int(sys.argv[2]) if len(sys.argv) > 2 else 64
    log_dir = tempfile.mkdtemp(prefix="skew-probe-events-")
    spark = (SparkSession.builder.master("local[8]").appName("skew-probe")
             .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(parts))
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from shelfwise.operators.scan import ordered_scan
    from shelfwise.session import shared_dir
    shared_dir(spark)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = li.select(F.when(F.col("l_partkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_partkey")).alias("k"),
                   "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                   F.col("l_quantity").cast("long").alias("q"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = df.count()
    hot = df.where("k = 0").count()
    results = {}
    for name, build in [
        ("window", lambda: df.withColumn("cum", F.sum("q").over(
            Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))),
        ("ordered_scan", lambda: ordered_scan(df, ["k"], order, sums={"cum": F.col("q")})),
        ("ordered_scan_balanced", lambda: ordered_scan(df, ["k"], order, sums={"cum": F.col("q")}, balanced=True)),
    ]:
        spark.sparkContext.setJobGroup(name, name)
        t = time.time()
        build().write.format("noop").mode("overwrite").save()
        results[name] = {"seconds": round(time.time() - t, 2)}
    spark.stop()
    for name in results:
        biggest, total = _max_task_records(log_dir, name)
        results[name].update(largest_task_shuffle_records=biggest, shuffle_records=total)
    print(json.dumps({"rows": rows, "hot_key_rows": hot, "partitions": parts, **results}))


if __name__ == "__main__":
    main()
