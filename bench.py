"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default: all) pick the data
and the cores. Every query is executed in full into a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from gridlens import fixtures as fx
from gridlens.catalog.queries import QUERIES

STAGES = [("stage_jobs", fx.job_store), ("stage_probes", fx.probe_store), ("stage_summary", fx.net_health)]
HEADLINE = [
    "summary_build", "job_window_stats", "probe_window_stats", "join_window_probes",
    "network_regression", "overbyte_regression", "scatter_regression", "lumosity_regression",
    "vslumos_regression", "effect_negative", "effect_opposed", "data_site_share", "regress_xy",
    "points_core", "points_cpuhr", "points_net_eff", "points_net_queue", "points_kevent",
    "points_kevent_hr", "points_task_type", "interval_series", "top_terms", "pairs_present",
    "sort_summary_desc", "union_throughput_sides",
]

# The product itself, without the rounding its check needs.
UNROUNDED = {"summary_build": fx.summary}


def execute(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name, build in STAGES:
        begun = time.perf_counter()
        build(spark, sf_dir)
        times[name] = round(time.perf_counter() - begun, 3)
    for name in HEADLINE:
        begun = time.perf_counter()
        execute({**QUERIES, **UNROUNDED}[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - begun, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_time", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
