"""Point sets behind the scatter charts: page keys, x and one column per y."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.labels import bucket_floor, bucket_label
from gridlens.operators.filters import (
    bucket_interior,
    equals_all,
    exists_all,
    in_period,
    within_days,
)
from gridlens.operators.joins import semi_work_site
from gridlens.operators.reshape import unpivot_series
from gridlens.operators.windows import with_day
from gridlens.plans.regressions import day_slices
from gridlens.schemas import NETWORK_SERIES, PLOT_TASK_TYPES

PAGE = ["day", "src", "dest"]

# Point set name -> (x metric, y metrics), in the summary's metric names.
JOB_POINTS = {
    "points_core": ("KEvents", ["CoreHr"]),
    "points_time": ("KEvents", ["WallClockHr"]),
    "points_event": ("CpuEff", ["EventRate"]),
    "points_metrics": ("CpuEff", ["EventRate"]),
    "points_metric_k": ("CpuEff", ["KEvents"]),
    "points_cpuhr": ("CpuTimeHr", ["CpuEff", "EventRate"]),
    "points_mem": ("MemoryMB", ["CpuEff", "EventRate"]),
    "points_disk": ("DiskUsage", ["CpuEff", "EventRate"]),
    "points_bytes_recvd": ("BytesRecvd", ["CpuEff", "EventRate"]),
}

# Point set name -> y metrics drawn against each of the six network series.
NETWORK_POINTS = {
    "points_net_bytes": ["DiskUsage", "BytesRecvd"],
    "points_net_events": ["KEvents", "EventRate"],
    "points_net_cpuhr": ["CpuTimeHr", "CpuEff"],
    "points_net_eff": ["CpuEff", "EventRate"],
    "points_net_queue": ["QueueHrs"],
}


def legacy_names(summary: DataFrame) -> DataFrame:
    """Summary whose mean columns carry the bare metric names older readers use."""
    return summary.select(
        *[
            F.col(c).alias(c.removeprefix("mean")) if c.startswith("mean") else F.col(c)
            for c in summary.columns
        ]
    )


def job_points(summary: DataFrame, name: str, period: tuple | None = None) -> DataFrame:
    """Points per (day, src, dest) of one metric against others."""
    x, ys = JOB_POINTS[name]
    rows = day_slices(legacy_names(summary), period).filter(exists_all(x, *ys))
    return rows.select(*PAGE, F.col(x).alias("x"), *ys)


def network_points(summary: DataFrame, name: str, period: tuple | None = None) -> DataFrame:
    """Points per (day, src, dest, series) of a network series against job metrics."""
    ys = NETWORK_POINTS[name]
    rows = day_slices(legacy_names(summary), period)
    return unpivot_series(rows, [*PAGE, *ys], NETWORK_SERIES, prefix="").select(
        *PAGE, "series", "x", *ys
    )


def event_bucket_points(rows: DataFrame, events: str, x: str, y: str) -> DataFrame:
    """Points per event-count bucket; multiples of the bucket width belong to none."""
    inside = rows.filter(bucket_interior(F.col(events)) & exists_all(x, y))
    return inside.select(
        bucket_floor(F.col(events)).alias("bucket"),
        bucket_label(F.col(events)).alias("label"),
        F.col(x).alias("x"),
        F.col(y).alias("y"),
    )


def summary_event_points(summary: DataFrame) -> DataFrame:
    return event_bucket_points(summary, "meanKEvents", "meanCpuEff", "meanEventRate")


def job_event_points(jobs: DataFrame, y: str, period: tuple) -> DataFrame:
    """Raw jobs completed in the period: CPU efficiency against ``y`` per event-count bucket."""
    done = jobs.filter(in_period(F.col("CompletionDate"), period))
    return event_bucket_points(done, "KEvents", "CpuEff", y)


def task_type_points(
    jobs: DataFrame, allowlist: DataFrame, tasks: list[str] = PLOT_TASK_TYPES, period: tuple | None = None
) -> DataFrame:
    """Raw off-site jobs per (day, site, task): CPU efficiency against event rate."""
    wanted = jobs.filter(
        F.col("TaskType").isin(tasks)
        & equals_all(InputData="Offsite")
        & exists_all("ChirpCMSSWEventRate")
        & within_days(F.col("JobFinishedHookDone"), period)
    )
    return with_day(semi_work_site(wanted, allowlist), "JobFinishedHookDone").select(
        "day",
        F.lower("Site").alias("site"),
        F.col("TaskType").alias("task_type"),
        F.col("CpuEff").alias("x"),
        F.col("ChirpCMSSWEventRate").alias("y"),
    )
