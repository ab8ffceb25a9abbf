"""The ``net_health`` summary: job statistics joined with network statistics per 10-minute window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.labels import host_default
from gridlens.functions.ratios import lumosity
from gridlens.functions.times import probe_interval
from gridlens.operators.filters import (
    REQUIRED_FIELDS,
    completed_jobs,
    exists_all,
    in_period,
    in_period_ms,
    measured_probes,
    offsite_jobs,
    sited_probes,
    task_set,
)
from gridlens.operators.joins import (
    join_site_names,
    likely_pairs,
    semi_data_site,
    semi_work_site,
)
from gridlens.operators.placement import Placement
from gridlens.operators.probes import with_side
from gridlens.operators.stats import BUCKET, HOT_LIMIT, interval_window_stats
from gridlens.operators.windows import Grid
from gridlens.schemas import (
    JOB_METRIC_SOURCE,
    JOB_METRICS,
    NETWORK_SERIES,
    OPTIONAL_JOB_METRICS,
    PROBE_TYPES,
    TASK_TYPES,
    stat_columns,
    summary_schema,
)

SERIES_KEYS = ["task_type", "Workflow", "LastRemoteHost"]


def job_metrics(jobs: DataFrame) -> list[str]:
    """Metrics summarised for a job source: the standard ones and the optional ones it has."""
    return JOB_METRICS + [m for m in OPTIONAL_JOB_METRICS if m in jobs.columns]


def select_jobs(
    jobs: DataFrame, allowlist: DataFrame, site_map: DataFrame, period: tuple, tasks: list[str] = TASK_TYPES
) -> DataFrame:
    """Jobs that enter the summary, with site names and host resolved."""
    wanted = task_set(completed_jobs(offsite_jobs(jobs)), tasks).filter(
        exists_all(*REQUIRED_FIELDS) & in_period(F.col("JobFinishedHookDone"), period)
    )
    known = semi_work_site(semi_data_site(wanted, allowlist), allowlist)
    named = join_site_names(known, site_map)
    metrics = [m for m in job_metrics(jobs) if m != "Lumosity"]
    return named.select(
        F.col("TaskType").alias("task_type"),
        "src",
        "dest",
        "grid_src",
        "grid_dest",
        "Workflow",
        host_default(F.col("LastRemoteHost")).alias("LastRemoteHost"),
        "JobCurrentStartDate",
        "JobFinishedHookDone",
        *[F.col(JOB_METRIC_SOURCE.get(m, m)).cast("double").alias(m) for m in metrics],
        lumosity(F.col("WallClockHr"), F.col("KEvents")).alias("Lumosity"),
    )


def job_window_stats(
    selected: DataFrame,
    grid: Grid,
    metrics: list[str],
    bucket: int = BUCKET,
    hot_limit: int = HOT_LIMIT,
) -> tuple[DataFrame, Placement, DataFrame]:
    """Job statistics per (task, work site, data site, workflow, host, window), with the placement
    of their rows and the written pieces of the jobs."""
    return interval_window_stats(
        selected,
        "JobCurrentStartDate",
        "JobFinishedHookDone",
        pair=["grid_src", "grid_dest"],
        keys=["src", "dest", *SERIES_KEYS],
        metrics=metrics,
        grid=grid,
        bucket=bucket,
        hot_limit=hot_limit,
    )


def probe_series(probes: DataFrame, period: tuple) -> DataFrame:
    """Valid probes with their interval ``[t0, t1]`` and one value column per network series."""
    valid = with_side(
        sited_probes(measured_probes(probes)).filter(in_period_ms(F.col("timestamp_ms"), period))
    )
    t0, t1 = probe_interval(F.col("ts_s"))

    def series(side: str, mtype: str, value: str) -> Column:
        return F.when(
            (F.col("side") == side) & (F.col("mtype") == mtype), F.col(value).cast("double")
        )

    columns = {
        side + suffix: series(side, mtype, value)
        for mtype, (suffix, value) in PROBE_TYPES.items()
        for side in ("src", "dest")
    }
    return valid.select(
        "srcSite",
        "destSite",
        t0.alias("t0"),
        t1.alias("t1"),
        *[columns[s].alias(s) for s in NETWORK_SERIES],
    )


def probe_window_stats(
    series: DataFrame, grid: Grid, bucket: int = BUCKET, hot_limit: int = HOT_LIMIT
) -> DataFrame:
    """Network statistics per (grid source, grid destination, window); absent series are NULL."""
    stats, _, _ = interval_window_stats(
        series,
        "t0",
        "t1",
        pair=["srcSite", "destSite"],
        keys=[],
        metrics=NETWORK_SERIES,
        grid=grid,
        bucket=bucket,
        hot_limit=hot_limit,
    )
    return stats.drop("salt")


def join_window_probes(job_stats: DataFrame, placement: Placement, probe_stats: DataFrame) -> DataFrame:
    """Job windows with the network statistics of their site pair, if any.

    The job rows stay where they are: the few network rows of a place (at most one per cell of its
    bucket) are copied to each of its salts and shuffled there.
    """
    network = probe_stats.select(
        F.col("srcSite").alias("grid_src"),
        F.col("destSite").alias("grid_dest"),
        "bucket",
        "beginDate",
        *stat_columns(NETWORK_SERIES),
    )
    on = [*placement.place, "salt", "beginDate"]
    return job_stats.join(placement.placed(placement.copied(network)), on, "left")


def build_summary(
    jobs: DataFrame,
    probes: DataFrame,
    allowlist: DataFrame,
    site_map: DataFrame,
    period: tuple,
    tasks: list[str] = TASK_TYPES,
    bucket: int = BUCKET,
    hot_limit: int = HOT_LIMIT,
) -> DataFrame:
    """The whole summary table, in the column order of its schema.

    Jobs and probes are scanned once each: their pieces are written, and loads, site pairs and
    statistics are read from these. Probes between pairs without jobs are dropped in the scan.
    """
    grid = Grid.of(period)
    metrics = job_metrics(jobs)
    selected = select_jobs(jobs, allowlist, site_map, period, tasks)
    job_stats, placement, pieces = job_window_stats(selected, grid, metrics, bucket, hot_limit)
    pairs = pieces.select(F.col("grid_src").alias("srcSite"), F.col("grid_dest").alias("destSite"))
    series = likely_pairs(probe_series(probes, period), pairs, ["srcSite", "destSite"])
    joined = join_window_probes(job_stats, placement, probe_window_stats(series, grid, bucket, hot_limit))
    columns = [f.name for f in summary_schema(metrics).fields]
    return (
        joined.withColumn("endDate", F.col("beginDate") + F.lit(grid.step))
        .withColumn("day", F.timestamp_seconds("beginDate").cast("date"))
        .select(*columns)
    )
