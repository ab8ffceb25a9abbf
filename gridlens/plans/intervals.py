"""Interval series behind the timeline charts: job and probe values with their time spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.times import probe_interval
from gridlens.operators.filters import (
    at_least,
    in_period,
    in_period_ms,
    measured_probes,
    offsite_jobs,
)
from gridlens.operators.joins import join_site_names, likely_pairs, semi_data_site, semi_work_site
from gridlens.operators.probes import with_side
from gridlens.session import stored

COLUMNS = ["src", "dest", "series", "t0", "t1", "value"]


def _stack(*series: tuple[Column, str, Column]) -> Column:
    """Rows ``(series, value)`` for the entries whose condition holds."""
    return F.inline(
        F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("series"),
                        F.when(condition, value.cast("double")).alias("value"),
                    )
                    for condition, name, value in series
                ]
            ),
            lambda entry: entry["value"].isNotNull(),
        )
    )


def interval_jobs(jobs: DataFrame, allowlist: DataFrame, site_map: DataFrame, period: tuple) -> DataFrame:
    """Off-site jobs completed in the period with a non-negative event rate, site names resolved."""
    wanted = offsite_jobs(jobs).filter(
        in_period(F.col("CompletionDate"), period) & at_least(F.col("EventRate"), 0)
    )
    known = semi_work_site(semi_data_site(wanted, allowlist), allowlist)
    return join_site_names(known, site_map)


def interval_series(
    jobs: DataFrame,
    probes: DataFrame,
    allowlist: DataFrame,
    site_map: DataFrame,
    period: tuple,
    throughput: bool = True,
) -> DataFrame:
    """``(src, dest, series, t0, t1, value)`` for every site pair with jobs.

    With ``throughput`` the packet-loss and throughput series share a chart, which needs both:
    they appear only for pairs that have both. Without it packet loss stands alone.

    Jobs and probes are scanned once: the rows taken are written, and the pairs are found in them.
    Probes of other pairs are dropped in the scan; the pairs that are joined are a written table of
    known size, so the probes are not moved while it is small.
    """
    fields = ["src", "dest", "grid_src", "grid_dest", "JobCurrentStartDate", "JobFinishedHookDone", "CpuEff"]
    named = stored(
        interval_jobs(jobs, allowlist, site_map, period).select(*fields, "ChirpCMSSWEventRate"), "interval-jobs"
    )
    every = F.lit(True)
    job_rows = named.select(
        "src",
        "dest",
        F.col("JobCurrentStartDate").alias("t0"),
        F.col("JobFinishedHookDone").alias("t1"),
        _stack((every, "CpuEff", F.col("CpuEff")), (every, "EventRate", F.col("ChirpCMSSWEventRate"))),
    )

    pairs = stored(named.select("src", "dest", "grid_src", "grid_dest").distinct(), "interval-pairs")
    t0, t1 = probe_interval(F.col("ts_s"))
    taken = with_side(measured_probes(probes).filter(in_period_ms(F.col("timestamp_ms"), period)))
    mtype = F.col("mtype")
    probe_rows = taken.select(
        F.col("srcSite").alias("grid_src"),
        F.col("destSite").alias("grid_dest"),
        t0.alias("t0"),
        t1.alias("t1"),
        _stack(
            (mtype == "packet_loss_rate", "packet_loss", F.col("packet_loss")),
            (mtype == "throughput", "throughput", F.col("throughput")),
            (mtype == "latency", "delay_mean", F.col("delay_mean")),
            (mtype == "latency", "delay_median", F.col("delay_median")),
            (mtype == "latency", "delay_sd", F.col("delay_sd")),
        ),
    )
    probe_rows = stored(likely_pairs(probe_rows, pairs, ["grid_src", "grid_dest"]), "interval-probes")
    if throughput:
        shared = ["packet_loss", "throughput"]
        complete = (
            probe_rows.groupBy("grid_src", "grid_dest")
            .agg(*[F.max(F.col("series") == s).alias("has_" + s) for s in shared])
            .filter(F.col("has_packet_loss") & F.col("has_throughput"))
            .select("grid_src", "grid_dest", F.lit(True).alias("complete"))
        )
        pairs = stored(pairs.join(complete, ["grid_src", "grid_dest"], "left"), "interval-complete")
        wanted = ~F.col("series").isin(shared) | F.coalesce("complete", F.lit(False))
    else:
        wanted = F.col("series") != "throughput"
    placed = probe_rows.join(pairs, ["grid_src", "grid_dest"]).filter(wanted)
    return job_rows.select(*COLUMNS).unionByName(placed.select(*COLUMNS))
