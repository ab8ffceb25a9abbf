"""Regression analyses of the summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.labels import pair_label
from gridlens.functions.ratios import mean_lumos
from gridlens.operators.filters import touched_days, within_days
from gridlens.operators.regression import (
    data_site_share,
    effect_counts,
    effect_shares,
    negative,
    opposed,
    regress,
    with_significance,
)
from gridlens.operators.reshape import union_throughput_sides, unpivot_series
from gridlens.operators.windows import with_day
from gridlens.schemas import REGRESSION_TASK

SLOT_KEYS = ["day", "src", "dest", "LastRemoteHost", "Workflow"]
PAIR_KEYS = ["day", "src", "dest", "Workflow"]


def day_slices(summary: DataFrame, period: tuple | None = None, task: str | None = None) -> DataFrame:
    """Summary rows inside the period's days, with ``day`` as epoch seconds of its midnight.

    The stored ``day`` is a folder name and follows from ``beginDate``: other days are not listed.
    """
    if task is not None:
        summary = summary.filter(F.col("task_type") == task)
    if period is not None and dict(summary.dtypes).get("day") == "date":
        summary = summary.filter(touched_days(F.col("day"), period))
    return with_day(summary.filter(within_days(F.col("beginDate"), period)), "beginDate")


def network_regression(summary: DataFrame, period: tuple | None = None) -> DataFrame:
    """Throughput against packet loss and latency measured at either site."""
    rows = union_throughput_sides(day_slices(summary, period, REGRESSION_TASK), SLOT_KEYS)
    fits = regress(rows, [*SLOT_KEYS, "series"], "x", {"c_": "y_src", "e_": "y_dest"})
    return with_significance(fits)


def _network_effect(summary: DataFrame, period: tuple | None, c: str, e: str) -> DataFrame:
    rows = unpivot_series(day_slices(summary, period, REGRESSION_TASK), [*SLOT_KEYS, c, e])
    return with_significance(regress(rows, [*SLOT_KEYS, "series"], "x", {"c_": c, "e_": e}))


def overbyte_regression(summary: DataFrame, period: tuple | None = None) -> DataFrame:
    """Network series against CPU efficiency and input volume."""
    return _network_effect(summary, period, "meanCpuEff", "meanInputGB")


def scatter_regression(summary: DataFrame, period: tuple | None = None) -> DataFrame:
    """Network series against CPU efficiency and event rate."""
    return _network_effect(summary, period, "meanCpuEff", "meanEventRate")


def lumosity_regression(summary: DataFrame, period: tuple | None = None) -> DataFrame:
    """Events against CPU efficiency, every task type."""
    return regress(day_slices(summary, period), PAIR_KEYS, "meanKEvents", {"c_": "meanCpuEff"})


def vslumos_regression(summary: DataFrame, period: tuple | None = None) -> DataFrame:
    """Events per wall-clock hour against CPU efficiency and event rate."""
    rows = day_slices(summary, period).withColumn(
        "x", mean_lumos(F.col("meanKEvents"), F.col("meanWallClockHr"))
    )
    return regress(rows, PAIR_KEYS, "x", {"c_": "meanCpuEff", "e_": "meanEventRate"})


def opposed_effects(fits: DataFrame, summary: DataFrame, period: tuple | None = None) -> DataFrame:
    """Opposite-sign effects per workflow and per slot."""
    present = day_slices(summary, period, REGRESSION_TASK)
    kinds = {"workflow": F.col("Workflow"), "slot": F.col("LastRemoteHost")}
    return effect_counts(fits, present, opposed(), kinds)


def negative_effects(fits: DataFrame, summary: DataFrame, period: tuple | None = None) -> DataFrame:
    """Falling CPU efficiency per site pair and per slot."""
    present = day_slices(summary, period, REGRESSION_TASK)
    kinds = {"pair": pair_label(F.col("src"), F.col("dest")), "slot": F.col("LastRemoteHost")}
    return effect_counts(fits, present, negative(), kinds)


def data_sites(summary: DataFrame, period: tuple | None = None) -> DataFrame:
    return data_site_share(day_slices(summary, period, REGRESSION_TASK), SLOT_KEYS)


__all__ = [
    "data_sites",
    "day_slices",
    "effect_shares",
    "lumosity_regression",
    "negative_effects",
    "network_regression",
    "opposed_effects",
    "overbyte_regression",
    "scatter_regression",
    "vslumos_regression",
]
