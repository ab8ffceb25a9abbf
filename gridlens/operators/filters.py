"""Predicates (as columns) and the filters built from them. Time ranges are open on both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.times import to_period, touched_dates
from gridlens.schemas import DAY, EVENT_BUCKET, PROBE_TYPES, SIGNIFICANCE, TASK_TYPES

REQUIRED_FIELDS = ["CMSSWKLumis", "ChirpCMSSWEventRate", "InputGB"]


def equals_all(**values: object) -> Column:
    """Conjunction of equality tests, e.g. ``equals_all(Status="Completed", InputData="Offsite")``."""
    condition = F.lit(True)
    for name, value in values.items():
        condition = condition & (F.col(name) == F.lit(value))
    return condition


def exists_all(*names: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).isNotNull()
    return condition


def open_range(column: Column, low: object, high: object) -> Column:
    return (column > F.lit(low)) & (column < F.lit(high))


def in_period(column: Column, period: tuple) -> Column:
    """Epoch seconds strictly inside the period."""
    return open_range(column, *to_period(period))


def in_period_ms(column: Column, period: tuple) -> Column:
    """Epoch milliseconds strictly inside the period."""
    start, end = to_period(period)
    return open_range(column, start * 1000, end * 1000)


def at_least(column: Column, low: float) -> Column:
    return column >= F.lit(low)


def offsite_jobs(jobs: DataFrame) -> DataFrame:
    """Production jobs that read their only input copy from another site."""
    return jobs.filter(
        equals_all(CMS_JobType="Processing", DataLocationsCount=1, InputData="Offsite")
    )


def completed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(equals_all(Status="Completed"))


def job_slice(jobs: DataFrame, task: str | None = None, site: str | None = None) -> DataFrame:
    """Jobs of one task type and/or one work site (site names compare without case)."""
    if task is not None:
        jobs = jobs.filter(F.col("TaskType") == task)
    if site is not None:
        jobs = jobs.filter(F.lower("Site") == site.lower())
    return jobs


def task_set(jobs: DataFrame, tasks: list[str] = TASK_TYPES) -> DataFrame:
    return jobs.filter(F.col("TaskType").isin(tasks))


def day_interior(column: Column) -> Column:
    """Inside a day: both midnights are excluded, so the 00:00 instant belongs to no day."""
    return F.pmod(column, F.lit(DAY)) != 0


def within_days(column: Column, period: tuple | None) -> Column:
    """Every whole day from the period's first to its last day, the last one included."""
    condition = day_interior(column)
    if period is not None:
        start, end = to_period(period)
        condition = condition & open_range(column, start, end + DAY)
    return condition


def touched_days(day: Column, period: tuple) -> Column:
    """The dates :func:`within_days` can find rows on."""
    start, end = to_period(period)
    return touched_dates(day, start, end + DAY - 1)


def bucket_interior(column: Column, width: int = EVENT_BUCKET) -> Column:
    """Inside a value bucket: multiples of the width belong to no bucket."""
    return (column > 0) & (F.pmod(column, F.lit(float(width))) != 0)


def pair_slice(
    summary: DataFrame, src: str | None = None, dest: str | None = None, slot: str | None = None
) -> DataFrame:
    for name, value in (("src", src), ("dest", dest), ("LastRemoteHost", slot)):
        if value is not None:
            summary = summary.filter(F.col(name) == value)
    return summary


def sited_probes(probes: DataFrame) -> DataFrame:
    """Probes that name both sites."""
    return probes.filter(exists_all("srcSite", "destSite"))


def measured_probes(probes: DataFrame) -> DataFrame:
    """The probe types that carry a measurement the analyses use."""
    return probes.filter(F.col("mtype").isin(*PROBE_TYPES))


def significant(*p_values: Column) -> Column:
    """All p-values below the threshold; an undefined p-value is not significant."""
    condition = F.lit(True)
    for p in p_values:
        condition = condition & F.coalesce(p < F.lit(SIGNIFICANCE), F.lit(False))
    return condition
