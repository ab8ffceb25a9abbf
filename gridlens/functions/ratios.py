"""Guarded ratios and zero filling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lumosity(wall_clock: Column, events: Column) -> Column:
    """Wall-clock hours per thousand events; 0.0 for a job without events."""
    return F.when(events > 0, wall_clock / events).otherwise(F.lit(0.0))


def mean_lumos(events: Column, wall_clock: Column) -> Column:
    """Events per wall-clock hour of a summary row; NULL when no time was spent."""
    return F.try_divide(events, wall_clock)


def zero_fill_pair(src: Column, dest: Column) -> tuple[Column, Column]:
    """A missing side counts as 0.0 when the other side was measured; both missing stays NULL."""
    present = src.isNotNull() | dest.isNotNull()
    return (
        F.when(present, F.coalesce(src, F.lit(0.0))),
        F.when(present, F.coalesce(dest, F.lit(0.0))),
    )
