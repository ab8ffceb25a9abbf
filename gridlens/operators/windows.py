"""Time grid and containment: which grid cells lie inside an interval.

A cell ``w`` lies inside ``[t0, t1]`` when ``t0 <= w`` and ``w + step <= t1``. Instead of a range
join (a nested loop in Spark), the cells of an interval are computed from its ends and exploded,
so every later join on the cell is an equality.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.times import day_start, to_period
from gridlens.schemas import WINDOW_STEP


@dataclass(frozen=True)
class Grid:
    """Cells ``first, first + step, ..`` up to ``last``."""

    first: int
    last: int
    step: int = WINDOW_STEP

    @staticmethod
    def of(period: tuple, step: int = WINDOW_STEP) -> Grid:
        """The grid of a period: it begins one step before the start and may begin a cell at the end."""
        start, end = to_period(period)
        first = start - step
        return Grid(first, first + (end - first) // step * step, step)

    def cells_inside(self, t0: Column, t1: Column) -> tuple[Column, Column]:
        """First and last cell inside ``[t0, t1]``; first > last when there is none."""
        step, origin = F.lit(self.step), F.lit(self.first % self.step)
        low = t0 + F.pmod(origin - t0, step)
        high = t1 - F.pmod(t1 - origin, step) - step
        return F.greatest(low, F.lit(self.first)), F.least(high, F.lit(self.last))


def explode_windows(df: DataFrame, t0: str, t1: str, grid: Grid, window: str = "beginDate") -> DataFrame:
    """One row per (input row, cell inside the row's interval)."""
    low, high = grid.cells_inside(F.col(t0), F.col(t1))
    return (
        df.withColumn("_low", low)
        .withColumn("_high", high)
        .filter(F.col("_low") <= F.col("_high"))
        .withColumn(window, F.explode(F.sequence("_low", "_high", F.lit(grid.step).cast("bigint"))))
        .drop("_low", "_high")
    )


def window_grid(df: DataFrame, t0: str, t1: str, step: int = WINDOW_STEP) -> DataFrame:
    """Every cell of the grid spanned by a table's own intervals."""
    bounds = df.agg(F.min(t0).alias("start"), F.max(t1).alias("end"))
    return bounds.select(
        F.explode(
            F.sequence(F.col("start") - F.lit(step), F.col("end"), F.lit(step).cast("bigint"))
        ).alias("beginDate")
    ).withColumn("endDate", F.col("beginDate") + F.lit(step))


def with_day(df: DataFrame, seconds: str, name: str = "day") -> DataFrame:
    """Add the day a time falls in, as epoch seconds of its midnight."""
    return df.withColumn(name, day_start(F.col(seconds)))
