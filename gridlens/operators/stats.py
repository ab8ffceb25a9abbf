"""Five-number summaries (min, mean, max, median, population std) of intervals per grid cell.

Plan. The input intervals are cut at coarse bucket borders (a few hours) and written once, still
whole. They are shuffled once on (pair keys, bucket, salt), see :mod:`gridlens.operators.placement`.
Inside a bucket, neighbouring cells covered by the same intervals of a series form one segment: a
segment is summarised once, all metrics together (:mod:`gridlens.operators.runs`), and moves to its
place before its result is copied to its cells. Exploding first would shuffle and aggregate every
interval once per cell.

Skew. A crowded place is spread by its series. A single series above the limit is aggregated per cell
with map-side partials, and its medians are found by :func:`gridlens.operators.selection.exact_median`,
which never holds a group in one place. Both kinds read the written pieces, and their results lie in
the same places, so one join takes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.operators.placement import Placement
from gridlens.operators.runs import grouped_runs
from gridlens.operators.selection import exact_median
from gridlens.operators.windows import Grid
from gridlens.schemas import STATS, stat_columns
from gridlens.session import stored

BUCKET = 6 * 3600
HOT_LIMIT = 200_000


def moments(metric: str) -> list[Column]:
    value = F.col(metric)
    return [
        F.min(value).alias("min" + metric),
        F.avg(value).alias("mean" + metric),
        F.max(value).alias("max" + metric),
        F.stddev_pop(value).alias("std" + metric),
    ]


def cut_intervals(
    intervals: DataFrame, t0: str, t1: str, keep: list[str], grid: Grid, bucket: int = BUCKET
) -> DataFrame:
    """One row per (interval, bucket it has cells in), with its first and last cell there; written once."""
    if bucket % grid.step:
        raise ValueError("bucket must be a multiple of the grid step")
    low, high = grid.cells_inside(F.col(t0), F.col(t1))
    origin, span = F.lit(grid.first % grid.step), F.lit(bucket)

    def start(cell: str) -> Column:
        return F.col(cell) - F.pmod(F.col(cell) - origin, span)

    pieces = (
        intervals.select(*keep, low.alias("_low"), high.alias("_high"))
        .filter(F.col("_low") <= F.col("_high"))
        .withColumn("bucket", F.explode(F.sequence(start("_low"), start("_high"), span.cast("bigint"))))
    )
    first = F.greatest("_low", "bucket")
    last = F.least(F.col("_high"), F.col("bucket") + F.lit(bucket - grid.step))
    return stored(pieces.select(*keep, "bucket", first.alias("_first"), last.alias("_last")), "pieces")


def cell_stats(
    pieces: DataFrame, placement: Placement, metrics: list[str], step: int
) -> DataFrame:
    """Five-number summaries of ``metrics`` per (series, cell), over the pieces containing the cell.

    Columns: the series, ``salt``, ``beginDate`` and the statistics (NULL values are skipped). Rows
    lie in the places of ``placement``.
    """
    series, width = placement.series, F.lit(step).cast("bigint")
    columns = [*series, "salt", "beginDate", *stat_columns(metrics)]
    usual, giant = placement.split(pieces)
    group = [*series, "salt"]
    runs = placement.placed(grouped_runs(placement.placed(placement.salted(usual)), group, metrics, step, STATS))
    cells = F.explode(F.sequence("_from", F.col("_to") - width, width)).alias("beginDate")
    stats = runs.select("*", cells).select(*columns)
    if giant is None:
        return stats
    key = [*series, "beginDate"]
    covered = F.explode(F.sequence("_first", "_last", width)).alias("beginDate")
    basic = giant.select(*series, *metrics, covered).groupBy(*key).agg(*[c for m in metrics for c in moments(m)])
    medians = exact_median(giant, series, metrics, (F.col("_first"), F.col("_last"), step))
    renamed = medians.select(*[F.col(k).alias("_r_" + k) for k in key], *["median" + m for m in metrics])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col("_r_" + k))
    large = placement.salted(basic.join(renamed, same, "left")).select(*columns)
    return stats.unionByName(placement.placed(large))


def interval_window_stats(
    intervals: DataFrame,
    t0: str,
    t1: str,
    pair: list[str],
    keys: list[str],
    metrics: list[str],
    grid: Grid,
    bucket: int = BUCKET,
    hot_limit: int = HOT_LIMIT,
) -> tuple[DataFrame, Placement, DataFrame]:
    """Five-number summaries of ``metrics`` per (pair, keys, cell), over the intervals containing the cell.

    Returns the statistics (``pair + [bucket] + keys + [salt, beginDate]`` and one column each), the
    placement they lie in, and the written pieces.
    """
    pieces = cut_intervals(intervals, t0, t1, [*pair, *keys, *metrics], grid, bucket)
    place = [*pair, "bucket"]
    placement = Placement.of(pieces, place, [*place, *keys], hot_limit)
    return cell_stats(pieces, placement, metrics, grid.step), placement, pieces
