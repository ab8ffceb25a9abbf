"""Exact medians of groups of any size, by refining histograms between known bounds.

Rows are counted per group first. Groups that fit a task many times over are dealt to the tasks and
settled there, all metrics and cells at once. The others are not gathered: every round counts their
values per histogram bucket - counts, minima and maxima merge, so they are combined before the shuffle -
and finds the bucket that holds the middle ranks. The next round looks at the values of those buckets
alone, between the least and the greatest value found there. A bucket whose bounds are equal is the
answer.

The first histogram has a fixed number of buckets for each power of two, so the bounds of a bucket
are close together; every further round divides them by ``BUCKETS``. Five rounds reach the last bit
of a double, however the values are spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.operators.joins import sized
from gridlens.operators.runs import grouped_runs
from gridlens.session import stored

# Rows of a group that one task settles, and hashes that tell larger groups apart.
GATHERED = 10_000
GROUP_HASHES = 1 << 16
# Buckets per power of two in the first round, and buckets of every further round.
PER_POWER = 32
BUCKETS = 4096
# Beyond the exponents of a double, and the place of NaN above all numbers.
LAST_POWER = 1100
NAN_BUCKET = 10 * LAST_POWER * PER_POWER


def exact_median(
    rows: DataFrame, keys: list[str], metrics: list[str], span: tuple[Column, Column, int] | None = None,
    cell: str = "beginDate",
) -> DataFrame:
    """``keys`` and ``median<metric>`` of every group; NULL values are skipped, NULL keys are a group.

    With a ``span`` (first cell, last cell, step) a row belongs to a group per cell, and the result
    has the column ``cell``. A value is not copied to its cells.
    """
    first, last, step = span or (F.lit(0), F.lit(0), 1)
    ranged = rows.select(
        *keys, first.cast("bigint").alias("_first"), last.cast("bigint").alias("_last"),
        *[F.col(m).cast("double").alias(m) for m in metrics],
    )
    small, large = _by_size(ranged, keys)
    gathered = grouped_runs(small.repartition(*keys), keys, metrics, step, ["median"])
    width = F.lit(step).cast("bigint")
    cells = F.explode(F.sequence("_from", F.col("_to") - width, width)).alias(cell)
    medians = gathered.select(*keys, cells, *["median" + m for m in metrics])
    if large is not None:
        medians = medians.unionByName(_by_histograms(large, keys, metrics, step, cell))
    return medians if span is not None else medians.drop(cell)


def _by_size(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that a task settles, and those of larger groups if there are any. The latter are
    told apart by a table of at most ``GROUP_HASHES`` hashes; a small group may share one."""
    hashed = F.pmod(F.xxhash64(*keys), F.lit(GROUP_HASHES)).cast("int").alias("_hash")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > F.lit(GATHERED))
    found = [(r[0], True) for r in sizes.select(hashed).distinct().collect()]
    if not found:
        return rows, None
    table = rows.sparkSession.createDataFrame(found, "_hash int, _large boolean")
    marked = rows.select("*", hashed).join(F.broadcast(table), "_hash", "left")
    return marked.filter("_large IS NULL").drop("_hash", "_large"), marked.filter("_large").drop("_hash", "_large")


def _by_histograms(rows: DataFrame, keys: list[str], metrics: list[str], step: int, cell: str) -> DataFrame:
    """Medians per group and cell of ``rows``, which have their first and last cell. Rows of equal
    values and spans are counted together first."""
    values = (
        rows.select(
            F.struct(*[F.col(k) for k in keys]).alias("_k"),
            "_first",
            "_last",
            F.posexplode(F.array(*[F.col(m) for m in metrics])).alias("_m", "_v"),
        )
        .filter("_v IS NOT NULL")
        .withColumn("_v", F.col("_v") + F.lit(0.0))  # one zero
        .groupBy("_k", "_m", "_first", "_last", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    values = stored(values, "median-values").withColumn("_path", F.lit(0.0)).withColumn("_i", _power_bucket(F.col("_v")))
    found, targets = [], None
    while True:
        counts = _cell_counts(values, step)
        targets = stored(_middle(counts) if targets is None else _narrowed(targets, counts), "median-targets")
        found.append(targets.filter("_low = _high").select("_k", "_m", "_cell", F.col("_low").alias("_v")))
        open_ = targets.filter("_low < _high")
        if open_.isEmpty():
            break
        at = ["_k", "_m", "_path", "_i"]
        bounds = open_.groupBy(*at).agg(F.min("_low").alias("_from"), F.max("_high").alias("_to"))
        wanted = sized(stored(bounds, "median-buckets"))
        targets = open_.join(wanted, at).select("_k", "_m", F.col("_from").alias("_path"), "_cell", "_which", "_rank")
        inside = values.join(wanted, at).filter(F.col("_v").between(F.col("_from"), F.col("_to")))
        share = (F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from"))
        values = stored(
            inside.select(
                "_k", "_m", "_first", "_last", "_v", "_n", F.col("_from").alias("_path"),
                F.floor(share * F.lit(float(BUCKETS))).alias("_i"),
            ),
            "median-values",
        )
    both = reduce(DataFrame.unionByName, found)
    medians = both.groupBy("_k", "_cell").agg(
        *[(F.sum(F.when(F.col("_m") == i, F.col("_v"))) / 2).alias("median" + m) for i, m in enumerate(metrics)]
    )
    return medians.select("_k.*", F.col("_cell").alias(cell), *["median" + m for m in metrics])


def _power_bucket(v: Column) -> Column:
    """Bucket by sign and logarithm, in the order of the values; zero has its own."""
    power = F.greatest(F.lit(-LAST_POWER), F.least(F.lit(LAST_POWER), F.log2(F.abs(v))))
    place = F.floor(power * PER_POWER) + (LAST_POWER + 1) * PER_POWER
    return (
        F.when(F.isnan(v), F.lit(NAN_BUCKET)).when(v == 0, F.lit(0)).when(v > 0, place).otherwise(-place).cast("bigint")
    )


def _cell_counts(values: DataFrame, step: int) -> DataFrame:
    """Count and bounds of every bucket of every cell."""
    spans = values.groupBy("_k", "_m", "_path", "_i", "_first", "_last").agg(
        F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    cells = F.explode(F.sequence("_first", "_last", F.lit(step).cast("bigint"))).alias("_cell")
    return (
        spans.select("_k", "_m", "_path", "_i", cells, "_n", "_low", "_high")
        .groupBy("_k", "_m", "_path", "_i", "_cell")
        .agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    )


def _middle(counts: DataFrame) -> DataFrame:
    """The buckets of the two middle ranks of every group (the same one twice, mostly)."""
    group = Window.partitionBy("_k", "_m", "_cell")
    so_far = group.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(group)
    ranks = F.array(
        F.struct(F.lit(0).alias("_which"), F.floor((F.col("_total") - 1) / 2).alias("_rank")),
        F.struct(F.lit(1).alias("_which"), F.floor(F.col("_total") / 2).alias("_rank")),
    )
    ranked = counts.withColumn("_upto", F.sum("_n").over(so_far)).withColumn("_total", total)
    return _holding(ranked.select("*", F.inline(ranks)))


def _narrowed(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """The buckets of a round that hold the ranks looked for inside the bucket before."""
    so_far = (
        Window.partitionBy("_k", "_m", "_cell", "_which").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = targets.join(counts.hint("merge"), ["_k", "_m", "_path", "_cell"])
    return _holding(joined.withColumn("_upto", F.sum("_n").over(so_far)))


def _holding(ranked: DataFrame) -> DataFrame:
    before = F.col("_upto") - F.col("_n")
    here = (before <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
    return ranked.filter(here).select(
        "_k", "_m", "_path", "_i", "_cell", "_which", (F.col("_rank") - before).alias("_rank"), "_low", "_high"
    )
