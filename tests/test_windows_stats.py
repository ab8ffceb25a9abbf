import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens import fixtures as fx
from gridlens.operators import joins, placement, runs, selection
from gridlens.operators.selection import exact_median
from gridlens.operators.stats import interval_window_stats
from gridlens.operators.windows import Grid, explode_windows, window_grid
from gridlens.schemas import STATS, stat_columns

PERIOD = (86400, 2 * 86400)


def test_grid_begins_a_step_early_and_reaches_the_end():
    grid = Grid.of(("2017-02-01T00:00:00", "2017-02-28T23:59:59"))
    assert grid.first == 1485907200 - 600
    assert grid.last == 1488326400 - 600
    assert (grid.last - grid.first) // grid.step + 1 == 4033


@pytest.mark.parametrize(
    ("t0", "t1", "cells"),
    [
        (90000, 90600, [90000]),  # exactly one cell
        (90000, 90599, []),  # one second short
        (90001, 91200, [90600]),  # starts inside a cell
        (90000, 91199, [90000]),  # ends inside a cell
        (80000, 86400, [85800]),  # clipped to the first cell, one step before the period
        (2 * 86400 - 600, 2 * 86400 + 5000, [172200, 172800]),  # clipped to the last cell
        (95000, 90000, []),  # reversed
    ],
)
def test_containment_edges(spark, t0, t1, cells):
    rows = spark.createDataFrame([(t0, t1)], "t0 bigint, t1 bigint")
    got = explode_windows(rows, "t0", "t1", Grid.of(PERIOD)).orderBy("beginDate").collect()
    assert [r.beginDate for r in got] == cells


def test_grid_of_a_period_off_the_step():
    grid = Grid.of((100, 5000))
    assert (grid.first, grid.last) == (-500, 4900)


def test_explode_equals_range_join(spark):
    rng = random.Random(1)
    data = [(i, t := rng.randrange(80000, 180000), t + rng.randrange(0, 9000)) for i in range(300)]
    rows = spark.createDataFrame(data, "id int, t0 bigint, t1 bigint")
    grid = Grid.of((86500, 170000))
    got = {(r.id, r.beginDate) for r in explode_windows(rows, "t0", "t1", grid).collect()}
    want = {
        (i, w)
        for i, t0, t1 in data
        for w in range(grid.first, grid.last + 1, 600)
        if t0 <= w and t1 >= w + 600
    }
    assert got == want


def test_window_grid_spans_the_data(spark):
    rows = spark.createDataFrame([(1200, 2400), (1800, 3000)], "t0 bigint, t1 bigint")
    assert [r.beginDate for r in window_grid(rows, "t0", "t1").orderBy("beginDate").collect()] == [
        600, 1200, 1800, 2400, 3000,
    ]


def intervals(spark, n=400, seed=3):
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        t0 = rng.randrange(80000, 170000)
        # A third of the rows share one pair and one host.
        pair = "hot" if rng.random() < 0.34 else rng.choice("abc")
        host = rng.choice([None, "n0"] if pair == "hot" else ["n0", "n1"])
        a = None if rng.random() < 0.1 else float(rng.randrange(5))
        data.append((pair, host, t0, t0 + rng.randrange(0, 30000), a, rng.random()))
    schema = "pair string, host string, t0 bigint, t1 bigint, a double, b double"
    return data, spark.createDataFrame(data, schema)


def brute(data, grid):
    groups = {}
    for pair, host, t0, t1, a, b in data:
        for w in range(grid.first, grid.last + 1, 600):
            if t0 <= w and t1 >= w + 600:
                groups.setdefault((pair, host, w), []).append((a, b))
    out = {}
    for key, rows in groups.items():
        stats = []
        for values in zip(*rows, strict=True):
            v = np.array([x for x in values if x is not None])
            stats += [v.min(), v.mean(), v.max(), np.median(v), v.std()] if len(v) else [None] * 5
        out[key] = stats
    return out


# Limits from which nothing is crowded, places are, some series are giants, all are.
@pytest.mark.parametrize("hot_limit", [10**6, 50, 20, 0])
def test_window_stats_equal_brute_force_at_every_load(spark, hot_limit):
    data, rows = intervals(spark)
    grid = Grid.of(PERIOD)
    stats, found, _ = interval_window_stats(
        rows, "t0", "t1", ["pair"], ["host"], ["a", "b"], grid, hot_limit=hot_limit
    )
    assert bool(found.giants) == (hot_limit <= 20)
    assert bool(found.parts) == (0 < hot_limit <= 50)
    got = stats.collect()
    want = brute(data, grid)
    assert len(got) == len(want)
    columns = stat_columns(["a", "b"])
    for r in got:
        for value, expected in zip([r[c] for c in columns], want[(r.pair, r.host, r.beginDate)], strict=True):
            assert (value is None) == (expected is None)
            assert value is None or value == pytest.approx(expected, abs=1e-9)


def test_bucket_must_fit_the_step(spark):
    _, rows = intervals(spark, 5)
    with pytest.raises(ValueError, match="multiple"):
        interval_window_stats(rows, "t0", "t1", ["pair"], [], ["a"], Grid.of(PERIOD), bucket=1000)


def test_exact_median_of_a_large_skewed_group(spark):
    rows = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        F.when(F.col("id") % 7 != 0, F.pow((F.col("id") * 7919) % 10007, F.lit(2.0))).alias("v"),
        F.lit(None).cast("double").alias("none"),
    )
    got = {r.k: (r.medianv, r.mediannone) for r in exact_median(rows, ["k"], ["v", "none"]).collect()}
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {k: m for k, (m, _) in got.items()} == want
    assert all(none is None for _, none in got.values())


def test_exact_median_of_any_doubles(spark):
    """Signs, zeros, ties, powers far apart, neighbours in the last bit, infinities and NaN."""
    rng = random.Random(8)
    near = [1.0 + i * 2.0**-52 for i in range(9)]
    groups = {
        "signs": [-3.0, -0.0, 0.0, 2.0, 5.0], "ties": [1.0, 1.0, 1.0, 2.0], "near": near, "one": [7.5], "none": [None, None],
        "powers": [2.0**k for k in range(-1074, 1024, 37)] + [-(2.0**k) for k in range(-1000, 1000, 91)],
        "odd": [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(999)],
        "even": [rng.gauss(100, 1) for _ in range(1000)], "inf": [float("-inf"), 1.0, float("inf"), float("inf")],
        "nan": [float("nan"), 2.0, 1.0, 3.0, None], None: [4.0, 6.0],
    }
    data = [(k, v, 1) for k, values in groups.items() for v in values]
    rows = spark.createDataFrame(data, "k string, v double, n int").repartition(4)
    got = {r.k: (r.medianv, r.mediann) for r in exact_median(rows, ["k"], ["v", "n"]).collect()}
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {k: m for k, (m, _) in got.items()} == want
    assert all(n == 1.0 for _, n in got.values())


def test_histograms_stay_small(spark):
    """A round holds at most a fixed number of buckets per group, whatever the group's size."""
    rows = spark.range(200000).select(F.lit("k").alias("k"), F.rand(3).alias("v"))
    seen = []
    real = selection._cell_counts

    def counted(values, step):
        counts = real(values, step)
        seen.append((counts.count(), values.count()))
        return counts

    selection._cell_counts = counted
    try:
        got = exact_median(rows, ["k"], ["v"]).first().medianv
    finally:
        selection._cell_counts = real
    assert got == rows.agg(F.median("v")).first()[0]
    assert len(seen) <= 5 and all(buckets <= 2 * (selection.BUCKETS + 1) for buckets, _ in seen)
    assert seen[1][1] < seen[0][1] / 10


def test_a_giant_series_is_combined_before_it_moves(spark):
    """One pair, bucket and series holds everything: no task reads more than the combined groups."""
    rows = spark.range(20000).select(
        F.lit("p").alias("pair"), F.lit("h").alias("host"), F.lit(90000).alias("t0"),
        (F.lit(95000) + F.col("id") % 7 * 600).alias("t1"), (F.col("id") * 7919 % 1009).cast("double").alias("a"),
    )
    grid = Grid.of(PERIOD)
    stats, found, _ = interval_window_stats(rows, "t0", "t1", ["pair"], ["host"], ["a"], grid, hot_limit=1000)
    assert len(found.giants) == 1 and found.tasks >= 1
    plain, usual, _ = interval_window_stats(rows, "t0", "t1", ["pair"], ["host"], ["a"], grid)
    assert not usual.giants and not usual.parts
    got, want = (df.orderBy("beginDate").collect() for df in (stats, plain))
    assert len(got) == len(want) > 8
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a.mediana == b.mediana and a[5:] == pytest.approx(b[5:])


def test_placement_tables_are_bounded(spark):
    rows = spark.range(30000).select((F.col("id") % 10000).alias("p"), (F.col("id") % 15000).alias("s"))
    found = placement.Placement.of(rows, ["p"], ["p", "s"], 0)
    assert len(found.giants) <= placement.GIANT_HASHES and len(found.parts) <= placement.SLOTS
    crowded = placement.Placement.of(rows, ["p"], ["p", "s"], 2)
    assert 0 < len(crowded.parts) <= placement.SLOTS
    salted, copied = crowded.salted(rows), crowded.copied(rows.select("p").distinct())
    assert salted.count() == 30000 and salted.join(copied, ["p", "salt"], "left_anti").isEmpty()


def test_numbers_of_a_segment():
    """NULL is skipped, NaN lies above all numbers; equal values have no spread, however large."""
    nan, steps = float("nan"), np.array([0, 0, 600, 0])
    values = np.array([[3.0, 1.0, nan, nan], [5e8 / 3] * 4, [nan] * 4])
    known = np.array([[True, True, True, False], [True] * 4, [False] * 4])
    low, high, counts, numbers = runs.segment_stats(steps, np.array([600, 600, 600, 600]), values, known, 600, STATS)
    assert low.tolist() == [0, 600] and high.tolist() == [600, 1200]
    assert counts.tolist() == [[2, 3], [3, 4], [0, 0]]
    assert numbers[:, 0, 0].tolist() == [1.0, 2.0, 3.0, 2.0, 1.0]
    assert numbers[0, 0, 1] == 1.0 and numbers[3, 0, 1] == 3.0 and all(np.isnan(numbers[i, 0, 1]) for i in (1, 2, 4))
    assert numbers[:, 1, 1] == pytest.approx([5e8 / 3] * 4 + [0], abs=1e-6)


def test_a_series_over_many_batches_is_one_group(spark, monkeypatch):
    """Batches of Arrow cut series anywhere; results leave in batches of their own."""
    monkeypatch.setattr(runs, "VALUES", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data, rows = intervals(spark)
        grid = Grid.of(PERIOD)
        stats, _, _ = interval_window_stats(rows, "t0", "t1", ["pair"], ["host"], ["a", "b"], grid)
        got = {(r.pair, r.host, r.beginDate): [r[c] for c in stat_columns(["a", "b"])] for r in stats.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(data, grid)
    assert got.keys() == want.keys()
    assert all(g == pytest.approx(want[k]) for k, g in got.items() if None not in g)


def test_pieces_are_not_copied_to_segments(spark):
    """Many pieces of a series that overlap: the rows before the summary grow with the pieces."""
    rows = spark.range(2000).select(
        F.lit("p").alias("pair"), F.lit("h").alias("host"), (F.lit(86400) + F.col("id") % 18 * 600).alias("t0"),
        (F.lit(97200) + F.col("id") % 18 * 600).alias("t1"), F.col("id").cast("double").alias("a"),
    )
    stats, _, _ = interval_window_stats(rows, "t0", "t1", ["pair"], ["host"], ["a"], Grid.of(PERIOD))
    assert "Window" not in stats._jdf.queryExecution().executedPlan().toString()


def test_small_groups_take_no_histograms(spark, monkeypatch):
    """Histograms cost many times their values in groups of a few rows: such groups are settled at once."""
    rows = spark.range(3000).select((F.col("id") % 999).alias("k"), ((F.col("id") * 7919) % 1009).cast("double").alias("v"))
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    rounds, real = [], selection._cell_counts
    monkeypatch.setattr(selection, "_cell_counts", lambda *a: (rounds.append(1), real(*a))[1])
    assert {r.k: r.medianv for r in exact_median(rows, ["k"], ["v"]).collect()} == want
    assert not rounds
    monkeypatch.setattr(selection, "GATHERED", 2)
    assert {r.k: r.medianv for r in exact_median(rows, ["k"], ["v"]).collect()} == want
    assert rounds


def test_exact_median_of_any_doubles_by_histograms(spark, monkeypatch):
    monkeypatch.setattr(selection, "GATHERED", 5)
    test_exact_median_of_any_doubles(spark)


def test_giants_by_histograms_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(selection, "GATHERED", 30)
    test_window_stats_equal_brute_force_at_every_load(spark, 20)


def test_the_load_comes_to_the_driver_as_bounded_rows(spark, monkeypatch):
    """Many series above the limit in many places: a row per slot and per hash, no list of series."""
    monkeypatch.setattr(placement, "GIANT_HASHES", 16)
    rows = spark.range(8000).select((F.col("id") % 2000).alias("p"), (F.col("id") % 4000).alias("s"))
    held, real = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: (held.append(real(df)), held[-1])[1])
    found = placement.Placement.of(rows, ["p"], ["p", "s"], 1)
    monkeypatch.undo()
    values = sum(len(v) if isinstance(v, list) else 1 for r in held[0] for v in r)
    assert found.giants == frozenset(range(16)) and not found.parts
    assert values <= 4 * (len({r["_slot"] for r in held[0]}) + 16)


def broadcasts(df):
    """Tables a plan sends to every task, as the lines of their scans or joins."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    sent = [i for i, line in enumerate(lines) if "BroadcastExchange" in line]
    return [" ".join(lines[i : i + 5]) for i in sent]


@pytest.mark.parametrize("gathered", [10_000, 30])
def test_no_table_of_medians_is_sent_to_the_tasks(spark, monkeypatch, gathered):
    """Left alone, a join of a written table is planned by the size of its files, whatever they hold once read."""
    monkeypatch.setattr(selection, "GATHERED", gathered)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    planned, real = [], selection._narrowed
    monkeypatch.setattr(selection, "_narrowed", lambda *a: (planned.append(real(*a)), planned[-1])[1])
    data, rows = intervals(spark)
    data.append((None, "n0", 90000, 110000, 1.0, 2.0))
    rows = spark.createDataFrame(data * 3, rows.schema)
    grid = Grid.of(PERIOD)
    stats, found, _ = interval_window_stats(rows, "t0", "t1", ["pair"], ["host"], ["a", "b"], grid, hot_limit=2)
    assert found.giants and bool(planned) == (gathered == 30)
    assert all("ExistingRDD" in sent for df in [stats, *planned] for sent in broadcasts(df))
    got = {(r.pair, r.host, r.beginDate): [r[c] for c in stat_columns(["a", "b"])] for r in stats.collect()}
    want = brute(data * 3, grid)
    assert got.keys() == want.keys()
    assert all(g == pytest.approx(want[k]) for k, g in got.items() if None not in g)


def test_tables_are_sent_by_their_rows(spark, tmp_path, monkeypatch):
    """Compressed keys: a file of a few kB may hold any number of rows."""
    spark.range(5000).select("id", F.lit("x").alias("v")).write.parquet(str(tmp_path / "t"))
    table, rows = spark.read.parquet(str(tmp_path / "t")), spark.range(300).withColumn("id", F.col("id") * 7)
    few = rows.join(joins.sized(table), "id")
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 4999)
    many = rows.join(joins.sized(table), "id")
    assert broadcasts(few) and not broadcasts(many)
    assert few.count() == many.count() == 300


def test_job_rows_send_no_large_table(spark, tmp_path, monkeypatch):
    """Keys that repeat, have no partner or are NULL join as ever, and no side is planned by its files."""
    key = F.when(F.col("id") % 9 != 0, F.col("id") % 40)
    tables = {
        "lineitem": spark.range(300).select(*[key.alias(c) for c in ("l_orderkey", "l_suppkey", "l_partkey")]),
        "orders": spark.range(60).select(key.alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey")),
        "customer": spark.range(6).select(F.col("id").alias("c_custkey")),
        "supplier": spark.range(50).select((F.col("id") % 30).alias("s_suppkey")),
        "part": spark.range(35).select(F.col("id").alias("p_partkey")),
    }
    for name, rows in tables.items():
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    usual = fx.job_rows(spark, str(tmp_path))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    large = fx.job_rows(spark, str(tmp_path))
    assert broadcasts(usual) and not broadcasts(large)
    assert large.count() == usual.count() > 300 and large.exceptAll(usual).isEmpty()
