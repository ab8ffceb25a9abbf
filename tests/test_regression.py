import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.functions import regression as reg
from gridlens.operators.regression import (
    data_site_share,
    effect_counts,
    effect_shares,
    opposed,
    regress,
)


def p_values(spark, cases):
    rows = spark.createDataFrame(cases, "c_t double, c_df double")
    c = lambda name: F.col("c_" + name)
    angles = rows.select("*", *[v.alias("c_" + k) for k, v in reg._angle(c).items()])
    areas = reg._area(c("angle"), c("end"), c("df")) / reg._area(F.lit(0.0), c("end"), c("df"))
    return [r[0] for r in angles.select(areas).collect()]


def series_p(t, df):
    """The finite sum for whole degrees of freedom."""
    angle, cos2, odd = math.atan(t / math.sqrt(df)), df / (df + t * t), int(df) % 2
    term, total = math.sqrt(cos2) if odd else 1.0, 0.0
    for k in range(1, (int(df) - odd) // 2 + 1):
        total += term
        term *= cos2 * (2 * k - 1 + odd) / (2 * k + odd)
    inside = 2 / math.pi * (angle + math.sin(angle) * total) if odd else math.sin(angle) * total
    return 1 - inside


def test_known_p_values(spark):
    cases = [(2.0, 10.0), (0.5, 1.0), (10.0, 3.0), (2.1, 1999.0), (0.0, 4.0), (1.0, 2.0)]
    want = [0.0733880, 0.7048328, 0.0021284, 0.0358539, 1.0, 0.4226497]
    assert p_values(spark, cases) == pytest.approx(want, abs=5e-7)


def test_one_formula_for_all_degrees_of_freedom(spark):
    degrees = [1, 2, 3, 4, 9, 30, 100, 999, 1000, 1001, 2500, 100001]
    cases = [(t, float(df)) for t in (0.0, 0.1, 1.0, 1.96, 3.0, 5.0, 40.0, 1e6) for df in degrees]
    assert p_values(spark, cases) == pytest.approx([series_p(*x) for x in cases], abs=1e-11)


def test_p_value_of_a_billion_points_is_the_normal_one(spark):
    cases = [(t, 1e9) for t in (0.5, 1.96, 4.0, 30.0)]
    assert p_values(spark, cases) == pytest.approx([math.erfc(t / math.sqrt(2)) for t, _ in cases], rel=1e-5, abs=1e-12)


def test_fit_against_least_squares(spark):
    rng = random.Random(5)
    data = [(x := rng.uniform(0, 10), 3 * x + rng.gauss(0, 4), -x + rng.gauss(0, 9)) for _ in range(50)]
    rows = spark.createDataFrame(data, "x double, y double, z double").withColumn("k", F.lit(1))
    got = regress(rows, ["k"], "x", {"c_": "y", "e_": "z"}).first()
    x, y, z = np.array(data).T
    for prefix, v in (("c_", y), ("e_", z)):
        slope, intercept = np.polyfit(x, v, 1)
        r = np.corrcoef(x, v)[0, 1]
        stderr = math.sqrt((1 - r * r) * v.var() / x.var() / 48)
        want = [slope, intercept, r, stderr]
        assert [got[prefix + f] for f in ("slope", "intercept", "r", "stderr")] == pytest.approx(want)
        assert got[prefix + "n"] == 50


def test_degenerate_groups(spark):
    data = [
        ("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 4.0),
        *[("flat_x", 0.1, float(i)) for i in range(5)],
        *[("flat_y", float(i), 0.1) for i in range(5)],
        *[("perfect", float(i), 2.0 * i + 1) for i in range(5)],
        *[("null_y", float(i), None) for i in range(5)],
    ]
    rows = spark.createDataFrame(data, "k string, x double, y double")
    got = {r.k: r for r in regress(rows, ["k"], "x", {"": "y"}).collect()}
    assert (got["one"].slope, got["one"].p) == (None, None)
    assert (got["two"].slope, got["two"].p) == (2.0, None)
    assert (got["flat_x"].slope, got["flat_x"].p, got["flat_x"].r) == (None, None, 0.0)
    assert (got["flat_y"].slope, got["flat_y"].p, got["flat_y"].r) == (0.0, 1.0, 0.0)
    assert (got["perfect"].r, got["perfect"].stderr) == (1.0, 0.0)
    assert got["perfect"].p < 1e-9
    assert got["null_y"].n == 0
    assert got["null_y"].p is None


FITS = [
    ("w1", "n1", 1.0, -1.0, True), ("w1", "n2", 1.0, 1.0, True), ("w2", "n1", -1.0, 1.0, True),
    ("w3", "n3", 1.0, -1.0, False),
]
FIT_SCHEMA = "Workflow string, LastRemoteHost string, c_slope double, e_slope double, significant boolean"


def counted(spark, fits):
    rows = spark.createDataFrame(fits, FIT_SCHEMA)
    present = spark.createDataFrame(FITS, FIT_SCHEMA)
    kinds = {"workflow": F.col("Workflow"), "slot": F.col("LastRemoteHost")}
    return effect_counts(rows, present, opposed(), kinds)


def test_effects_count_a_hit_once_per_key_kind(spark):
    shares = {(r.key_kind, r.key): (r.hits, r.total, r.share) for r in effect_shares(counted(spark, FITS)).collect()}
    assert shares == {
        ("workflow", "w1"): (1, 3, pytest.approx(1 / 3)), ("workflow", "w2"): (1, 3, pytest.approx(1 / 3)),
        ("workflow", "w3"): (0, 3, 0.0), ("slot", "n1"): (2, 3, pytest.approx(2 / 3)),
        ("slot", "n2"): (0, 3, 0.0), ("slot", "n3"): (0, 3, 0.0),
        ("overall", "Total"): (4, 3, pytest.approx(4 / 3)),
    }


def test_shares_without_significant_fits_are_null(spark):
    assert {r.share for r in effect_shares(counted(spark, FITS[3:])).collect()} == {None}


def test_data_site_share_counts_groups_once(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (1, "B")], "day int, dest string")
    got = {r.dest: (r.groups, r.share) for r in data_site_share(rows, ["day", "dest"]).collect()}
    assert got == {"A": (2, pytest.approx(2 / 3)), "B": (1, pytest.approx(1 / 3))}
