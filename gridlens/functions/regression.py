"""Linear regression of y on x from grouped moments, with the two-sided p-value of the slope.

Everything is built from mergeable aggregates, so groups are combined map-side and a large group
is never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spread below this share of the mean square is rounding noise of equal values.
FLAT = 1e-24
# A correlation this close to one is a perfect fit up to rounding.
PERFECT = 1e-12
# Keeps the t statistic finite for a perfect fit.
TINY = 1e-20
# Half width, in standard deviations, beyond which a density of many degrees of freedom is below 1e-31;
# with few degrees the whole half circle is narrower.
SPREAD = 12.0
# Nodes of the quadrature: 13 digits over the whole half width.
NODES = 28


def moments(y: Column, x: Column, prefix: str = "") -> list[Column]:
    """Aggregates a regression needs; rows where either value is NULL are skipped."""
    return [
        F.regr_count(y, x).alias(prefix + "n"),
        F.regr_avgx(y, x).alias(prefix + "avgx"),
        F.regr_avgy(y, x).alias(prefix + "avgy"),
        F.regr_sxx(y, x).alias(prefix + "sxx"),
        F.regr_syy(y, x).alias(prefix + "syy"),
        F.regr_sxy(y, x).alias(prefix + "sxy"),
    ]


def fit(sums: DataFrame, prefixes: list[str]) -> DataFrame:
    """Add slope, intercept, r, p and stderr per prefix to the columns of :func:`moments`.

    A constant x gives no slope and no p-value, fewer than three points give no p-value, a
    constant y gives slope 0, r 0 and p 1. Shared terms become columns step by step, so that the
    sum behind a p-value reads them instead of evaluating them once per term.
    """

    def step(df: DataFrame, build: Callable[[Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
        added = [
            column.alias(prefix + name)
            for prefix in prefixes
            for name, column in build(lambda c, p=prefix: F.col(p + c)).items()
        ]
        return df.select("*", *added)

    flat = step(sums, _flatness)
    lines = step(flat, _line)
    tests = step(lines, _statistic)
    angles = step(tests, _angle)
    return step(angles, _results)


def _flatness(c: Callable[[str], Column]) -> dict[str, Column]:
    return {
        "flat_x": c("sxx") <= F.lit(FLAT) * c("n") * c("avgx") * c("avgx"),
        "flat_y": c("syy") <= F.lit(FLAT) * c("n") * c("avgy") * c("avgy"),
        "raw_r": F.try_divide(c("sxy"), F.sqrt(c("sxx") * c("syy"))),
    }


def _line(c: Callable[[str], Column]) -> dict[str, Column]:
    return {
        "slope": F.when(~c("flat_x"), F.when(c("flat_y"), F.lit(0.0)).otherwise(c("sxy") / c("sxx"))),
        "r": F.when(c("flat_x") | c("flat_y"), F.lit(0.0))
        .when(F.abs(c("raw_r")) > 1 - PERFECT, F.signum(c("raw_r")))
        .otherwise(c("raw_r")),
        "df": F.when(~c("flat_x") & (c("n") > 2), c("n") - 2).cast("double"),
    }


def _statistic(c: Callable[[str], Column]) -> dict[str, Column]:
    r = c("r")
    return {"t": F.abs(r) * F.sqrt(c("df") / ((1 - r + F.lit(TINY)) * (1 + r + F.lit(TINY))))}


def _angle(c: Callable[[str], Column]) -> dict[str, Column]:
    """Where the statistic lies on the half circle, and where the density ends."""
    root = F.sqrt(c("df"))
    end = F.least(F.lit(math.pi / 2), F.lit(SPREAD) / root)
    return {"end": end, "angle": F.least(F.atan(c("t") / root), end)}


def _results(c: Callable[[str], Column]) -> dict[str, Column]:
    r = c("r")
    outside = _area(c("angle"), c("end"), c("df")) / _area(F.lit(0.0), c("end"), c("df"))
    return {
        "intercept": c("avgy") - c("slope") * c("avgx"),
        "p": F.when(c("df").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), outside))),
        "stderr": F.sqrt(F.try_divide((1 - r * r) * c("syy"), c("sxx")) / c("df")),
    }


def _area(low: Column, high: Column, df: Column) -> Column:
    """Integral of cos(angle)^(df - 1) by Gauss-Legendre quadrature.

    With the angle atan(t / sqrt(df)) this is the density of t up to a constant, for every number of
    degrees of freedom; the ratio of two such areas is the regularised incomplete beta function
    I(df / (df + t^2); df / 2, 1 / 2), which is the two-sided p-value. The logarithm of the cosine is
    taken from the sine, which keeps its digits at small angles.
    """
    points, weights = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*[
        F.struct(F.lit(float((x + 1) / 2)).alias("at"), F.lit(float(w)).alias("weight"))
        for x, w in zip(points, weights, strict=True)
    ])

    def add(total: Column, node: Column) -> Column:
        sine = F.sin(low + (high - low) * node["at"])
        log_cosine = F.greatest(F.log1p(-sine * sine) / 2, F.lit(-700.0))
        return total + node["weight"] * F.exp((df - 1) * log_cosine)

    return F.aggregate(nodes, F.lit(0.0), add) * (high - low) / 2
