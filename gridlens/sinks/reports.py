"""Text reports of the regression analyses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.times import day_label

FIT_FIELDS = [
    ("Slope", "slope"),
    ("Intercept", "intercept"),
    ("R Value", "r"),
    ("P Value", "p"),
    ("std err", "stderr"),
]


def _number(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("nan")).otherwise(F.format_string("%.6f", value))


def _fit_lines(prefix: str, x: Column, y: Column | str) -> list[Column]:
    label = prefix.rstrip("_")
    return [
        F.concat(F.lit("X: "), x, F.lit("  Y: "), F.lit(y) if isinstance(y, str) else y),
        *[
            F.concat(F.lit(f"{label}_{title}: "), _number(F.col(prefix + field)))
            for title, field in FIT_FIELDS
        ],
    ]


def report_lines(
    fits: DataFrame, keys: list[str], responses: dict[str, Column | str], x: Column | str = "series"
) -> DataFrame:
    """The text block of every fit: ``keys`` and ``position, line``.

    ``x`` names what the responses (prefix -> label, as text or as a column) were regressed on.
    Sorting by the keys and the position gives the report.
    """
    driver = F.col(x) if isinstance(x, str) else x
    head = [
        day_label(F.col("day")),
        F.concat(F.lit("Workflow: "), F.col("Workflow")),
        F.concat(F.lit("Work site: "), F.col("src")),
        F.concat(F.lit("Data site: "), F.col("dest")),
    ]
    if "LastRemoteHost" in keys:
        head.append(F.concat(F.lit("Slot: "), F.col("LastRemoteHost")))
    body = [line for prefix, y in responses.items() for line in _fit_lines(prefix, driver, y)]
    return fits.select(*keys, F.posexplode(F.array(*head, *body, F.lit(""))).alias("position", "line"))


def side_label(side: str) -> Column:
    """Name of a pooled throughput series' response at one side, e.g. ``meandestPacket``."""
    return F.concat(F.lit(f"mean{side}"), F.regexp_replace("series", "^src", ""))


@dataclass(frozen=True)
class Layout:
    """What the blocks of a report name: the driver (None: the fit's series) and a label per response,
    given as text or made when the report is built."""

    x: str | None
    responses: dict[str, str | Callable[[], Column]]

    def lines(self, fits: DataFrame, keys: list[str]) -> DataFrame:
        labels = {prefix: y() if callable(y) else y for prefix, y in self.responses.items()}
        return report_lines(fits, keys, labels, "series" if self.x is None else F.lit(self.x))


LAYOUTS = {
    "network": Layout("Throughput", {"c_": partial(side_label, "src"), "e_": partial(side_label, "dest")}),
    "overbyte": Layout(None, {"c_": "meanCpuEff", "e_": "meanInputGB"}),
    "scatter": Layout(None, {"c_": "meanCpuEff", "e_": "meanEventRate"}),
    "lumosity": Layout("meanKEvents", {"c_": "meanCpuEff"}),
    "vslumos": Layout("meanLumosity", {"c_": "meanCpuEff", "e_": "meanEventRate"}),
}


def data_site_lines(shares: DataFrame) -> DataFrame:
    """``<site> data location <share>`` for every data site."""
    return shares.select(
        "dest", F.concat(F.col("dest"), F.lit(" data location "), _number(F.col("share"))).alias("line")
    )


def share_lines(shares: DataFrame) -> DataFrame:
    """``<key> occurs <share>`` for every counter."""
    return shares.select(
        "key_kind", "key", F.concat(F.col("key"), F.lit(" occurs "), _number(F.col("share"))).alias("line")
    )


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write a report as text in the given order; parts follow each other by file name."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
