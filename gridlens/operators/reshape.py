"""Wide summary rows to named series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.ratios import zero_fill_pair
from gridlens.schemas import NETWORK_SERIES


def unpivot_series(
    summary: DataFrame, keep: list[str], series: list[str] = NETWORK_SERIES, prefix: str = "mean"
) -> DataFrame:
    """One row per measured network series: ``keep`` columns, ``series``, ``x``."""
    return summary.unpivot(
        keep, [F.col(prefix + s).alias(s) for s in series], "series", "x"
    ).filter(F.col("x").isNotNull())


def union_throughput_sides(summary: DataFrame, keep: list[str]) -> DataFrame:
    """Throughput of either side as ``x`` against both sides' packet loss or latency.

    Rows measured at the work site and rows measured at the data site go into one series
    (``srcPacket`` / ``srcLatency``). A side without a measurement counts as 0.0; a row needs at
    least one of the two sides.
    """
    src_packet, dest_packet = zero_fill_pair(F.col("meansrcPacket"), F.col("meandestPacket"))
    src_latency, dest_latency = zero_fill_pair(F.col("meansrcLatency"), F.col("meandestLatency"))
    observed = F.array(
        *[
            F.struct(
                F.lit(series).alias("series"), x.alias("x"), a.alias("y_src"), b.alias("y_dest")
            )
            for x in (F.col("meansrcThroughput"), F.col("meandestThroughput"))
            for series, a, b in (
                ("srcPacket", src_packet, dest_packet),
                ("srcLatency", src_latency, dest_latency),
            )
        ]
    )
    return summary.select(*keep, F.inline(observed)).filter(
        F.col("x").isNotNull() & F.col("y_src").isNotNull()
    )
