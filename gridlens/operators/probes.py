"""Which side took a probe, and probes taken by neither."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probe_side(agent: Column, src: Column, dest: Column) -> Column:
    """``src`` or ``dest``; the source is tested first. NULL when the agent is neither."""
    return F.when(agent == src, F.lit("src")).when(agent == dest, F.lit("dest"))


def with_side(probes: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``side``. Probes of a foreign agent are dropped, or fail the job when ``strict``."""
    side = probe_side(F.col("MA"), F.col("src"), F.col("dest"))
    if strict:
        return probes.withColumn(
            "side", F.coalesce(side, F.raise_error(F.lit("MA is neither src nor dest")).cast("string"))
        )
    return probes.withColumn("side", side).filter(F.col("side").isNotNull())


def quarantine(probes: DataFrame) -> DataFrame:
    """The probes :func:`with_side` drops."""
    return probes.filter(probe_side(F.col("MA"), F.col("src"), F.col("dest")).isNull())
