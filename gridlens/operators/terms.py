"""Term buckets, counts and extremes of a single table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_terms(df: DataFrame, field: str, k: int | None = 10) -> DataFrame:
    """Values of ``field`` by row count, the ``k`` largest (ties by value); all of them for ``None``."""
    counts = (
        df.filter(F.col(field).isNotNull())
        .groupBy(F.col(field).alias("term"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if k is None:
        return counts
    return counts.orderBy(F.desc("n"), "term").limit(k)


def max_value(df: DataFrame, field: str) -> DataFrame:
    return df.agg(F.max(field).alias("max_" + field))


def count_matches(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_keys(df: DataFrame, **fields: object) -> DataFrame:
    """Distinct combinations of the named column expressions."""
    return df.select(*[column.alias(name) for name, column in fields.items()]).distinct()
