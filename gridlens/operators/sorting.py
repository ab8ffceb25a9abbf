"""Orders of the reports. Global orders range-partition; group orders only sort inside partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_by_time(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Oldest first. Rows of one time follow ``ties``, which also spread them over the tasks."""
    return df.orderBy(column, *ties)


def sort_latest_first(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Latest first, rows of one time by ``ties``."""
    return df.orderBy(F.desc(column), *ties)


def sort_in_groups(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows ordered by group, then time. Range partitions split a large group instead of holding it whole."""
    return df.repartitionByRange(*keys, column).sortWithinPartitions(*keys, column)
