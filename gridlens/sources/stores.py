"""Parquet stores of job records, probes and the summary, with pruned scans.

A store is a folder of Parquet files partitioned the way the analyses select: jobs by ``day``,
probes by ``mtype`` and ``day``, the summary by ``task_type`` and ``day``. Types and the days a time
range can touch are partition filters, everything else is pushed to the file scan. Which days those
are follows from the time column the range is set on, see :mod:`gridlens.sources.manifest`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.times import epoch_millis, epoch_seconds, to_period, touched_dates
from gridlens.sources.manifest import days_in_range


def read_jobs(
    spark: SparkSession, path: str, period: tuple | None = None, fmt: str = "parquet", column: str = "JobFinishedHookDone"
) -> DataFrame:
    """Job records of a day-partitioned store; with a ``period`` only from the day folders that may
    hold a ``column`` inside it. Filter on the same column for the exact range."""
    return _days(spark, _read(spark, path, fmt), path, period, column)


def read_probes(
    spark: SparkSession, path: str, mtype: str | None = None, period: tuple | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Probes of one or all types; with a ``period`` only from the day folders that may hold it."""
    probes = _read(spark, path, fmt)
    if mtype is not None:
        probes = probes.filter(F.col("mtype") == mtype)
    return _days(spark, probes, path, period, "ts_s")


def with_probe_time(probes: DataFrame) -> DataFrame:
    """Add ``ts_s`` and ``timestamp_ms`` from ``timestamp``, given as text, epoch ms or timestamp."""
    kind, stamp = probes.schema["timestamp"].dataType, F.col("timestamp")
    return probes.withColumns({"ts_s": epoch_seconds(stamp, kind), "timestamp_ms": epoch_millis(stamp, kind)})


def all_probes(current: DataFrame, older: DataFrame) -> DataFrame:
    """Both probe generations as one table."""
    return current.unionByName(with_probe_time(older), allowMissingColumns=True)


def read_summary(
    spark: SparkSession, path: str, task: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """The summary table; with a declared ``schema`` also while it is empty."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    summary = reader.parquet(path)
    return summary if task is None else summary.filter(F.col("task_type") == task)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents as JSON lines, read with the declared schema; absent fields are NULL."""
    return spark.read.schema(schema).json(path)


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.format(fmt).load(path)


def _days(spark: SparkSession, df: DataFrame, path: str, period: tuple | None, column: str) -> DataFrame:
    if period is None or "day" not in df.columns:
        return df
    if column not in df.columns and "timestamp" not in df.columns:  # the folder's day is the only time
        return df.filter(touched_dates(F.col("day"), *to_period(period)))
    return df.filter(days_in_range(spark, path, column, *to_period(period)))
