"""Least and greatest times of every day folder of a store, written beside the data.

A day folder is named after one time of its records; others may lie on other days. A range on any
time column is turned into the folders that can hold it by the bounds kept here, so the scan lists
and reads these alone. Only folders the manifest proves to lie outside are left out: a folder it does
not know, or a time column it does not hold, is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.times import epoch_seconds
from gridlens.schemas import TIME_COLUMNS

# Names that begin with an underscore are no data to Spark's readers.
FOLDER = "_times"
SCHEMA = "day string, column string, low bigint, high bigint"


def write_manifest(spark: SparkSession, path: str, columns: Sequence[str] = TIME_COLUMNS, fmt: str = "parquet") -> None:
    """Read the bounds of the store's time columns (epoch seconds) and replace its manifest.

    A day without any value of a column has empty bounds and matches no range.
    """
    table = spark.read.format(fmt).load(path)
    if "timestamp" in table.columns and "ts_s" not in table.columns:
        table = table.withColumn("ts_s", epoch_seconds(F.col("timestamp"), table.schema["timestamp"].dataType))
    held = [c for c in columns if c in table.columns]
    if "day" not in table.columns or not held:
        return
    bounds = [f(F.col(c).cast("bigint")).alias(f"{end}_{c}") for c in held for end, f in (("low", F.min), ("high", F.max))]
    by_day = table.groupBy(F.col("day").cast("string").alias("day")).agg(*bounds)
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in held])
    by_day.select("day", F.inline(listed)).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{FOLDER}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of a store, or None if it has none."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/{FOLDER}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def days_in_range(spark: SparkSession, path: str, column: str, low: int, high: int) -> Column:
    """Partition filter on ``day``: the folders that may hold values of ``column`` strictly between
    ``low`` and ``high``. One row per day folder comes to the driver, as in a file listing."""
    known = read_manifest(spark, path)
    if known is None:
        return F.lit(True)
    touches = F.coalesce((F.col("low") < high) & (F.col("high") > low), F.lit(False))
    outside = [r.day for r in known.filter((F.col("column") == column) & ~touches).select("day").collect()]
    return ~F.col("day").isin([F.lit(d).cast("date") for d in sorted(outside)]) if outside else F.lit(True)
