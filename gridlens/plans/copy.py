"""Bulk copy of a month of daily datasets into one typed store.

The fields a dataset does not declare have the types its records happen to show, and these may differ
from day to day. The types of all days are merged first, so that the copied days are one table.
"""

from __future__ import annotations

from calendar import monthrange
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridlens.sinks.tables import bulk_copy_days
from gridlens.sources.manifest import write_manifest

# Folder names of the daily datasets.
PROBE_DAYS = "network_weather-{0.year}.{0.month}.{0.day}"
JOB_DAYS = "cms-{0.year}-{0.month:02d}-{0.day}"
STORE_DAYS = "day={0:%Y-%m-%d}"

# Number types from narrow to wide; a value fits every later one.
NUMBERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()]


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; text where there is no other."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.FloatType) or isinstance(b, T.FloatType):
        wide = [T.DoubleType() if isinstance(t, T.FloatType) else t for t in (a, b)]
        return merged_type(*wide) if wide[0] != wide[1] else T.DoubleType()
    if a in NUMBERS and b in NUMBERS:
        return max(a, b, key=NUMBERS.index)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged_schema([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType))
    return T.StringType()


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    """All fields of all schemas, each with the merged type of its occurrences."""
    fields: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            fields[f.name] = merged_type(fields[f.name], f.dataType) if f.name in fields else f.dataType
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def whole_schema(found: list[T.StructType], declared: T.StructType) -> T.StructType:
    """Schema of a store: every field of any day, with its declared type if it has one."""
    types = {f.name: f.dataType for f in declared.fields}
    fields = merged_schema(found).fields
    return T.StructType([T.StructField(f.name, types.get(f.name, f.dataType)) for f in fields if f.name != "day"])


def copy_month(
    spark: SparkSession,
    source: str,
    target: str,
    year: int,
    month: int,
    schema: T.StructType,
    names: str = STORE_DAYS,
    fmt: str = "parquet",
    at_once: int = 4,
) -> DataFrame:
    """Copy every day of a month from ``source`` into the day-partitioned store ``target``.

    ``names`` gives a day's folder name. All fields of the records are kept; ``schema`` declares the
    types of the known ones. Returns the status of every day.
    """
    days = [date(year, month, d).isoformat() for d in range(1, monthrange(year, month)[1] + 1)]

    def path(day: str) -> str:
        return f"{source}/{names.format(date.fromisoformat(day))}"

    def found(day: str) -> T.StructType | None:
        try:
            return spark.read.format(fmt).load(path(day)).schema
        except Exception:  # noqa: BLE001 - the copy of the day reports it
            return None

    with ThreadPoolExecutor(at_once) as pool:
        schemas = [s for s in pool.map(found, days) if s is not None]
    whole = whole_schema(schemas, schema)

    def read_day(day: str) -> DataFrame:
        reader = spark.read.schema(whole) if fmt == "json" else spark.read
        return reader.format(fmt).load(path(day))

    status = bulk_copy_days(spark, days, read_day, target, whole, at_once)
    if schemas:
        write_manifest(spark, target)
    return status
