"""Writers of the stores."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.schemas import summary_schema
from gridlens.sources.manifest import write_manifest


def append_summary(summary: DataFrame, path: str, by: Sequence[str] = ("task_type", "day")) -> None:
    """Append summary rows, one folder per task type and day.

    The rows are gathered by folder into files of even size, so the files of a folder follow from its
    rows and not from the tasks of the build; a large folder is written by several tasks. A slice of
    days lists and reads its own folders alone, and time is in order inside a file.
    """
    gathered = summary.hint("rebalance", *by).sortWithinPartitions(*by, "beginDate")
    gathered.write.mode("append").partitionBy(*by).parquet(path)


def reset_summary(spark: SparkSession, path: str, schema: T.StructType | None = None) -> None:
    """Drop the summary's content and recreate it empty with its declared schema."""
    empty = spark.createDataFrame([], schema or summary_schema())
    empty.write.mode("overwrite").partitionBy("task_type", "day").parquet(path)


def write_store(df: DataFrame, path: str, by: list[str], derived: Sequence[Column] = ("*",)) -> None:
    """Replace a store and its manifest. Rows of a partition are gathered into files of even size; a
    large day is spread over several tasks. The store's columns, ``by`` among them, may be ``derived``
    from the rows: they are computed where the rows are written, so only the rows' own columns move."""
    gathered = df.hint("rebalance", *by).sortWithinPartitions(*by)
    gathered.select(*derived).write.mode("overwrite").partitionBy(*by).parquet(path)
    write_manifest(df.sparkSession, path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns and types of a declared schema; absent columns are NULL, others are dropped."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def replace_folder(spark: SparkSession, written: str, final: str) -> None:
    """Put a written folder in the place of another. The old content is moved aside, and back again
    if the new one cannot take its place."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, place = path(written), path(final)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = path(f"{written}.old")
    files.mkdirs(place.getParent())
    had = files.exists(place)
    if had and not files.rename(place, aside):
        raise OSError(f"{final} cannot be moved aside")
    if not files.rename(new, place):
        if had:
            files.rename(aside, place)
        raise OSError(f"{final} cannot be replaced")
    if had:
        files.delete(aside, True)


def bulk_copy_days(
    spark: SparkSession,
    days: Iterable[str],
    read_day: Callable[[str], DataFrame],
    target: str,
    schema: T.StructType | None = None,
    at_once: int = 4,
) -> DataFrame:
    """Copy daily datasets into ``target``, replacing each day's folder.

    Records arrive whole, with every column and value as stored; with a ``schema`` they are brought to
    its columns and types. A day is written beside the store and then takes the old folder's place, so
    a day that fails keeps its old content; it is reported and does not stop the others. Every day is
    one distributed job; only the status rows ``(day, ok, rows, error)`` come back.
    """

    def copy(day: str) -> tuple[str, bool, int, str | None]:
        seen = Observation()
        written = f"{target.rstrip('/')}/_copy-{uuid.uuid4().hex}"
        try:
            records = read_day(day)
            kept = records if schema is None else conform(records, schema)
            kept.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(written)
            replace_folder(spark, written, f"{target.rstrip('/')}/day={day}")
        except Exception as error:  # noqa: BLE001 - any failure of a day is its status
            return day, False, 0, (str(error).splitlines() or [type(error).__name__])[0]
        return day, True, seen.get["rows"], None

    with ThreadPoolExecutor(at_once) as pool:
        status = list(pool.map(copy, days))
    return spark.createDataFrame(status, "day string, ok boolean, rows bigint, error string")


def write_points(points: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """Chart points, one folder per page key."""
    points.write.mode("overwrite").format(fmt).partitionBy(*by).save(path)
