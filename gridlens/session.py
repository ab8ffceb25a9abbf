"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # All time columns are UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets the summary join probes on (src, dest, bucket, window) while both sides stay
    # hash-partitioned on (src, dest, bucket): wide summary rows are not shuffled again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings the plans are written for."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written tables: ``spark.checkpoint.dir``, else a folder in the session's warehouse.

    On a cluster the setting is required: the default warehouse is a folder of one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/gridlens_stages"
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in the folder every executor shares."""
    return f"{shared_dir(spark)}/gridlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read back: later plans read this table instead of repeating the
    work before it, also when an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
