"""Schemas, metric lists and the named constants of the analyses."""

from __future__ import annotations

from pyspark.sql import types as T

# Parameters every analysis shares.
WINDOW_STEP = 600
PROBE_VALIDITY = 4 * 3600
DAY = 86400
EVENT_BUCKET = 50
SIGNIFICANCE = 0.05
TASK_TYPES = ["DIGIRECO", "RECO", "DIGI", "DataProcessing"]
PLOT_TASK_TYPES = ["RECO", "DIGIRECO"]
REGRESSION_TASK = "DIGIRECO"
UNKNOWN_HOST = "Unknown"

# Default periods (UTC, ISO text).
SUMMARY_PERIOD = ("2017-02-01T00:00:00", "2017-02-28T23:59:59")
REGRESSION_PERIOD = ("2017-02-14T00:00:00", "2017-02-15T00:00:00")
SCATTER_PERIOD = ("2016-07-17T00:00:00", "2016-07-25T00:00:00")
TASK_SCATTER_PERIOD = ("2017-02-01T00:00:00", "2017-02-09T00:00:00")

# Metric names of the summary table, in the order they are documented.
JOB_METRICS = [
    "CpuEff", "EventRate", "CpuTimeHr", "WallClockHr", "RequestCpus", "MemoryMB", "QueueHrs",
    "CoreHr", "CpuBadput", "InputGB", "Lumosity", "KEvents", "CMSSWKLumis", "ReadTimeMins",
]
OPTIONAL_JOB_METRICS = ["DiskUsage", "BytesRecvd"]
NETWORK_SERIES = [
    "srcThroughput", "destThroughput", "srcPacket", "destPacket", "srcLatency", "destLatency",
]
STATS = ["min", "mean", "max", "median", "std"]

# Time columns a range may be set on, in epoch seconds.
TIME_COLUMNS = ["JobCurrentStartDate", "JobFinishedHookDone", "CompletionDate", "ts_s"]

# Probe type -> (series suffix, value column).
PROBE_TYPES = {
    "throughput": ("Throughput", "throughput"),
    "packet_loss_rate": ("Packet", "packet_loss"),
    "latency": ("Latency", "delay_mean"),
}

# Summary metric -> source column on a job, where the names differ.
JOB_METRIC_SOURCE = {"EventRate": "ChirpCMSSWEventRate"}

JOBS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("CMS_JobType", "Status", "TaskType", "Site", "InputData")]
    + [
        T.StructField("DataLocationsCount", T.IntegerType()),
        T.StructField("DataLocations", T.ArrayType(T.StringType())),
        T.StructField("Workflow", T.StringType()),
        T.StructField("LastRemoteHost", T.StringType()),
    ]
    + [
        T.StructField(c, T.LongType())
        for c in ("JobCurrentStartDate", "JobFinishedHookDone", "CompletionDate")
    ]
    + [
        T.StructField(c, T.DoubleType())
        for c in (
            "CpuEff", "ChirpCMSSWEventRate", "EventRate", "CpuTimeHr", "WallClockHr", "RequestCpus",
            "MemoryMB", "RequestMemory", "QueueHrs", "CoreHr", "CpuBadput", "KEvents", "InputGB",
            "CMSSWKLumis", "ReadTimeMins", "DiskUsage", "BytesRecvd",
        )
    ]
)

PROBES = T.StructType(
    [
        T.StructField("mtype", T.StringType()),
        T.StructField("MA", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("dest", T.StringType()),
        T.StructField("srcSite", T.StringType()),
        T.StructField("destSite", T.StringType()),
        T.StructField("srcVO", T.StringType()),
        T.StructField("destVO", T.StringType()),
        T.StructField("srcProduction", T.BooleanType()),
        T.StructField("destProduction", T.BooleanType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("throughput", T.DoubleType()),
        T.StructField("delay_mean", T.DoubleType()),
        T.StructField("delay_median", T.DoubleType()),
        T.StructField("delay_sd", T.DoubleType()),
        T.StructField("packet_loss", T.DoubleType()),
        T.StructField("hash", T.LongType()),
        T.StructField("hops", T.ArrayType(T.StringType())),
        T.StructField("rtts", T.ArrayType(T.DoubleType())),
        T.StructField("ttls", T.ArrayType(T.IntegerType())),
    ]
)


def stat_columns(metrics: list[str]) -> list[str]:
    return [stat + metric for metric in metrics for stat in STATS]


def summary_schema(job_metrics: list[str] | None = None) -> T.StructType:
    """Schema of the ``net_health`` table; network statistics are NULL when no probe covers the window."""
    metrics = (job_metrics or JOB_METRICS) + NETWORK_SERIES
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in ("src", "dest", "Workflow", "LastRemoteHost")]
        + [T.StructField(c, T.LongType()) for c in ("beginDate", "endDate")]
        + [T.StructField(c, T.DoubleType()) for c in stat_columns(metrics)]
        + [T.StructField("task_type", T.StringType()), T.StructField("day", T.DateType())]
    )
