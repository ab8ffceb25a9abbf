"""Job, probe and site views over the TPC-H-like test tables.

The expressions are plain SQL that Spark and DuckDB read alike; the checks use the same texts.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.operators.joins import sized
from gridlens.plans.summary import build_summary
from gridlens.session import shared_dir, tune
from gridlens.sinks.tables import append_summary, write_store
from gridlens.sources.sites import write_sites
from gridlens.sources.stores import read_jobs, read_probes, read_summary

_STAGING = threading.RLock()
_WRITTEN: set[str] = set()

# The period the test tables cover.
PERIOD = (1704067200, 1706659199)

START = "1704067200+(l_orderkey*7919+l_linenumber*104729)%2505600"

JOB_COLUMNS = {
    "JobId": "l_orderkey*10+l_linenumber",
    "CMS_JobType": "case when l_returnflag='R' then 'Analysis' else 'Processing' end",
    "Status": "case when l_partkey%10=0 then 'Removed' else 'Completed' end",
    "TaskType": "case o_orderpriority when '1-URGENT' then 'DIGIRECO' when '2-HIGH' then 'RECO'"
    " when '3-MEDIUM' then 'DIGI' when '5-LOW' then 'gensim' else 'DataProcessing' end",
    "Site": "concat('T2_SITE_',s_nationkey%5)",
    "DataLocation0": "concat('T2_SITE_',c_nationkey%5)",
    "DataLocationsCount": "case when l_orderkey%7=0 then 2 else 1 end",
    "InputData": "case when s_nationkey%5=c_nationkey%5 then 'Onsite' else 'Offsite' end",
    "Workflow": "concat('wf_',l_partkey%3)",
    "LastRemoteHost": "case when l_suppkey%11=0 then null else"
    " concat('slot1@glidein_',l_linenumber,'@node',l_suppkey%2) end",
    "JobCurrentStartDate": START,
    "JobFinishedHookDone": START + "+cast(l_quantity as bigint)*600",
    "CompletionDate": START + "+cast(l_quantity as bigint)*600+l_linenumber%3*43200",
    "CpuEff": "100*(1-l_discount)*(1-l_tax)",
    "ChirpCMSSWEventRate": "case when l_partkey%13=0 then null else l_extendedprice/l_quantity/100 end",
    "EventRate": "l_extendedprice/l_quantity/100-10",
    "CpuTimeHr": "l_quantity/6*(1-l_discount)",
    "WallClockHr": "l_quantity/6",
    "RequestCpus": "cast(1+l_linenumber%8 as double)",
    "MemoryMB": "p_retailprice",
    "RequestMemory": "p_retailprice*2",
    "QueueHrs": "l_tax*10",
    "CoreHr": "l_quantity/6*(1+l_linenumber%8)",
    "CpuBadput": "l_quantity/6*l_discount",
    "KEvents": "case when l_linenumber=1 then 0e0 else cast(floor(l_extendedprice/100) as double) end",
    "InputGB": "case when l_suppkey%17=0 then null else o_totalprice/1000 end",
    "CMSSWKLumis": "case when l_partkey%19=0 then null else l_extendedprice/5000 end",
    "ReadTimeMins": "l_tax*60",
    "DiskUsage": "l_extendedprice",
    "BytesRecvd": "o_totalprice*1000",
}

JOB_TABLES = (
    ("orders", "l_orderkey", "o_orderkey"),
    ("customer", "o_custkey", "c_custkey"),
    ("supplier", "l_suppkey", "s_suppkey"),
    ("part", "l_partkey", "p_partkey"),
)

DEST_GROUP = "cast(floor(user_id/4e0) as bigint)%4"

PROBE_COLUMNS = {
    "event_id": "event_id",
    "mtype": "case event_type when 'click' then 'throughput' when 'purchase' then 'packet_loss_rate'"
    " when 'view' then 'latency' when 'signup' then 'traceroute' else 'throughput' end",
    "src": "concat('ps',user_id%4)",
    "dest": f"concat('pd',{DEST_GROUP})",
    "srcSite": "case when event_type='error' then null else concat('GRID_',user_id%4) end",
    "destSite": f"case when event_type='error' then null else concat('GRID_',{DEST_GROUP}) end",
    "MA": "case when event_id%97=0 then 'other' when event_id%2=0 then concat('ps',user_id%4)"
    f" else concat('pd',{DEST_GROUP}) end",
    "throughput": "case when event_type in ('click','error') then value end",
    "packet_loss": "case when event_type='purchase' then value end",
    "delay_mean": "case when event_type='view' then value end",
    "delay_median": "case when event_type='view' then value*0.9e0 end",
    "delay_sd": "case when event_type='view' then value*0.1e0 end",
}

SITE_COLUMNS = {
    "cms_site": "concat('t2_site_',r_regionkey)",
    "grid_site": "concat('GRID_',r_regionkey)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*_columns(columns))


def _columns(columns: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in columns.items()]


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined rows that :func:`job_columns` are computed from. Customers are joined to the orders,
    which are fewer than the line items. Orders grow with these and are never sent whole."""
    tables = {name: table(spark, sf_dir, name) for name, _, _ in JOB_TABLES}
    on = {name: F.col(left) == F.col(right) for name, left, right in JOB_TABLES}
    bought = tables["orders"].join(sized(tables["customer"]), on["customer"])
    joined = table(spark, sf_dir, "lineitem").join(bought.hint("merge"), on["orders"])
    return joined.join(sized(tables["supplier"]), on["supplier"]).join(sized(tables["part"]), on["part"])


def job_columns() -> list[Column]:
    location, count = (F.expr(JOB_COLUMNS[c]) for c in ("DataLocation0", "DataLocationsCount"))
    locations = F.when(count == 2, F.array(location, F.lit("T2_SITE_9"))).otherwise(F.array(location))
    return [*_columns(JOB_COLUMNS), locations.alias("DataLocations")]


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_rows(spark, sf_dir).select(*job_columns())


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    seconds = {**PROBE_COLUMNS, "ts_s": "unix_timestamp(ts)"}
    return _select(events, seconds).withColumn("timestamp_ms", F.col("ts_s") * 1000)


def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "region").filter("r_regionkey < 4"), SITE_COLUMNS)


def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_map(spark, sf_dir).select("cms_site")


def site_documents(spark: SparkSession, sf_dir: str) -> str:
    """Folder with two versions of the site documents; the older one names every region's site."""

    def write(path: str) -> None:
        every = _select(table(spark, sf_dir, "region"), SITE_COLUMNS)
        write_sites(every.withColumn("grid_site", F.concat(F.lit("OLD_"), "grid_site")), path, "2023-01-01")
        write_sites(site_map(spark, sf_dir), path, "2024-01-01")

    return staged(spark, sf_dir, "sites", write)


def staged(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a derived table, written once per application and test directory."""
    app = spark.sparkContext.applicationId
    key = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    path = f"{shared_dir(spark)}/gridlens/{app}/{key}/{name}"
    with _STAGING:
        if path not in _WRITTEN:
            write(path)
            _WRITTEN.add(path)
    return path


def job_store(
    spark: SparkSession, sf_dir: str, period: tuple | None = None, column: str = "JobFinishedHookDone"
) -> DataFrame:
    """The job view as a stored table, by the day a job was finished. ``CompletionDate`` may lie on
    another day; a period on either column finds its folders."""

    def write(path: str) -> None:
        day = F.timestamp_seconds(F.expr(JOB_COLUMNS["JobFinishedHookDone"])).cast("date")
        rows = job_rows(spark, sf_dir).withColumn("day", day)
        write_store(rows, path, ["day"], [*job_columns(), F.col("day")])

    return read_jobs(tune(spark), staged(spark, sf_dir, "jobs", write), period, column=column)


def probe_store(spark: SparkSession, sf_dir: str, period: tuple | None = None) -> DataFrame:
    """The probe view as a stored table, by type and day."""

    def write(path: str) -> None:
        day = F.timestamp_seconds("ts_s").cast("date")
        write_store(probes(spark, sf_dir).withColumn("day", day), path, ["mtype", "day"])

    return read_probes(tune(spark), staged(spark, sf_dir, "probes", write), period=period)


def summary(spark: SparkSession, sf_dir: str, **limits: int) -> DataFrame:
    """The summary built from the stores."""
    return build_summary(
        job_store(spark, sf_dir, PERIOD),
        probe_store(spark, sf_dir, PERIOD),
        allowlist(spark, sf_dir),
        site_map(spark, sf_dir),
        PERIOD,
        **limits,
    )


def net_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as a stored table, for the analyses that read it."""

    def write(path: str) -> None:
        append_summary(summary(spark, sf_dir), path)

    return read_summary(tune(spark), staged(spark, sf_dir, "net_health", write))


def probe_day_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder with one probe dataset per day."""

    def write(path: str) -> None:
        stamp = F.timestamp_seconds("ts_s")
        dated = probes(spark, sf_dir).withColumn("timestamp", stamp).withColumn("day", stamp.cast("date"))
        write_store(dated, path, ["day"])

    return staged(spark, sf_dir, "probe_days", write)
