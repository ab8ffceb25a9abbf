"""Day folders found from the range on any time column, and the files a plan opens."""

import re

from pyspark.sql import functions as F

from gridlens.catalog import queries
from gridlens.operators.filters import in_period
from gridlens.schemas import DAY
from gridlens.sinks.tables import append_summary, write_store
from gridlens.sources import manifest, stores

SF = "/root/testdata/sf0.001"


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]


def days_read(df):
    """Day folders whose files the scans of the plan open."""
    paths = []
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    for i in range(leaves.size()):
        paths += [f.filePath().toString() for f in leaves.apply(i).selectedPartitions().toPartitionArray()]
    return {x for f in paths for x in re.findall(r"day=(\d{4}-\d\d-\d\d)", f)}


def store(spark, path):
    """Ten days of jobs, each finished at noon of its folder's day and completed up to three days later."""
    noon = (F.col("id") % 10) * DAY + DAY // 2
    rows = spark.range(200).select(
        "id", noon.alias("JobFinishedHookDone"), (noon + F.col("id") % 4 * DAY).alias("CompletionDate"), noon.alias("at"),
    )
    rows = rows.withColumn("day", F.timestamp_seconds("JobFinishedHookDone").cast("date"))
    write_store(rows, path, ["day"])
    return rows


def test_a_record_whose_dates_differ_is_kept(spark, tmp_path):
    path = str(tmp_path / "jobs")
    rows = store(spark, path)
    period = (6 * DAY, 7 * DAY)
    found = stores.read_jobs(spark, path, period, column="CompletionDate").filter(in_period(F.col("CompletionDate"), period))
    want = rows.filter(in_period(F.col("CompletionDate"), period))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())
    # Jobs of the folders 03 to 06 can be completed on the 7th day.
    assert days_read(found) == {f"1970-01-0{d}" for d in (4, 5, 6, 7)}
    same = stores.read_jobs(spark, path, period)
    assert days_read(same) == {"1970-01-07"} and "day" in partition_filters(same)[0]


def test_bounds_are_open(spark, tmp_path):
    path = str(tmp_path / "jobs")
    store(spark, path)
    noon = 3 * DAY + DAY // 2
    assert stores.read_jobs(spark, path, (noon, noon + DAY)).isEmpty()
    assert days_read(stores.read_jobs(spark, path, (noon - 1, noon + 1))) == {"1970-01-04"}


def test_unknown_folders_and_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "jobs")
    rows = store(spark, path)
    late = rows.filter("id < 3").withColumn("day", F.lit("1971-01-01").cast("date"))
    late.write.mode("append").partitionBy("day").parquet(path)
    period = (6 * DAY, 7 * DAY)
    assert days_read(stores.read_jobs(spark, path, period)) == {"1970-01-07", "1971-01-01"}
    assert len(days_read(stores.read_jobs(spark, path, period, column="at"))) == 11
    bare = str(tmp_path / "bare")
    rows.write.partitionBy("day").parquet(bare)
    assert len(days_read(stores.read_jobs(spark, bare, period))) == 10


def test_days_without_values_and_probe_times(spark, tmp_path):
    path = str(tmp_path / "probes")
    stamps = spark.range(6).select(
        F.when(F.col("id") != 2, F.timestamp_seconds(F.col("id") * DAY + 5)).alias("timestamp"), F.lit("latency").alias("mtype"),
        F.date_from_unix_date(F.col("id").cast("int")).alias("day"),
    )
    write_store(stamps, path, ["mtype", "day"])
    known = {r.day: (r.low, r.high) for r in manifest.read_manifest(spark, path).collect()}
    assert known["1970-01-03"] == (None, None) and known["1970-01-05"] == (4 * DAY + 5, 4 * DAY + 5)
    assert days_read(stores.read_probes(spark, path, "latency", (0, 4 * DAY))) == {f"1970-01-0{d}" for d in (1, 2, 4)}


def test_registered_ranges_prune_days(spark):
    first, last = "2024-01-06", "2024-01-21"
    for name in ("filter_time_range", "filter_probe_range", "filter_completion_range", "filter_day_slice"):
        df = queries.QUERIES[name](spark, SF)
        assert any("day" in x for x in partition_filters(df)), name
        days = days_read(df)
        assert days and max(days) <= last, name
        assert min(days) >= ("2024-01-05" if name == "filter_completion_range" else first), name


def test_day_slice_opens_its_days_only(spark, tmp_path):
    path = str(tmp_path / "net_health")
    rows = spark.range(0, 10 * DAY, 600).select(
        F.col("id").alias("beginDate"), F.lit("RECO").alias("task_type"), F.timestamp_seconds("id").cast("date").alias("day")
    )
    append_summary(rows.repartition(37), path)
    files = spark.read.parquet(path).inputFiles()
    assert len(files) == 10  # one small file per folder, not one per task
    sliced = queries.regressions.day_slices(stores.read_summary(spark, path), (2 * DAY, 3 * DAY))
    assert days_read(sliced) == {"1970-01-03", "1970-01-04"}
    assert sliced.count() == 2 * 143
