import json

import pytest
from pyspark.sql import functions as F

from gridlens.plans.copy import copy_month
from gridlens.schemas import JOB_METRICS, JOBS, PROBES, stat_columns, summary_schema
from gridlens.sinks.reports import report_lines, write_lines
from gridlens.sinks.tables import (
    append_summary,
    bulk_copy_days,
    conform,
    reset_summary,
    write_points,
    write_store,
)
from gridlens.sources import sites, stores


def test_site_files(spark, tmp_path):
    (tmp_path / "allowed_sites.json").write_text(json.dumps({"locations": ["t1_a", "t2_b"]}, indent=2))
    (tmp_path / "site_names.json").write_text(json.dumps({"t1_a": "GA", "t2_b": "GB"}, indent=2))
    allowed = sites.read_allowlist(spark, str(tmp_path / "allowed_sites.json")).collect()
    assert sorted(r.cms_site for r in allowed) == ["t1_a", "t2_b"]
    mapped = sites.read_site_map(spark, str(tmp_path / "site_names.json")).collect()
    assert sorted(map(tuple, mapped)) == [("t1_a", "GA"), ("t2_b", "GB")]
    assert sites.default_site_map(spark).count() == 35


def test_json_jobs_with_absent_fields(spark, tmp_path):
    (tmp_path / "jobs.json").write_text('{"Site": "T1_A", "KEvents": 2, "DataLocations": ["X"]}\n{"Site": "T2_B"}\n')
    rows = {r.Site: r for r in stores.read_json(spark, str(tmp_path / "jobs.json"), JOBS).collect()}
    assert rows["T1_A"].KEvents == 2.0
    assert rows["T2_B"].DataLocations is None


def days(spark):
    return spark.createDataFrame(
        [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)], "day string, v int"
    ).withColumn("day", F.col("day").cast("date"))


def test_job_store_prunes_days(spark, tmp_path):
    path = str(tmp_path / "jobs")
    write_store(days(spark), path, ["day"])
    period = ("2024-01-02T00:00:00", "2024-01-02T23:59:59")
    found = stores.read_jobs(spark, path, period)
    assert [r.v for r in found.collect()] == [2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(found.inputFiles()) >= 1


def test_probe_generations_become_one_table(spark):
    current = spark.createDataFrame([(1, 100, 100000)], "id int, ts_s bigint, timestamp_ms bigint")
    older = spark.createDataFrame([(2, "1970-01-01T00:03:20")], "id int, timestamp string")
    got = {r.id: r.ts_s for r in stores.all_probes(current, older).collect()}
    assert got == {1: 100, 2: 200}


def test_probe_time_from_each_form(spark):
    for value in ("'1970-01-01T00:03:20'", "200999L", "timestamp_millis(200999)"):
        row = stores.with_probe_time(spark.range(1).selectExpr(f"{value} as timestamp")).first()
        assert row.ts_s == 200
        assert row.timestamp_ms in (200000, 200999)


def test_bulk_copy_reports_a_failing_day_and_goes_on(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("latency", "1.5", "x")], "mtype string, delay_mean string, extra string")
    for day in ("d1", "d3"):
        rows.write.parquet(f"{source}/{day}")

    def copy():
        return bulk_copy_days(
            spark, ["d1", "d2", "d3"], lambda d: spark.read.parquet(f"{source}/{d}"), target, PROBES
        ).collect()

    for _ in range(2):  # a second run replaces the days
        status = {r.day: (r.ok, r.rows, r.error is None) for r in copy()}
        assert status == {"d1": (True, 1, True), "d2": (False, 0, False), "d3": (True, 1, True)}
    copied = spark.read.parquet(target)
    assert copied.count() == 2
    assert copied.schema["delay_mean"].dataType.simpleString() == "double"
    assert "extra" not in copied.columns


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_month_copy_keeps_every_field_and_digit(spark, tmp_path, fmt):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("latency", 1.5, "x", 3)], "mtype string, throughput double, extra string, n bigint")
    rows.write.format(fmt).save(f"{source}/day=2024-01-02")
    status = {r.day: r.ok for r in copy_month(spark, source, target, 2024, 1, PROBES, fmt=fmt).collect()}
    assert [day for day, ok in status.items() if ok] == ["2024-01-02"] and len(status) == 31
    assert [tuple(r) for r in spark.read.parquet(target).select(*rows.columns).collect()] == [("latency", 1.5, "x", 3)]


def test_month_copy_merges_the_types_of_all_days(spark, tmp_path):
    """A field that is whole on one day, broken on another and text on a third; one that only one day has."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    lines = {
        2: '{"mtype": "latency", "size": 1, "mark": 7, "at": {"x": 1}, "list": [1]}',
        3: '{"mtype": "latency", "size": 1.5, "mark": "a", "at": {"x": 2.5, "y": "k"}, "list": [2.5]}',
        5: '{"mtype": "latency", "throughput": 3, "only": true}',
    }
    for day, line in lines.items():
        (source / f"day=2024-01-0{day}").mkdir(parents=True)
        (source / f"day=2024-01-0{day}" / "rows.json").write_text(line + "\n")
    status = copy_month(spark, str(source), target, 2024, 1, PROBES, fmt="json")
    assert status.filter("ok").count() == 3
    copied = spark.read.parquet(target)
    types = dict(copied.dtypes)
    assert (types["size"], types["mark"], types["throughput"]) == ("double", "string", "double")
    assert (types["at"], types["list"], types["only"]) == ("struct<x:double,y:string>", "array<double>", "boolean")
    rows = {str(r.day): r for r in copied.collect()}
    assert [rows[f"2024-01-0{d}"]["size"] for d in (2, 3, 5)] == [1.0, 1.5, None]
    assert [rows[f"2024-01-0{d}"]["mark"] for d in (2, 3, 5)] == ["7", "a", None]
    assert rows["2024-01-02"]["at"].x == 1.0 and rows["2024-01-03"]["list"] == [2.5] and rows["2024-01-05"]["only"]


def test_merged_types():
    from pyspark.sql import types as T

    from gridlens.plans.copy import merged_type

    number = [T.ByteType(), T.LongType(), T.FloatType(), T.DoubleType(), T.NullType(), T.StringType()]
    for a in number:
        for b in number:
            assert merged_type(a, b) == merged_type(b, a)
    assert merged_type(T.LongType(), T.FloatType()) == T.DoubleType()
    assert merged_type(T.FloatType(), T.FloatType()) == T.FloatType()
    assert merged_type(T.NullType(), T.DateType()) == T.DateType()
    assert merged_type(T.BooleanType(), T.LongType()) == T.StringType()


def test_a_failing_day_keeps_its_old_content(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def rows(value):
        return spark.range(1).select(F.expr(value).alias("v"))

    rows("1").write.parquet(f"{source}/d1")
    assert bulk_copy_days(spark, ["d1"], lambda d: spark.read.parquet(f"{source}/{d}"), target).first().ok
    broken = bulk_copy_days(spark, ["d1"], lambda d: rows("int(raise_error('broken'))"), target).first()
    assert not broken.ok and "broken" in broken.error
    assert [r.v for r in spark.read.parquet(target).collect()] == [1]
    assert bulk_copy_days(spark, ["d1"], lambda d: rows("2"), target).first().ok
    assert [r.v for r in spark.read.parquet(target).collect()] == [2]
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.endswith(".old")]


def test_files_of_a_folder_do_not_follow_the_tasks(spark, tmp_path):
    row = spark.range(4000).select(
        F.lit("a").alias("src"), (F.col("id") * 60).alias("beginDate"),
        F.when(F.col("id") % 2 == 0, "RECO").otherwise("DIGI").alias("task_type"),
    )
    rows = conform(row, summary_schema()).withColumn("day", F.timestamp_seconds("beginDate").cast("date"))
    counts = []
    for tasks in (3, 60):
        path = str(tmp_path / f"t{tasks}")
        append_summary(rows.repartition(tasks), path)
        counts.append(len(spark.read.parquet(path).inputFiles()))
    assert counts[0] == counts[1] == rows.select("task_type", "day").distinct().count()


def test_site_documents_have_versions(spark, tmp_path):
    path = str(tmp_path / "sites")
    for version, name in (("2016-01-01", "old"), ("2017-02-01", "new")):
        sites.write_sites(spark.createDataFrame([("t1_a", name), ("t2_b", "GB")], "cms_site string, grid_site string"), path, version)

    def names(as_of=None):
        return dict(map(tuple, sites.read_site_map(spark, f"{path}/names", as_of).collect()))

    assert names() == {"t1_a": "new", "t2_b": "GB"} and names("2017-01-31")["t1_a"] == "old"
    assert sorted(r[0] for r in sites.read_allowlist(spark, f"{path}/allowed").collect()) == ["t1_a", "t2_b"]
    with pytest.raises(ValueError, match="no version"):
        sites.read_site_map(spark, f"{path}/names", "2015-12-31")


def summary_rows(spark):
    row = spark.range(2).select(
        F.lit("a").alias("src"),
        (F.col("id") * 600).alias("beginDate"),
        F.when(F.col("id") == 0, "RECO").otherwise("DIGI").alias("task_type"),
    )
    return conform(row, summary_schema())


def test_summary_append_and_reset(spark, tmp_path):
    path = str(tmp_path / "net_health")
    append_summary(summary_rows(spark), path)
    append_summary(summary_rows(spark), path)
    assert stores.read_summary(spark, path).count() == 4
    assert stores.read_summary(spark, path, task="RECO").count() == 2
    reset_summary(spark, path)
    assert stores.read_summary(spark, path, schema=summary_schema()).count() == 0
    append_summary(summary_rows(spark), path)
    assert stores.read_summary(spark, path, schema=summary_schema()).count() == 2


def test_summary_by_task_and_day(spark, tmp_path):
    path = str(tmp_path / "net_health")
    rows = summary_rows(spark).withColumn("day", F.timestamp_seconds("beginDate").cast("date"))
    append_summary(rows, path, ["task_type", "day"])
    found = stores.read_summary(spark, path, task="RECO")
    assert [str(r.day) for r in found.collect()] == ["1970-01-01"]


def test_summary_schema():
    names = summary_schema().names
    assert len(names) == len(set(names)) == 4 + 2 + 100 + 2
    assert set(stat_columns(JOB_METRICS)) <= set(names)
    assert "stddestLatency" in names


def test_report_text(spark, tmp_path):
    fit = spark.createDataFrame(
        [(1487030400, "a", "B", "wf", 1.5, 2.0, 0.5, None, 0.25)],
        "day bigint, src string, dest string, Workflow string, c_slope double, c_intercept double,"
        " c_r double, c_p double, c_stderr double",
    )
    keys = ["day", "src", "dest", "Workflow"]
    lines = report_lines(fit, keys, {"c_": "meanCpuEff"}, F.lit("meanKEvents"))
    write_lines(lines, str(tmp_path / "report"), [*keys, "position"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text == (
        "14-February-2017\nWorkflow: wf\nWork site: a\nData site: B\nX: meanKEvents  Y: meanCpuEff\n"
        "c_Slope: 1.500000\nc_Intercept: 2.000000\nc_R Value: 0.500000\nc_P Value: nan\nc_std err: 0.250000\n\n"
    )


def test_points_are_foldered_by_page(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "day int, src string, x double")
    write_points(rows, str(tmp_path / "p"), ["day"], "csv")
    assert sorted(p.name for p in (tmp_path / "p").glob("day=*")) == ["day=1", "day=2"]


def test_shared_dir_follows_the_session(spark):
    from gridlens.session import shared_dir

    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        pytest.skip("no checkpoint folder configured")
    assert shared_dir(spark) == configured.rstrip("/")
