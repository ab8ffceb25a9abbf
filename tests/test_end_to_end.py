"""The commands on the fixture stores, and registered queries against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridlens import fixtures as fx
from gridlens.__main__ import main
from gridlens.catalog.oracles import ORACLES
from gridlens.catalog.queries import QUERIES
from gridlens.catalog.settle import settled
from gridlens.plans.summary import build_summary
from gridlens.sinks.tables import write_store
from gridlens.sources.stores import read_summary

SF = "/root/testdata/sf0.001"
PERIOD = ["--start", "2024-01-01T00:00:00", "--end", "2024-01-30T23:59:59"]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    jobs, probes = str(root / "jobs"), str(root / "probes")
    done = F.timestamp_seconds("JobFinishedHookDone").cast("date")
    write_store(fx.jobs(spark, SF).withColumn("day", done), jobs, ["day"])
    stamp = F.timestamp_seconds("ts_s")
    rows = fx.probes(spark, SF).withColumn("timestamp", stamp).drop("ts_s", "timestamp_ms")
    write_store(rows.withColumn("day", F.to_date("timestamp")), probes, ["mtype", "day"])
    (root / "site_names.json").write_text(
        "{" + ",".join(f'"t2_site_{i}": "GRID_{i}"' for i in range(4)) + "}"
    )
    sites = ["--sites", str(root / "site_names.json")]
    summary = str(root / "net_health")
    main(["summary", "--jobs", jobs, "--probes", probes, *sites, *PERIOD, "--out", summary])
    return {"jobs": jobs, "probes": probes, "sites": sites, "summary": summary, "root": root}


def test_summary_command(spark, inputs):
    table = read_summary(spark, inputs["summary"])
    assert table.count() == fx.net_health(spark, SF).count()
    keys = ["task_type", "src", "dest", "Workflow", "LastRemoteHost", "beginDate"]
    assert table.groupBy(*keys).count().filter("count > 1").isEmpty()
    bad = ~((F.col("minCpuEff") <= F.col("medianCpuEff")) & (F.col("medianCpuEff") <= F.col("maxCpuEff")))
    assert table.filter(bad).isEmpty()


def test_skewed_ways_build_the_same_summary(spark):
    inputs = [f(spark, SF) for f in (fx.job_store, fx.probe_store, fx.allowlist, fx.site_map)]
    keys = ["task_type", "src", "dest", "Workflow", "LastRemoteHost", "beginDate"]
    shown = [*keys, *settled("medianKEvents", "stdCpuEff", "meansrcPacket", "mediandestLatency")]
    plain = fx.net_health(spark, SF).select(*shown)
    forced = build_summary(*inputs, fx.PERIOD, hot_limit=3).select(*shown)
    assert forced.count() == plain.count()
    assert forced.exceptAll(plain).isEmpty()


def test_a_skewed_summary_scans_its_stores_once(spark, monkeypatch):
    """Whatever the load: the pieces of jobs and of probes are written once, the summary reads these
    alone, and its wide rows are not shuffled for the join."""
    from gridlens.operators import stats

    written = []
    real = stats.stored
    monkeypatch.setattr(stats, "stored", lambda df, name: (written.append(name), real(df, name))[1])
    inputs = [f(spark, SF) for f in (fx.job_store, fx.probe_store, fx.allowlist, fx.site_map)]
    built = build_summary(*inputs, fx.PERIOD, hot_limit=2)
    assert written == ["pieces", "pieces"]
    assert not [f for f in built.inputFiles() if "/jobs/" in f or "/probes/" in f]
    plan = built._jdf.queryExecution().executedPlan().toString()
    wide = plan[plan.index("SortMergeJoin") : plan.index("Union")]
    assert "Exchange" not in wide


@pytest.mark.parametrize("name", ["overbyte", "vslumos"])
def test_regress_command(spark, inputs, name):
    out = inputs["root"] / name
    main(["regress", name, "--summary", inputs["summary"], *PERIOD, "--out", str(out)])
    assert spark.read.parquet(str(out / "fits")).count() > 0
    assert (out / "report").exists()
    assert (out / "shares").exists() == (name == "overbyte")


@pytest.mark.parametrize("name", ["points_core", "points_net_eff", "points_kevent", "points_kevent_hr", "points_task_type"])
def test_points_command(spark, inputs, name):
    out = str(inputs["root"] / name)
    source = ["--summary", inputs["summary"], "--jobs", inputs["jobs"]]
    main(["points", name, *source, *inputs["sites"], *PERIOD, "--out", out])
    assert spark.read.parquet(out).count() == entry.queries()[name](spark, SF).count()


def test_intervals_command(spark, inputs):
    out = str(inputs["root"] / "intervals")
    source = ["--jobs", inputs["jobs"], "--probes", inputs["probes"], *inputs["sites"]]
    main(["intervals", *source, *PERIOD, "--reduced", "--out", out])
    want = entry.queries()["interval_series_reduced"](spark, SF).count()
    assert spark.read.parquet(out).count() == want


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name",
    [
        "join_job_windows", "job_window_stats", "join_window_probes", "probe_window_stats",
        "scatter_regression", "effect_shares", "interval_series", "union_throughput_sides", "bulk_copy_days",
        "points_kevent_rate", "regress_xy",
    ],
)
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("region", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        return sorted(
            tuple("" if v != v or v is None else str(float(v)) if isinstance(v, (int, float)) else str(v) for v in row)
            for row in frame[columns].astype(object).itertuples(index=False)
        )

    assert rows(found) == rows(want)
