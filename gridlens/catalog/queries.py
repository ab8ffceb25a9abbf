"""One registered query per operator and data product, over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens import fixtures as fx
from gridlens.catalog.settle import digits_of, settle, settled
from gridlens.functions import labels, ratios, times
from gridlens.operators import filters, joins, probes, reshape, sorting, terms, windows
from gridlens.operators.regression import effect_shares, regress
from gridlens.plans import copy, intervals, points, regressions, summary
from gridlens.schemas import DAY, JOB_METRICS, NETWORK_SERIES, PROBES, TASK_TYPES, stat_columns
from gridlens.session import fresh_path, tune
from gridlens.sinks.reports import LAYOUTS, data_site_lines, share_lines
from gridlens.sinks.tables import append_summary, reset_summary
from gridlens.sources import sites
from gridlens.sources.stores import all_probes, read_summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GRID = windows.Grid.of(fx.PERIOD)
# A period inside the test period, so that both bounds cut rows off.
INNER = (fx.PERIOD[0] + 5 * DAY, fx.PERIOD[0] + 20 * DAY)
KEYS = ["task_type", "src", "dest", "Workflow", "LastRemoteHost", "beginDate"]
# Pieces of a series from which the tables of the tests have giants and crowded places.
SKEWED_LIMIT = 2
FIT = ["n", "slope", "intercept", "r", "p", "stderr"]
ISO = "yyyy-MM-dd'T'HH:mm:ss"
BASIC = "yyyyMMdd'T'HHmmss"


def query(function: Query) -> Query:
    """Register a query under its function's name, without the trailing underscore that keeps it
    apart from an import of the same name."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return summary.select_jobs(
        fx.job_store(spark, sf), fx.allowlist(spark, sf), fx.site_map(spark, sf), fx.PERIOD
    )


def _fits(fits: DataFrame, keys: list[str], prefixes: list[str], *flags: str) -> DataFrame:
    columns = [F.col(p + "n") for p in prefixes]
    columns += settled(*[p + f for p in prefixes for f in FIT[1:]])
    return fits.select(*keys, *columns, *flags)


def _text_time(form: str) -> Column:
    return F.date_format(F.timestamp_seconds("ts_s"), form)


# Scans


@query
def scan_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.job_store(spark, sf).select(*[c for c in fx.JOB_COLUMNS if c != "DataLocation0"])


@query
def scan_probes(spark: SparkSession, sf: str) -> DataFrame:
    return fx.probe_store(spark, sf).select(*fx.PROBE_COLUMNS, "ts_s", "timestamp_ms")


@query
def scan_probes_iso(spark: SparkSession, sf: str) -> DataFrame:
    stored = fx.probe_store(spark, sf)
    current = stored.filter("event_id % 2 = 0").withColumn("timestamp", F.lit(None).cast("string"))
    older = stored.filter("event_id % 2 = 1").withColumn("timestamp", _text_time(ISO))
    both = all_probes(current, older.drop("ts_s", "timestamp_ms"))
    return both.select("event_id", "mtype", "timestamp", "ts_s", "timestamp_ms")


@query
def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fx.net_health(spark, sf).select(*KEYS, "endDate", *settled("meanCpuEff", "meanKEvents"))


@query
def scan_summary_task(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.net_health(spark, sf).filter(F.col("task_type") == "DIGIRECO")
    return rows.select(*KEYS, *settled("meanCpuEff", "meanInputGB"))


@query
def site_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    ran = fx.job_store(spark, sf).select(F.lower("Site").alias("cms_site"))
    allowed = sites.read_allowlist(spark, f"{fx.site_documents(spark, sf)}/allowed")
    return terms.count_matches(ran.join(allowed, "cms_site"), "cms_site")


@query
def site_map(spark: SparkSession, sf: str) -> DataFrame:
    ran = fx.job_store(spark, sf).select(F.lower("Site").alias("cms_site"))
    names = sites.read_site_map(spark, f"{fx.site_documents(spark, sf)}/names")
    return terms.count_matches(ran.join(names, "cms_site", "left"), "cms_site", "grid_site")


@query
def site_map_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The site names that held on a day before the newest version."""
    ran = fx.job_store(spark, sf).select(F.lower("Site").alias("cms_site"))
    names = sites.read_site_map(spark, f"{fx.site_documents(spark, sf)}/names", "2023-12-31")
    return terms.count_matches(ran.join(names, "cms_site"), "cms_site", "grid_site")


# Sinks


def _content(table: DataFrame) -> DataFrame:
    return table.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("beginDate").alias("first"),
        F.max("beginDate").alias("last"),
        settle(F.avg("meanCpuEff")).alias("cpu_eff"),
        F.count("meansrcPacket").alias("with_packet"),
    )


@query
def sink_summary(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "sink")
    append_summary(fx.net_health(spark, sf), path)
    return _content(read_summary(spark, path))


@query
def reset_summary_(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "reset")
    rows = fx.net_health(spark, sf)
    append_summary(rows, path)
    reset_summary(spark, path, rows.schema)
    append_summary(rows, path)
    return _content(read_summary(spark, path, schema=rows.schema))


@query
def bulk_copy_days(spark: SparkSession, sf: str) -> DataFrame:
    source, target = fx.probe_day_path(spark, sf), fresh_path(spark, "copy")
    status = copy.copy_month(tune(spark), source, target, 2024, 1, PROBES)
    return status.select("day", "ok", "rows")


@query
def bulk_copy_content(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of the copied records, read back from the target."""
    source, target = fx.probe_day_path(spark, sf), fresh_path(spark, "copy")
    copy.copy_month(tune(spark), source, target, 2024, 1, PROBES)
    copied = spark.read.parquet(target)
    return copied.select(*fx.PROBE_COLUMNS, "ts_s", "timestamp_ms")


def _slot_report(spark: SparkSession, sf: str, analysis: str) -> DataFrame:
    keys, layout = [*regressions.SLOT_KEYS, "series"], LAYOUTS[analysis]
    fits = _fits(_stored_fits(spark, sf, analysis).filter("significant"), keys, list(layout.responses))
    return layout.lines(fits, keys)


@query
def report_lines_(spark: SparkSession, sf: str) -> DataFrame:
    return _slot_report(spark, sf, "overbyte")


@query
def report_network(spark: SparkSession, sf: str) -> DataFrame:
    return _slot_report(spark, sf, "network")


@query
def report_scatter(spark: SparkSession, sf: str) -> DataFrame:
    return _slot_report(spark, sf, "scatter")


@query
def report_lumosity(spark: SparkSession, sf: str) -> DataFrame:
    return _pair_report(regressions.lumosity_regression(fx.net_health(spark, sf)), "lumosity")


@query
def report_vslumos(spark: SparkSession, sf: str) -> DataFrame:
    return _pair_report(regressions.vslumos_regression(fx.net_health(spark, sf)), "vslumos")


def _pair_report(fits: DataFrame, analysis: str) -> DataFrame:
    """Every fit of an analysis of site pairs, significant or not."""
    layout = LAYOUTS[analysis]
    return layout.lines(_fits(fits, regressions.PAIR_KEYS, list(layout.responses)), regressions.PAIR_KEYS)


@query
def report_data_sites(spark: SparkSession, sf: str) -> DataFrame:
    shares = regressions.data_sites(fx.net_health(spark, sf))
    return data_site_lines(shares.withColumn("share", settle(F.col("share"))))


@query
def report_shares(spark: SparkSession, sf: str) -> DataFrame:
    return share_lines(_shares(spark, sf, "overbyte").withColumn("share", settle(F.col("share"))))


# Filters


@query
def filter_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = filters.completed_jobs(filters.offsite_jobs(fx.job_store(spark, sf)))
    return joins.semi_work_site(jobs, fx.allowlist(spark, sf)).select("JobId", "TaskType", "Site")


@query
def filter_exists(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fx.job_store(spark, sf).filter(filters.exists_all(*filters.REQUIRED_FIELDS))
    return jobs.select("JobId", *filters.REQUIRED_FIELDS)


@query
def filter_time_range(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fx.job_store(spark, sf, INNER).filter(filters.in_period(F.col("JobFinishedHookDone"), INNER))
    return jobs.select("JobId", "JobFinishedHookDone")


@query
def filter_completion_range(spark: SparkSession, sf: str) -> DataFrame:
    """A range on a time that is not the one the day folders are named after."""
    jobs = fx.job_store(spark, sf, INNER, "CompletionDate").filter(filters.in_period(F.col("CompletionDate"), INNER))
    return jobs.select("JobId", "CompletionDate")


@query
def filter_probe_range(spark: SparkSession, sf: str) -> DataFrame:
    found = fx.probe_store(spark, sf, INNER).filter(filters.in_period_ms(F.col("timestamp_ms"), INNER))
    return found.select("event_id", "mtype", "timestamp_ms")


@query
def filter_probe_range_iso(spark: SparkSession, sf: str) -> DataFrame:
    text = fx.probe_store(spark, sf, INNER).withColumn("timestamp", _text_time(ISO))
    parsed = times.parse_probe_time(F.col("timestamp"))
    return text.filter(filters.in_period(parsed, INNER)).select("event_id", "timestamp")


@query
def filter_min_rate(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fx.job_store(spark, sf).filter(filters.at_least(F.col("EventRate"), 0))
    return jobs.select("JobId", *settled("EventRate"))


@query
def filter_day_slice(spark: SparkSession, sf: str) -> DataFrame:
    sliced = regressions.day_slices(fx.net_health(spark, sf), INNER)
    return sliced.select(*KEYS, "day")


@query
def filter_bucket(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fx.job_store(spark, sf).filter(filters.bucket_interior(F.col("KEvents")))
    return jobs.select("JobId", labels.bucket_floor(F.col("KEvents")).alias("bucket"))


@query
def semi_data_site(spark: SparkSession, sf: str) -> DataFrame:
    jobs = joins.semi_data_site(fx.job_store(spark, sf), fx.allowlist(spark, sf))
    first = joins.first_location(F.col("DataLocations"))
    return jobs.select("JobId", first.alias("location"))


@query
def filter_probe_sites(spark: SparkSession, sf: str) -> DataFrame:
    return filters.sited_probes(fx.probe_store(spark, sf)).select("event_id", "srcSite", "destSite")


@query
def probe_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return probes.quarantine(fx.probe_store(spark, sf)).select("event_id", "MA", "src", "dest")


@query
def filter_metric_present(spark: SparkSession, sf: str) -> DataFrame:
    rows = reshape.unpivot_series(fx.net_health(spark, sf), ["task_type"])
    return terms.count_matches(rows, "task_type", "series")


@query
def filter_significant(spark: SparkSession, sf: str) -> DataFrame:
    fits = _stored_fits(spark, sf, "scatter").filter("significant")
    return _fits(fits, [*regressions.SLOT_KEYS, "series"], ["c_", "e_"])


@query
def filter_task_set(spark: SparkSession, sf: str) -> DataFrame:
    return filters.task_set(fx.job_store(spark, sf), TASK_TYPES).select("JobId", "TaskType")


@query
def filter_pair_slot(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.pair_slice(fx.net_health(spark, sf), "t2_site_0", "T2_SITE_1", "node0")
    return rows.select(*KEYS, *settled("meanCpuEff"))


# Scalars


@query
def parse_probe_time(spark: SparkSession, sf: str) -> DataFrame:
    form = F.col("event_id") % 4
    text = (
        F.when(form == 0, F.concat(_text_time(BASIC), F.lit("+0000")))
        .when(form == 1, _text_time(ISO))
        .when(form == 2, F.concat(_text_time(BASIC), F.lit("Z")))
        .otherwise(F.concat(_text_time(ISO), F.lit("+00:00")))
    )
    rows = fx.probe_store(spark, sf).select("event_id", text.alias("timestamp"))
    return rows.withColumn("ts", times.parse_probe_time(F.col("timestamp")))


@query
def utc_stamp(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.probe_store(spark, sf).select("event_id", _text_time(ISO).alias("text"))
    return rows.withColumn("stamp", times.utc_stamp(F.col("text")))


@query
def utc_date(spark: SparkSession, sf: str) -> DataFrame:
    date = times.utc_date(F.col("JobFinishedHookDone"))
    shown = F.date_format(date, "yyyy-MM-dd HH:mm:ss").alias("finished")
    return fx.job_store(spark, sf).select("JobId", shown)


@query
def day_label(spark: SparkSession, sf: str) -> DataFrame:
    label = times.day_label(F.col("JobFinishedHookDone")).alias("label")
    return terms.count_matches(fx.job_store(spark, sf).select(label), "label")


@query
def slot_trim(spark: SparkSession, sf: str) -> DataFrame:
    host = F.col("LastRemoteHost")
    return fx.job_store(spark, sf).select(
        "JobId",
        labels.slot_trim(host).alias("two"),
        labels.slot_trim(F.concat(F.lit("a@"), F.col("Workflow"))).alias("one"),
        labels.slot_trim(F.col("Workflow")).alias("none"),
        labels.slot_trim(F.concat(host, F.lit("@x"))).alias("three"),
    )


@query
def host_default(spark: SparkSession, sf: str) -> DataFrame:
    host = labels.host_default(F.col("LastRemoteHost")).alias("host")
    return terms.count_matches(fx.job_store(spark, sf).select(host), "host")


@query
def lumosity(spark: SparkSession, sf: str) -> DataFrame:
    value = ratios.lumosity(F.col("WallClockHr"), F.col("KEvents"))
    return fx.job_store(spark, sf).select("JobId", settle(value).alias("lumosity"))


@query
def mean_lumos(spark: SparkSession, sf: str) -> DataFrame:
    value = ratios.mean_lumos(F.col("meanKEvents"), F.col("meanWallClockHr"))
    return fx.net_health(spark, sf).select(*KEYS, settle(value).alias("lumos"))


@query
def probe_interval(spark: SparkSession, sf: str) -> DataFrame:
    t0, t1 = times.probe_interval(F.col("ts_s"))
    return fx.probe_store(spark, sf).select("event_id", t0.alias("t0"), t1.alias("t1"))


@query
def probe_side(spark: SparkSession, sf: str) -> DataFrame:
    return probes.with_side(fx.probe_store(spark, sf)).select("event_id", "side")


@query
def zero_fill_pair(spark: SparkSession, sf: str) -> DataFrame:
    src, dest = ratios.zero_fill_pair(F.col("meansrcPacket"), F.col("meandestPacket"))
    rows = fx.net_health(spark, sf).select(*KEYS, settle(src).alias("src_packet"), settle(dest).alias("dest_packet"))
    return rows.filter(F.col("src_packet").isNotNull())


@query
def pair_label(spark: SparkSession, sf: str) -> DataFrame:
    label = labels.pair_label(F.col("src"), F.col("dest")).alias("label")
    return terms.count_matches(fx.net_health(spark, sf).select(label), "label")


@query
def cast_probe(spark: SparkSession, sf: str) -> DataFrame:
    return filters.measured_probes(fx.probe_store(spark, sf)).select(
        "event_id",
        F.coalesce("throughput", "packet_loss", "delay_mean").cast("double").alias("value"),
        F.col("ts_s").cast("int").alias("ts"),
        F.col("event_id").cast("string").alias("id_text"),
    )


@query
def bucket_label(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fx.job_store(spark, sf).filter(filters.bucket_interior(F.col("KEvents")))
    return terms.count_matches(jobs.select(labels.bucket_label(F.col("KEvents")).alias("label")), "label")


@query
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    rows = regressions.day_slices(fx.net_health(spark, sf))
    pages = joins.pairs_present(rows, ["day", "src", "dest", "LastRemoteHost"])
    src, dest, day, slot = (F.col(c) for c in ("src", "dest", "day", "LastRemoteHost"))
    return pages.select(
        labels.page_title(src, dest, day).alias("title"),
        labels.page_title(src, dest, day, slot).alias("slot_title"),
        labels.task_title(slot, day, src).alias("task_title"),
        "n",
    )


# Joins


@query
def join_site_names(spark: SparkSession, sf: str) -> DataFrame:
    named = joins.join_site_names(fx.job_store(spark, sf), fx.site_map(spark, sf))
    return named.select("JobId", "src", "dest", "grid_src", "grid_dest")


@query
def join_job_windows(spark: SparkSession, sf: str) -> DataFrame:
    jobs = _selected(spark, sf)
    cells = windows.explode_windows(jobs, "JobCurrentStartDate", "JobFinishedHookDone", GRID)
    return terms.count_matches(cells, *KEYS)


@query
def join_window_probes(spark: SparkSession, sf: str) -> DataFrame:
    jobs, placement, _ = summary.job_window_stats(_selected(spark, sf), GRID, ["CpuEff"])
    series = summary.probe_series(fx.probe_store(spark, sf), fx.PERIOD)
    joined = summary.join_window_probes(jobs, placement, summary.probe_window_stats(series, GRID))
    return joined.select(*KEYS, *settled("meanCpuEff", *["mean" + s for s in NETWORK_SERIES]))


@query
def semi_probe_pairs(spark: SparkSession, sf: str) -> DataFrame:
    kept = joins.semi_probe_pairs(fx.probe_store(spark, sf), _selected(spark, sf))
    return kept.select("event_id", "srcSite", "destSite", "mtype")


@query
def pairs_present(spark: SparkSession, sf: str) -> DataFrame:
    rows = regressions.day_slices(fx.net_health(spark, sf))
    return joins.pairs_present(rows, ["day", "src", "dest", "LastRemoteHost"])


# Aggregations


@query
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.net_health(spark, sf)
    tops = [
        terms.top_terms(table, field).select(F.lit(field).alias("field"), "term", "n")
        for field in ("src", "dest", "LastRemoteHost")
    ]
    return reduce(DataFrame.unionByName, tops)


@query
def top_terms_filtered(spark: SparkSession, sf: str) -> DataFrame:
    jobs = filters.offsite_jobs(fx.job_store(spark, sf, INNER)).filter(
        filters.exists_all("ChirpCMSSWEventRate", "InputGB")
        & filters.in_period(F.col("JobFinishedHookDone"), INNER)
    )
    return terms.top_terms(filters.job_slice(jobs, task="DataProcessing"), "Workflow")


@query
def max_kevents(spark: SparkSession, sf: str) -> DataFrame:
    of_summary = terms.max_value(fx.net_health(spark, sf), "meanKEvents").toDF("max_kevents")
    of_jobs = terms.max_value(fx.job_store(spark, sf), "KEvents").toDF("max_kevents")
    return of_summary.select(F.lit("summary").alias("source"), *settled("max_kevents")).unionByName(
        of_jobs.select(F.lit("jobs").alias("source"), *settled("max_kevents"))
    )


@query
def count_matches(spark: SparkSession, sf: str) -> DataFrame:
    return terms.count_matches(_selected(spark, sf), "task_type", "src")


@query
def job_window_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats, _, _ = summary.job_window_stats(_selected(spark, sf), GRID, ["CpuEff"])
    return stats.select(*KEYS, *settled(*stat_columns(["CpuEff"])))


@query
def probe_window_stats(spark: SparkSession, sf: str) -> DataFrame:
    series = summary.probe_series(fx.probe_store(spark, sf), fx.PERIOD)
    stats = summary.probe_window_stats(series, GRID)
    return stats.select("srcSite", "destSite", "beginDate", *settled(*stat_columns(NETWORK_SERIES)))


@query
def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return terms.distinct_keys(
        fx.job_store(spark, sf),
        location=joins.first_location(F.col("DataLocations")),
        workflow=F.col("Workflow"),
        host=labels.host_default(F.col("LastRemoteHost")),
    )


@query
def regress_xy(spark: SparkSession, sf: str) -> DataFrame:
    fits = regress(fx.job_store(spark, sf), ["TaskType", "Site"], "KEvents", {"c_": "CpuEff"})
    return _fits(fits, ["TaskType", "Site"], ["c_"])


ANALYSES = {
    "network": (regressions.network_regression, regressions.opposed_effects),
    "overbyte": (regressions.overbyte_regression, regressions.negative_effects),
    "scatter": (regressions.scatter_regression, regressions.opposed_effects),
}


def _stored_fits(spark: SparkSession, sf: str, analysis: str) -> DataFrame:
    """The fits of an analysis, written once; counters and reports read them several times."""

    def write(path: str) -> None:
        ANALYSES[analysis][0](fx.net_health(spark, sf)).write.parquet(path)

    return spark.read.parquet(fx.staged(spark, sf, f"fits_{analysis}", write))


def _effects(spark: SparkSession, sf: str, analysis: str) -> DataFrame:
    return ANALYSES[analysis][1](_stored_fits(spark, sf, analysis), fx.net_health(spark, sf))


def _shares(spark: SparkSession, sf: str, analysis: str) -> DataFrame:
    return effect_shares(_effects(spark, sf, analysis))


@query
def effect_opposed(spark: SparkSession, sf: str) -> DataFrame:
    both = [
        _effects(spark, sf, a).withColumn("analysis", F.lit(a)) for a in ("network", "scatter")
    ]
    return reduce(DataFrame.unionByName, both)


@query
def effect_negative(spark: SparkSession, sf: str) -> DataFrame:
    return _effects(spark, sf, "overbyte")


@query
def effect_shares_(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        _shares(spark, sf, a).select(
            F.lit(a).alias("analysis"), "key_kind", "key", "hits", "total", *settled("share")
        )
        for a in ("network", "overbyte", "scatter")
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def data_site_share(spark: SparkSession, sf: str) -> DataFrame:
    shares = regressions.data_sites(fx.net_health(spark, sf))
    return shares.select("dest", "groups", *settled("share"))


# Windows, sorts, set operations


@query
def window_grid(spark: SparkSession, sf: str) -> DataFrame:
    return windows.window_grid(fx.job_store(spark, sf), "JobCurrentStartDate", "JobFinishedHookDone")


@query
def window_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = regressions.day_slices(fx.net_health(spark, sf), INNER)
    return terms.count_matches(rows, "day")


@query
def sort_probes(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.sited_probes(filters.measured_probes(fx.probe_store(spark, sf)))
    return sorting.sort_by_time(found.select("event_id", "mtype", "ts_s"), "ts_s", "event_id")


@query
def sort_jobs_in_group(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["src", "dest", "Workflow", "LastRemoteHost"]
    jobs = _selected(spark, sf).select(*keys, "JobCurrentStartDate", *settled("CpuEff"))
    return sorting.sort_in_groups(jobs, keys, "JobCurrentStartDate")


@query
def sort_summary_desc(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.net_health(spark, sf).select(*KEYS, *settled("meanCpuEff"))
    return sorting.sort_latest_first(rows, "beginDate", *[k for k in KEYS if k != "beginDate"])


@query
def union_throughput_sides(spark: SparkSession, sf: str) -> DataFrame:
    rows = reshape.union_throughput_sides(fx.net_health(spark, sf), KEYS)
    return rows.select(*KEYS, "series", *settled("x", "y_src", "y_dest"))


@query
def unpivot_series(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.unpivot_series(fx.net_health(spark, sf), KEYS).select(*KEYS, "series", *settled("x"))


# Data products


def _built(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    metrics = [*JOB_METRICS, "DiskUsage", "BytesRecvd", *NETWORK_SERIES]
    return fx.summary(spark, sf, **limits).select(*KEYS, "endDate", *settled(*stat_columns(metrics)))


@query
def summary_build(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf)


@query
def summary_build_skewed(spark: SparkSession, sf: str) -> DataFrame:
    """The summary as it is built when places and single series exceed what a task may hold."""
    return _built(spark, sf, hot_limit=SKEWED_LIMIT)


@query
def network_regression(spark: SparkSession, sf: str) -> DataFrame:
    fits = regressions.network_regression(fx.net_health(spark, sf))
    return _fits(fits, [*regressions.SLOT_KEYS, "series"], ["c_", "e_"], "significant")


@query
def overbyte_regression(spark: SparkSession, sf: str) -> DataFrame:
    fits = regressions.overbyte_regression(fx.net_health(spark, sf))
    return _fits(fits, [*regressions.SLOT_KEYS, "series"], ["c_", "e_"], "significant")


@query
def scatter_regression(spark: SparkSession, sf: str) -> DataFrame:
    fits = regressions.scatter_regression(fx.net_health(spark, sf))
    return _fits(fits, [*regressions.SLOT_KEYS, "series"], ["c_", "e_"], "significant")


@query
def lumosity_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _fits(regressions.lumosity_regression(fx.net_health(spark, sf)), regressions.PAIR_KEYS, ["c_"])


@query
def vslumos_regression(spark: SparkSession, sf: str) -> DataFrame:
    fits = regressions.vslumos_regression(fx.net_health(spark, sf))
    return _fits(fits, regressions.PAIR_KEYS, ["c_", "e_"])


def _job_points(name: str) -> Query:
    x, ys = points.JOB_POINTS[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = points.job_points(fx.net_health(spark, sf), name)
        return rows.select(*points.PAGE, settle(F.col("x"), digits_of(x)).alias("x"), *settled(*ys))

    return run


def _network_points(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = points.network_points(fx.net_health(spark, sf), name)
        return rows.select(*points.PAGE, "series", *settled("x", *points.NETWORK_POINTS[name]))

    return run


QUERIES.update({name: _job_points(name) for name in points.JOB_POINTS})
QUERIES.update({name: _network_points(name) for name in points.NETWORK_POINTS})


@query
def points_kevent(spark: SparkSession, sf: str) -> DataFrame:
    rows = points.summary_event_points(fx.net_health(spark, sf))
    return rows.select("bucket", "label", *settled("x", "y"))


@query
def points_kevent_hr(spark: SparkSession, sf: str) -> DataFrame:
    rows = points.job_event_points(fx.job_store(spark, sf, fx.PERIOD, "CompletionDate"), "CoreHr", fx.PERIOD)
    return rows.select("bucket", "label", *settled("x", "y"))


@query
def points_kevent_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = points.job_event_points(fx.job_store(spark, sf, fx.PERIOD, "CompletionDate"), "ChirpCMSSWEventRate", fx.PERIOD)
    return rows.select("bucket", "label", *settled("x", "y"))


@query
def points_task_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = points.task_type_points(fx.job_store(spark, sf), fx.allowlist(spark, sf))
    return rows.select("day", "site", "task_type", *settled("x", "y"))


def _intervals(throughput: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = intervals.interval_series(
            fx.job_store(spark, sf, fx.PERIOD, "CompletionDate"),
            fx.probe_store(spark, sf, fx.PERIOD),
            fx.allowlist(spark, sf),
            fx.site_map(spark, sf),
            fx.PERIOD,
            throughput,
        )
        return rows.select("src", "dest", "series", "t0", "t1", *settled("value"))

    return run


QUERIES["interval_series"] = _intervals(True)
QUERIES["interval_series_reduced"] = _intervals(False)


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """CPU-efficiency summary per task, site pair, workflow, host and 10-minute window."""
    return job_window_stats(tune(spark), sf)
