"""Command line: ``spark-submit -m gridlens <command>``; one command per program of the analyses."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from gridlens import schemas
from gridlens.operators.regression import effect_shares
from gridlens.plans import copy, intervals, points, regressions
from gridlens.plans.summary import build_summary, job_metrics
from gridlens.session import tune
from gridlens.sinks.reports import LAYOUTS, data_site_lines, share_lines, write_lines
from gridlens.sinks.tables import append_summary, reset_summary, write_points
from gridlens.sources import sites, stores

# Analysis -> (fits, effects or None); the report's layout has the same name.
ANALYSES = {
    "network": (regressions.network_regression, regressions.opposed_effects),
    "overbyte": (regressions.overbyte_regression, regressions.negative_effects),
    "scatter": (regressions.scatter_regression, regressions.opposed_effects),
    "lumosity": (regressions.lumosity_regression, None),
    "vslumos": (regressions.vslumos_regression, None),
}
JOB_EVENT_POINTS = {"points_kevent_hr": "CoreHr", "points_kevent_rate": "ChirpCMSSWEventRate"}


def _sites(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    site_map = sites.read_site_map(spark, args.sites) if args.sites else sites.default_site_map(spark)
    allowed = sites.read_allowlist(spark, args.allow) if args.allow else site_map.select("cms_site")
    return allowed, site_map


def _period(args: argparse.Namespace, default: tuple[str, str]) -> tuple[str, str]:
    return (args.start or default[0], args.end or default[1])


def _probes(spark: SparkSession, args: argparse.Namespace, period: tuple) -> DataFrame:
    return stores.with_probe_time(stores.read_probes(spark, args.probes, period=period))


def summary(spark: SparkSession, args: argparse.Namespace) -> None:
    """Reset the summary table (unless ``--append``) and build the period."""
    period = _period(args, schemas.SUMMARY_PERIOD)
    jobs, probes = stores.read_jobs(spark, args.jobs, period), _probes(spark, args, period)
    if not args.append:
        reset_summary(spark, args.out, schemas.summary_schema(job_metrics(jobs)))
    append_summary(build_summary(jobs, probes, *_sites(spark, args), period), args.out)


def regress(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write an analysis' fits, its report and its effect shares."""
    fit, effects = ANALYSES[args.name]
    default = schemas.REGRESSION_PERIOD if effects else schemas.SCATTER_PERIOD
    period = _period(args, default)
    table = stores.read_summary(spark, args.summary)
    fit(table, period).write.mode("overwrite").parquet(f"{args.out}/fits")
    fits = spark.read.parquet(f"{args.out}/fits")
    keys = [*regressions.SLOT_KEYS, "series"] if effects else regressions.PAIR_KEYS
    reported = fits.filter("significant") if effects else fits
    write_lines(LAYOUTS[args.name].lines(reported, keys), f"{args.out}/report", [*keys, "position"])
    if effects:
        shares = effect_shares(effects(fits, table, period))
        write_lines(share_lines(shares), f"{args.out}/shares", ["key_kind", "key"])
    if args.name == "overbyte":
        regressions.data_sites(table, period).write.mode("overwrite").parquet(f"{args.out}/data_sites")
        located = spark.read.parquet(f"{args.out}/data_sites")
        write_lines(data_site_lines(located), f"{args.out}/data_locations", ["dest"])


def chart_points(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write a chart's points, one folder per day or event bucket."""
    period = _period(args, schemas.SCATTER_PERIOD)
    if args.name in points.JOB_POINTS:
        rows = points.job_points(stores.read_summary(spark, args.summary), args.name, period)
    elif args.name in points.NETWORK_POINTS:
        rows = points.network_points(stores.read_summary(spark, args.summary), args.name, period)
    elif args.name == "points_kevent":
        rows = points.summary_event_points(stores.read_summary(spark, args.summary))
    elif args.name in JOB_EVENT_POINTS:
        rows = points.job_event_points(
            stores.read_jobs(spark, args.jobs, period, column="CompletionDate"), JOB_EVENT_POINTS[args.name], period
        )
    else:
        rows = points.task_type_points(
            stores.read_jobs(spark, args.jobs),
            _sites(spark, args)[0],
            period=_period(args, schemas.TASK_SCATTER_PERIOD),
        )
    write_points(rows, args.out, ["day" if "day" in rows.columns else "bucket"])


def series(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write the interval series of every site pair with jobs."""
    period = _period(args, schemas.SCATTER_PERIOD)
    jobs, probes = stores.read_jobs(spark, args.jobs), _probes(spark, args, period)
    rows = intervals.interval_series(jobs, probes, *_sites(spark, args), period, not args.reduced)
    write_points(rows, args.out, ["series"])


def copy_days(spark: SparkSession, args: argparse.Namespace) -> None:
    """Copy a month of daily datasets and print the status of each day."""
    names, schema = (
        (copy.JOB_DAYS, schemas.JOBS) if args.name == "jobs" else (copy.PROBE_DAYS, schemas.PROBES)
    )
    status = copy.copy_month(spark, args.source, args.out, args.year, args.month, schema, names, args.format)
    status.show(31, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridlens")
    commands = top.add_subparsers(required=True)

    def command(name: str, run: object, *options: str, names: list[str] | None = None) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        if names:
            sub.add_argument("name", choices=names)
        for option in options:
            sub.add_argument(f"--{option}")
        sub.add_argument("--out", required=True)
        return sub

    period = ("start", "end")
    site_files = ("sites", "allow")
    build = command("summary", summary, "jobs", "probes", *site_files, *period)
    build.add_argument("--append", action="store_true")
    command("regress", regress, "summary", *period, names=list(ANALYSES))
    charts = [*points.JOB_POINTS, *points.NETWORK_POINTS, "points_kevent", *JOB_EVENT_POINTS, "points_task_type"]
    command("points", chart_points, "summary", "jobs", *site_files, *period, names=charts)
    lines = command("intervals", series, "jobs", "probes", *site_files, *period)
    lines.add_argument("--reduced", action="store_true", help="without the throughput series")
    month = command("copy", copy_days, "source", names=["jobs", "probes"])
    month.add_argument("--year", type=int, required=True)
    month.add_argument("--month", type=int, required=True)
    month.add_argument("--format", default="parquet", choices=["parquet", "json"])
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = tune(SparkSession.builder.appName("gridlens").getOrCreate())
    args.run(spark, args)


if __name__ == "__main__":
    main()
