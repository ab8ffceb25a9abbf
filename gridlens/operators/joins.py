"""Equi joins with the site tables and pruning semi joins.

The site tables hold one row per grid site and take no hint. A table that grows with the data is sent
to the tasks by its rows, see :func:`sized`. Probes are first tested against a filter of fixed size, in
the scan, before any exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.session import stored

# Hashes of site pairs a filter tells apart.
PAIR_HASHES = 1 << 16
# Rows of a table that is sent to every task.
BROADCAST_ROWS = 1 << 16


def sized(table: DataFrame) -> DataFrame:
    """``table`` hinted by its counted rows: sent to every task while they are few, merged otherwise.

    Without a hint a join is planned by the size of files, and rows of few different values take many
    times that in the memory of the driver, which builds what is sent. Count written tables only.
    """
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def first_location(locations: Column) -> Column:
    """First data location of a job; NULL for an empty list."""
    return F.try_element_at(locations, F.lit(1))


def semi_data_site(jobs: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Jobs whose first data location is an allowed site."""
    keyed = jobs.withColumn("cms_site", F.lower(first_location(F.col("DataLocations"))))
    return keyed.join(allowlist.select("cms_site"), "cms_site", "left_semi").drop("cms_site")


def semi_work_site(jobs: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Jobs that ran at an allowed site."""
    keyed = jobs.withColumn("cms_site", F.lower("Site"))
    return keyed.join(allowlist.select("cms_site"), "cms_site", "left_semi").drop("cms_site")


def join_site_names(jobs: DataFrame, site_map: DataFrame) -> DataFrame:
    """Add ``src`` (work site, lower case), ``dest`` (data site as written) and the grid names of both."""
    work = site_map.select(F.col("cms_site").alias("src"), F.col("grid_site").alias("grid_src"))
    data = site_map.select(F.col("cms_site").alias("_data"), F.col("grid_site").alias("grid_dest"))
    return (
        jobs.withColumn("src", F.lower("Site"))
        .withColumn("dest", first_location(F.col("DataLocations")))
        .withColumn("_data", F.lower("dest"))
        .join(work, "src")
        .join(data, "_data")
        .drop("_data")
    )


def likely_pairs(probes: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Probes whose pair may be among ``pairs``: a filter of at most ``PAIR_HASHES`` hashes, tested
    where the probes are scanned. It lets few others through as long as pairs are fewer than hashes."""

    def hashed() -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(PAIR_HASHES)).cast("int")

    found = [r[0] for r in pairs.select(hashed().alias("_pair")).distinct().collect()]
    held = probes.sparkSession.createDataFrame([(h,) for h in found], "_pair int")
    return probes.withColumn("_pair", hashed()).join(F.broadcast(held), "_pair", "left_semi").drop("_pair")


def semi_probe_pairs(probes: DataFrame, named_jobs: DataFrame) -> DataFrame:
    """Probes between pairs of sites that have jobs.

    The pairs are written, so their size is known when the join is planned: it is broadcast when
    small, and no exchange moves the probes. Otherwise only probes that pass the filter move.
    """
    keys = ["srcSite", "destSite"]
    named = named_jobs.select(F.col("grid_src").alias("srcSite"), F.col("grid_dest").alias("destSite"))
    pairs = stored(named.distinct(), "job-pairs")
    return likely_pairs(probes, pairs, keys).join(pairs, keys, "left_semi")


def pairs_present(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Non-empty key combinations with their row counts."""
    return summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
