"""Grouped regressions of two responses on one driver, and effect counters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.regression import fit, moments
from gridlens.operators.filters import significant


def regress(df: DataFrame, keys: list[str], x: str, responses: dict[str, str]) -> DataFrame:
    """One row per group: for every prefix -> y column the fit of y on x.

    Columns per prefix: ``n, slope, intercept, r, p, stderr``.
    """
    sums = df.groupBy(*keys).agg(
        *[c for prefix, y in responses.items() for c in moments(F.col(y), F.col(x), prefix)]
    )
    fields = ["n", "slope", "intercept", "r", "p", "stderr"]
    return fit(sums, list(responses)).select(*keys, *[p + f for p in responses for f in fields])


def with_significance(fits: DataFrame) -> DataFrame:
    """Add ``significant``: both responses have a p-value below the threshold."""
    return fits.withColumn("significant", significant(F.col("c_p"), F.col("e_p")))


def opposed() -> Column:
    """The two responses move in opposite directions."""
    return ((F.col("c_slope") > 0) & (F.col("e_slope") < 0)) | (
        (F.col("c_slope") < 0) & (F.col("e_slope") > 0)
    )


def negative() -> Column:
    """The first response falls as the driver grows."""
    return F.col("c_slope") < 0


def effect_counts(
    fits: DataFrame, present: DataFrame, effect: Column, key_kinds: dict[str, Column]
) -> DataFrame:
    """Significant fits showing an effect, per key of every kind: ``key_kind, key, hits, total``.

    ``present`` holds the rows whose keys are listed even without a hit. ``total`` counts all
    significant fits, once each.
    """
    kinds = F.array(
        *[F.struct(F.lit(kind).alias("key_kind"), key.alias("key")) for kind, key in key_kinds.items()]
    )
    sig = fits.filter("significant")
    hits = (
        sig.filter(effect)
        .select(F.inline(kinds))
        .groupBy("key_kind", "key")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    listed = present.select(F.inline(kinds)).distinct()
    total = sig.agg(F.count(F.lit(1)).alias("total"))
    return listed.join(hits, ["key_kind", "key"], "left").select(
        "key_kind", "key", F.coalesce("hits", F.lit(0)).alias("hits"), total.scalar().alias("total")
    )


def effect_shares(counts: DataFrame) -> DataFrame:
    """Each counter's share of the significant fits, and the overall share.

    A hit counts once for each key kind it has, so with two kinds the overall share reaches 2.0.
    Shares are NULL when nothing is significant.
    """
    overall = counts.agg(
        F.lit("overall").alias("key_kind"),
        F.lit("Total").alias("key"),
        F.sum("hits").alias("hits"),
        F.max("total").alias("total"),
    )
    return counts.unionByName(overall).withColumn("share", F.try_divide("hits", "total"))


def data_site_share(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the analysed groups per data site, before any significance test."""
    groups = summary.select(*keys).distinct()
    total = groups.agg(F.count(F.lit(1)).alias("total"))
    return (
        groups.groupBy("dest")
        .agg(F.count(F.lit(1)).alias("groups"))
        .withColumn("share", F.try_divide(F.col("groups"), total.scalar()))
    )
