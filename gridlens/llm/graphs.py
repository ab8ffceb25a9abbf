"""Connected components by minimum labels and pointer jumping, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node it reaches) of all nodes in ``links`` (``a``, ``b``).

    Every round takes the smallest label among the neighbours and then the label's own label, so
    the number of rounds grows with the logarithm of the longest path. Minima are pre-aggregated
    before each shuffle: a node with very many links does not fill one task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near")
        )
        lower = labels.join(seen, "node").select("node", F.least("label", "near").alias("low"), "label")
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        moved = lower.join(up, "low").select("node", F.least("low", "jump").alias("label"), F.col("label").alias("was"))
        moved = written(moved, "labels")
        changed = moved.filter("label <> was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
