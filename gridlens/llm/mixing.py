"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source has a word target. Among all rates of documents that meet it, the entropy-balanced
ones differ least from 1: ``min(cap, exp(tilt * size / mean size))``, where the source's ``tilt``
solves the convex dual of its word constraint. The dual is solved for all sources at once by Newton
steps, each one aggregation over the counts of document sizes, kept inside a bracket by bisection.
Rates are rounded into copies by a hash of each document's id and text; one threshold per source, found
by refining histograms, brings the taken words below the target, and the largest copies that still fit
fill what is left.

Defined results: a null text has size 0 and takes nothing; null sources are one source, the last; null
ids are told apart by their texts; rows of equal id, source and text are separate documents with equal
copies, so a source of nothing else is taken in whole multiples; other columns are ignored
(``mixed_rows`` keeps them, whatever their names); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.common import WORD, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
# Newton stops when every source is this near its target, or after so many steps.
NEAR = 1e-7
STEPS = 60
# Bins of each histogram that refines the rounding threshold, and how often it is refined.
BINS = 4096
REFINED = 3
# Copies that may fill the rest of a source's target, one after another.
FILLS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from (source, source_size).

    Weights repeat over the sources in code point order, null last. Sources are filled in the order
    in which they reach their cap; the level of the others is what is left over their weights.
    """
    all_rows = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    filled = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * cap)
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("full").over(earlier), F.lit(0))
    level = left / F.sum("weight").over(later)
    capped = filled.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("full"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(all_rows)
    return capped.select(
        "source", "source_size", "weight",
        F.when(F.col("capped") | final.isNull(), F.col("full").cast("double"))
        .otherwise(final * F.col("weight")).alias("target"),
    )


def _rate(cap: int) -> Column:
    tilted = F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))
    return F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("saturated"), F.lit(float(cap))).otherwise(F.exp(tilted))


def balance(counts: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """The tilt of every source: Newton on the dual over (source, size, documents)."""
    shape = counts.filter("size > 0").groupBy("source").agg(
        F.min("size").alias("least"), (F.sum(F.col("size") * F.col("documents")) / F.sum("documents")).alias("mean")
    )
    state = goals.alias("g").join(shape.alias("s"), F.expr("g.source <=> s.source")).select("g.*", "s.least", "s.mean")
    top = F.lit(math.log(cap)) * F.col("mean") / F.col("least")
    low = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) * F.col("mean") / F.col("least")
    state = state.withColumns(
        {"saturated": F.col("target") >= F.col("source_size") * cap, "tilt": F.lit(0.0), "low": low - 1, "high": top}
    )
    state = written(state, "mix-state")
    words = F.col("size") * F.col("documents")
    for _ in range(STEPS):
        rates = counts.alias("c").join(state.alias("s"), F.expr("c.source <=> s.source")).select(
            "s.*", "c.size", "c.documents"
        )
        sums = rates.withColumn("rate", _rate(cap)).groupBy(*state.columns).agg(
            F.sum(F.col("rate") * words).alias("taken"),
            F.sum(F.when(F.col("rate") < cap, F.col("rate") * words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        over = F.col("taken") - F.col("target")
        step = F.col("tilt") - F.try_divide(over, F.col("slope"))
        moved = sums.withColumns(
            {
                "gap": F.when(F.col("saturated"), F.lit(0.0)).otherwise(F.abs(over) / F.col("target")),
                "low": F.when(over < 0, F.col("tilt")).otherwise(F.col("low")),
                "high": F.when(over > 0, F.col("tilt")).otherwise(F.col("high")),
                "step": step,
            }
        )
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        middle = (F.col("low") + F.col("high")) / 2
        moved = moved.withColumn(
            "tilt", F.when(F.col("gap") <= NEAR, F.col("tilt")).when(inside, F.col("step")).otherwise(middle)
        )
        state = written(moved.select(*state.columns, "gap"), "mix-state")
        worst = state.agg(F.max("gap")).first()[0]
        state = state.drop("gap")
        if worst is None or worst <= NEAR:
            return state
    warnings.warn(f"rates are still {worst:.2g} from their targets after {STEPS} steps", stacklevel=2)
    return state


def _mark(j: int) -> Column:
    """Where the j-th copy of a document stands in the order in which its source takes copies."""
    return F.lit(float(j)) - (F.col("rate") + F.col("draw"))


def _rounded(cap: int) -> Column:
    """Copies up to the source's threshold, and those that fill the rest."""
    raised = [
        ((_mark(j) <= F.col("threshold")) | F.array_contains(F.col("filled"), _mark(j))).cast("bigint") for j in range(1, cap + 1)
    ]
    return F.when(F.col("size") == 0, F.lit(0)).otherwise(sum(raised[1:], raised[0]))


def _draw(id_col: str, text_col: str) -> Column:
    """A number in [0, 1) from a document's id and text; different texts have different ones."""
    hashed = F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return (hashed % F.lit(1 << 52)) / F.lit(float(1 << 53)) + F.lit(0.5)


def _thresholds(rows: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """The state with the rounding threshold of each source: words of copies in order of their
    threshold are summed by bins, and the bin where the sum passes the target is refined."""
    low, width = -2.0 - cap, 3.0 + 2 * cap
    marks = rows.filter("size > 0").select(
        "source", "size", F.explode(F.array(*[_mark(j) for j in range(1, cap + 1)])).alias("at")
    )
    found = state.select("source", F.lit(low).alias("from"), F.lit(width).alias("span"), F.lit(0).cast("bigint").alias("below"), "target")
    for _ in range(REFINED):
        bins = (
            marks.alias("m").join(found.alias("f"), F.expr("m.source <=> f.source"))
            .select("f.*", "m.at", "m.size")
            .withColumn("bin", F.floor((F.col("at") - F.col("from")) / F.col("span") * BINS))
            .filter(F.col("bin").between(0, BINS - 1))
            .groupBy("source", "from", "span", "below", "target", "bin")
            .agg(F.sum("size").alias("words"))
        )
        order = Window.partitionBy("source").orderBy("bin")
        through = bins.withColumn("through", F.col("below") + F.sum("words").over(order))
        # The first bin that reaches the target; the last one where none does.
        chosen = through.withColumn("reaches", F.col("through") >= F.col("target")).groupBy("source", "from", "span", "target").agg(
            F.coalesce(F.min(F.when(F.col("reaches"), F.struct("bin", "through", "words"))), F.max(F.struct("bin", "through", "words"))).alias("hit")
        )
        found = written(
            chosen.select(
                "source",
                (F.col("from") + F.col("span") * F.col("hit.bin") / BINS).alias("from"),
                (F.col("span") / BINS).alias("span"),
                (F.col("hit.through") - F.col("hit.words")).alias("below"),
                "target",
                F.col("hit.through").alias("through"),
            ),
            "mix-threshold",
        )
    # All copies before the bin, or in it where even the last one does not pass the target.
    whole = F.col("through") <= F.col("target")
    edge = F.when(whole, F.col("from") + F.col("span")).otherwise(F.col("from"))
    cut = found.select(
        F.col("source").alias("of"), F.when(whole, edge).otherwise(edge - F.col("span") * 1e-6).alias("threshold"),
        (F.col("target") - F.when(whole, F.col("through")).otherwise(F.col("below"))).alias("gap"),
    )
    last = _filled(marks, written(cut.withColumn("filled", F.array().cast("array<double>")), "mix-cut"))
    joined = state.join(last.drop("gap"), F.expr("source <=> of"), "left").drop("of").fillna({"threshold": low + width})
    return joined.withColumn("filled", F.coalesce("filled", F.array().cast("array<double>")))


def _filled(marks: DataFrame, cut: DataFrame) -> DataFrame:
    """The cut with ``filled``: for each source, again and again the largest copies beyond the
    threshold that fit into what its target leaves."""
    for _ in range(FILLS):
        beyond = (
            marks.alias("m").join(cut.filter("gap >= 1").alias("c"), F.expr("m.source <=> c.of"))
            .filter("m.at > c.threshold AND m.size <= c.gap AND NOT array_contains(c.filled, m.at)")
            .groupBy("c.of", "c.gap", "m.at").agg(F.sum("m.size").alias("words"))
            .filter("words <= gap")
            .groupBy("of").agg(F.max(F.struct("words", "at")).alias("best"))
        )
        found = written(beyond.select(F.col("of").alias("source"), "best"), "mix-fill")
        if found.isEmpty():
            break
        fits = F.col("best").isNotNull()
        cut = written(
            cut.join(found, F.expr("of <=> source"), "left").select(
                "of", "threshold",
                F.when(fits, F.col("gap") - F.col("best.words")).otherwise(F.col("gap")).alias("gap"),
                F.when(fits, F.array_append("filled", F.col("best.at"))).otherwise(F.col("filled")).alias("filled"),
            ),
            "mix-cut",
        )
    return cut


def mix_plan(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
             weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The sized documents and one row of mixing parameters per source, both written once."""
    size = word_count(F.col(text_col))
    rows = written(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            size.alias("size"), _draw(id_col, text_col).alias("draw"),
        ),
        "mix-sizes",
    )
    counts = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("documents")), "mix-counts")
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    goals = written(targets(sizes, weights, share, cap), "mix-targets")
    state = balance(counts, goals, cap)
    rated = _with_state(rows, state, cap)
    plan = _thresholds(rated, state, cap)
    full = goals.alias("g").join(
        plan.select(F.col("source").alias("of"), "tilt", "mean", "saturated", "threshold", "filled").alias("p"),
        F.expr("g.source <=> p.of"), "left",
    ).drop("of")
    return rows, written(full, "mix-plan")


def _with_state(rows: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    own = state.select(F.col("source").alias("of"), *[c for c in state.columns if c != "source"])
    return rows.join(own, F.expr("source <=> of"), "left").drop("of").withColumn("rate", _rate(cap))


def mix_sources(docs: DataFrame, cap: int = CAP, **options) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``rate``, ``copies``."""
    rows, plan = mix_plan(docs, cap=cap, **options)
    return _with_state(rows, plan, cap).withColumn("copies", _rounded(cap)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies"
    )


def mixed_rows(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
               cap: int = CAP) -> DataFrame:
    """``docs`` with every row as often as the mix takes it. Documents of size 0 have no words to
    mix and stay once. Only the parameters of the sources are joined; texts are not shuffled."""
    _, plan = mix_plan(docs, source_col, text_col, id_col, cap=cap)
    own = plan.select(F.struct("source", "tilt", "mean", "saturated", "threshold", "filled").alias("plan"))
    # The whole row is one column, so no name of its can clash.
    whole = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col(source_col).cast("string").alias("of"),
        word_count(F.col(text_col)).alias("size"), _draw(id_col, text_col).alias("draw"),
    )
    joined = whole.join(own, F.col("of").eqNullSafe(F.col("plan.source")), "left").select("doc", "size", "draw", "plan.*")
    copies = joined.withColumn("rate", _rate(cap)).withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(_rounded(cap)))
    return copies.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
