"""Where the pieces of intervals go: salted places found from one measurement of the load.

A place is a (site pair, bucket). Loads are measured per series once, on a written table of pieces,
and reduced to two tables of bounded size: how many salts the places of a slot need (a slot is a hash
of the place, so there are at most ``SLOTS`` rows, whatever the data), and which hashes of series hold
a series too large for one task. Two places in one slot, or two series of one hash, only get more
salts or a finer way than they need; results do not depend on either table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 12
GIANT_HASHES = 1 << 16
PIECES_PER_TASK = 100_000


def _hashed(columns: list[str], size: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(size)).cast("int")


@dataclass(frozen=True)
class Placement:
    """Columns of a place and of a series in it, the number of tasks, and the two tables."""

    place: list[str]
    series: list[str]
    tasks: int
    parts: dict[int, int]
    giants: frozenset[int]

    @staticmethod
    def of(pieces: DataFrame, place: list[str], series: list[str], limit: int) -> Placement:
        """Measure ``pieces``: series above ``limit`` pieces are giants, the others of a slot get a
        salt for every ``limit`` pieces. A row per slot and per hash of giants comes to the driver."""
        loads = pieces.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"))
        giant = F.col("_n") > F.lit(limit)
        hashed = loads.select(
            "_n", F.when(giant, 0).otherwise(F.col("_n")).alias("_usual"), _hashed(place, SLOTS).alias("_slot"),
            F.when(giant, _hashed(series, GIANT_HASHES)).alias("_giant"),
        )
        sums = F.sum("_n").alias("total"), F.sum("_usual").alias("usual")
        rows = hashed.groupingSets([["_slot"], ["_giant"]], "_slot", "_giant").agg(*sums).collect()
        slots = [r for r in rows if r["_slot"] is not None]
        total = sum(r.total for r in slots)
        parts = {r["_slot"]: -(-r.usual // max(limit, 1)) for r in slots}
        cores = pieces.sparkSession.sparkContext.defaultParallelism
        return Placement(
            place, series, max(cores, -(-total // PIECES_PER_TASK)),
            {slot: n for slot, n in parts.items() if n > 1}, frozenset(r["_giant"] for r in rows if r["_giant"] is not None),
        )

    def _with_parts(self, df: DataFrame) -> DataFrame:
        """Add ``_parts``, the number of salts of the row's place."""
        if not self.parts:
            return df.withColumn("_parts", F.lit(1))
        table = df.sparkSession.createDataFrame(list(self.parts.items()), "_slot int, _salts int")
        slotted = df.withColumn("_slot", _hashed(self.place, SLOTS)).join(F.broadcast(table), "_slot", "left")
        return slotted.withColumn("_parts", F.coalesce("_salts", F.lit(1))).drop("_slot", "_salts")

    def salted(self, df: DataFrame) -> DataFrame:
        """Add ``salt``: the series of a place are dealt to its salts."""
        salt = F.pmod(F.xxhash64(F.lit("salt"), *self.series), F.col("_parts")).cast("int")
        return self._with_parts(df).withColumn("salt", salt).drop("_parts")

    def copied(self, df: DataFrame) -> DataFrame:
        """A row per salt of the row's place, to meet all its series."""
        salts = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("salt")
        return self._with_parts(df).select(*df.columns, salts)

    def placed(self, df: DataFrame) -> DataFrame:
        """Shuffle rows with a salt to their place."""
        return df.repartition(self.tasks, *self.place, "salt")

    def split(self, pieces: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Pieces of series that fit a task, and those of giants if there are any."""
        if not self.giants:
            return pieces, None
        table = pieces.sparkSession.createDataFrame([(h, True) for h in self.giants], "_hash int, _giant boolean")
        marked = pieces.withColumn("_hash", _hashed(self.series, GIANT_HASHES)).join(F.broadcast(table), "_hash", "left")
        usual = marked.filter(F.col("_giant").isNull()).drop("_hash", "_giant")
        return usual, marked.filter("_giant").drop("_hash", "_giant")
