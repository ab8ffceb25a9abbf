"""Statistics of sorted groups of pieces, computed for all metrics and all segments of a group at once.

Spark deals the groups to tasks and sorts their rows; a task gets them as Arrow batches and holds one
group and one batch of results. Every metric of a group is sorted once: the members of a segment are a
mask over that order, so ranks are counted and no value is copied to its cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Values looked at together, and rows of a batch of results: they bound the memory of a task.
VALUES = 1 << 19
ROWS = 4096


def grouped_runs(pieces: DataFrame, keys: list[str], metrics: list[str], step: int, stats: list[str]) -> DataFrame:
    """``keys``, ``_from``, ``_to`` and ``<stat><metric>`` per segment of every group of ``keys``.

    ``pieces`` have ``_first`` and ``_last``, their first and last cell, and lie with the rows of their
    group in one partition. A segment is a run of cells with the same pieces.
    """
    ordered = (
        pieces.select(*keys, "_first", "_last", *[F.col(m).cast("double").alias(m) for m in metrics])
        .withColumn("_hash", F.xxhash64(*keys))
        .sortWithinPartitions("_hash", *keys)
        .drop("_hash")
    )
    names = [stat + m for m in metrics for stat in stats]
    fields = [ordered.schema[k] for k in keys]
    fields += [T.StructField(c, T.LongType()) for c in ("_from", "_to")]
    fields += [T.StructField(c, T.DoubleType()) for c in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, keys):
            yield from _summarised(rows, starts, keys, metrics, step, stats)

    return ordered.mapInArrow(run, T.StructType(fields))


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows that begin another group than the row before."""
    begins = np.zeros(rows.num_rows, bool)
    begins[:1] = True
    for k in keys:
        codes = rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        begins[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(begins)


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the starts of these; the last group of a batch waits for the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        starts = _starts(rows, keys)
        held = rows.slice(starts[-1])
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _summarised(
    rows: pa.Table, starts: np.ndarray, keys: list[str], metrics: list[str], step: int, stats: list[str]
) -> Iterator[pa.RecordBatch]:
    first, last = (rows[c].to_numpy() for c in ("_first", "_last"))
    columns = [rows[m].combine_chunks() for m in metrics]
    values = np.array([c.to_numpy(zero_copy_only=False) for c in columns])
    known = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    owners = rows.select(keys)
    stops = np.append(starts[1:], rows.num_rows)
    owner, found, size = [], [], 0

    def batch() -> pa.RecordBatch:
        low, high, counts, numbers = (np.concatenate(part, axis=-1) for part in zip(*found, strict=True))
        taken = owners.take(pa.array(np.repeat(starts[owner], [len(f[0]) for f in found])))
        arrays = [taken[k].combine_chunks() for k in keys] + [pa.array(low), pa.array(high)]
        arrays += [
            pa.array(numbers[i, m], mask=counts[m] == 0) for m in range(len(metrics)) for i in range(len(stats))
        ]
        names = [*keys, "_from", "_to", *[stat + m for m in metrics for stat in stats]]
        return pa.RecordBatch.from_arrays(arrays, names)

    for g, (a, b) in enumerate(zip(starts, stops, strict=True)):
        found.append(segment_stats(first[a:b], last[a:b], values[:, a:b], known[:, a:b], step, stats))
        owner.append(g)
        size += len(found[-1][0])
        if size >= ROWS:
            yield batch()
            owner, found, size = [], [], 0
    if size:
        yield batch()


def segment_stats(
    first: np.ndarray, last: np.ndarray, values: np.ndarray, known: np.ndarray, step: int, stats: list[str]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of one group: first cells, ends, number of values per (metric, segment), and the
    numbers per (stat, metric, segment).

    ``values`` and ``known`` (not NULL) are given per (metric, piece). NaN lies above all numbers.
    """
    cuts = np.unique(np.concatenate([first, last + step]))
    low, high = cuts[:-1], cuts[1:]
    inside = (first <= low[:, None]) & (last >= low[:, None])
    covered = inside.any(axis=1)
    low, high, inside = low[covered], high[covered], inside[covered]
    size, runs = values.size, len(low)
    order = np.argsort(values, axis=1, kind="stable")
    ordered = np.take_along_axis(values, order, axis=1)
    present = np.take_along_axis(known, order, axis=1)
    counts = np.empty((len(values), runs), np.int64)
    numbers = np.empty((len(stats), len(values), runs))
    at_once = max(1, VALUES // max(size, 1))
    for a in range(0, runs, at_once):
        members = inside[a : a + at_once][:, order] & present  # (segment, metric, piece)
        count, parts = _numbers(members, ordered, stats)
        counts[:, a : a + at_once] = count.T
        for i, part in enumerate(parts):
            numbers[i, :, a : a + at_once] = part.T
    return low, high, counts, numbers


def _numbers(members: np.ndarray, ordered: np.ndarray, stats: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts and numbers per (segment, metric) of the values marked by ``members``."""
    metric = np.arange(len(ordered))
    upto = np.cumsum(members, axis=-1, dtype=np.int32)
    count = upto[..., -1].astype(np.int64)

    def at(rank: np.ndarray) -> np.ndarray:
        place = (upto <= rank[..., None]).sum(axis=-1)
        return ordered[metric, np.minimum(place, ordered.shape[1] - 1)]

    def median() -> np.ndarray:
        below, above = at((count - 1) // 2), at(count // 2)
        return np.where(below == above, below, 0.5 * below + 0.5 * above)

    with np.errstate(all="ignore"):
        if "mean" in stats or "std" in stats:
            mean = np.where(members, ordered, 0.0).sum(axis=-1) / count
        made: dict[str, Callable[[], np.ndarray]] = {
            "min": lambda: ordered[metric, members.argmax(axis=-1)],
            "max": lambda: ordered[metric, ordered.shape[1] - 1 - members[..., ::-1].argmax(axis=-1)],
            "mean": lambda: mean,
            "median": median,
            "std": lambda: np.sqrt(np.square(np.where(members, ordered - mean[..., None], 0.0)).sum(axis=-1) / count),
        }
        return count, [made[s]() for s in stats]
