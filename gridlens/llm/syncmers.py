"""Document fingerprints of closed syncmers, matched by position.

A window of ``K`` bytes is an anchor if the smallest hash among its inner ``S``-byte substrings is at
its first or last place. That depends on the window alone, so an edit moves no anchor outside the
windows it touches.

The likeness of two texts matches all their anchors by position: equal anchors are paired by how often
they stood before, the longest chain of pairs whose places rise in both texts is kept, and the likeness
is the part of the bytes under anchors that lies under the chain. A fingerprint is what is stored and
looked up for a document: the ``KEPT`` smallest anchor hashes of the whole text.

Defined results: a null text is empty, with an empty fingerprint; a text shorter than ``K`` bytes
has one anchor, its whole text; texts of the same anchors, also two empty ones, have likeness 1, an
empty and a filled one 0; documents of one id, or without one, follow each other by the hash of their
text; null ids come last; other columns are ignored; an empty table gives an empty result; the only
document is its own next one.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.common import PASS_BYTES, passes, raw, sliding_min, table, texts, window_hashes

K = 20
S = 8
KEPT = 128
# Ranges of ids for each shuffle partition; a range needs one borrowed text.
RANGES = 4


def anchor_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a byte array."""
    if len(data) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = window_hashes(data, S)
    width = K - S + 1
    low = sliding_min(inner, width)
    at = np.flatnonzero((low == inner[: len(low)]) | (low == inner[width - 1 :]))
    return at, window_hashes(data, K)[at]


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The KEPT smallest distinct hashes, ascending; copies of one hash may fill a first cut."""
    cut = 4 * KEPT
    if len(hashes) > cut:
        low = np.unique(np.partition(hashes, cut)[:cut])
        if len(low) >= KEPT:
            return low[:KEPT]
    return np.unique(hashes)[:KEPT]


def anchor_lists(bodies: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of all anchors of each text; a text shorter than ``K`` is one anchor."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.array([len(x) for x in bodies], np.int64)
    for a, b in passes(sizes) if len(bodies) else ():
        if b - a == 1 and sizes[a] > PASS_BYTES:
            out.append(_long(bodies[a]))
            continue
        at, hashes = anchor_places(np.frombuffer(b"".join(bodies[a:b]), np.uint8))
        starts = np.cumsum(sizes[a:b]) - sizes[a:b]
        first = np.searchsorted(at, starts)
        last = np.searchsorted(at, starts + sizes[a:b] - K, "right")
        for body, start, i, j in zip(bodies[a:b], starts.tolist(), first.tolist(), last.tolist(), strict=True):
            if 0 < len(body) < K:
                out.append((np.zeros(1, np.int64), np.array([xxhash.xxh3_64_intdigest(body)], np.uint64)))
            else:
                out.append((at[i:j] - start, hashes[i:j]))
    return out


def _long(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a very long text, overlapping by a window less one byte."""
    found = []
    for a in range(0, len(body) - K + 1, PASS_BYTES):
        places, hashes = anchor_places(np.frombuffer(body, np.uint8)[a : a + PASS_BYTES + K - 1])
        found.append((places + a, hashes))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Upper halves of the smallest anchor hashes."""
    return (_smallest(hashes) >> np.uint64(32)).astype(">u4")


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Each anchor's hash mixed with how often it stood before; all are different."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    before = np.empty(len(hashes), np.uint64)
    before[order] = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    return hashes + before * np.uint64(0x9E3779B97F4A7C15)


def _rising(values: np.ndarray) -> np.ndarray:
    """Places of a longest strictly rising chain."""
    if not len(values) or (values[1:] > values[:-1]).all():
        return np.arange(len(values))
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values.tolist()):
        j = bisect_left(tops, v)
        before[i] = ends[j - 1] if j else -1
        tops[j : j + 1], ends[j : j + 1] = [v], [i]
    chain, i = [], ends[-1]
    while i >= 0:
        chain.append(i)
        i = before[i]
    return np.array(chain[::-1])


def _covered(places: np.ndarray, size: int) -> int:
    """Bytes under windows that begin at rising places of a text."""
    if not len(places):
        return 0
    return int(np.minimum(np.diff(places), K).sum()) + min(K, size - int(places[-1]))


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int]) -> float:
    """Part of the bytes under anchors that the chain of matched anchors covers, in both texts."""
    if np.array_equal(x[1], y[1]):
        return 1.0
    if not len(x[1]) or not len(y[1]):
        return 0.0
    _, i, j = np.intersect1d(_numbered(x[1]), _numbered(y[1]), assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    order = np.argsort(x[0][i])
    own, other = x[0][i][order], y[0][j][order]
    chain = _rising(other)
    held = _covered(own[chain], sizes[0]) + _covered(other[chain], sizes[1])
    return held / (_covered(x[0], sizes[0]) + _covered(y[0], sizes[1]))


def edited(text: str, following: str) -> str:
    """The second half of the code points replaced by the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def _search(bounds: list[int], value: Column) -> Column:
    """How many bounds are at most the value, by two short scans of literal arrays."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    literal = F.array(*[F.array(*map(F.lit, x)) for x in blocks])
    block = F.size(F.filter(F.array(*[F.lit(x[0]) for x in blocks]), lambda b: b <= value))
    inside = F.size(F.filter(F.element_at(literal, F.greatest(block, F.lit(1))), lambda b: b <= value))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)


OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range, borrowed last, in order: each row meets the next one of its range."""
    names = [x.split()[0] for x in OUT.split(", ")]
    held = None
    for batch in batches:
        for a, b in passes(np.diff(raw(batch.column(3))[1])):
            borrowed, ids, texts_ = (batch.column(i).slice(a, b - a).to_pylist() for i in (1, 2, 3))
            bodies = [x.encode("utf-8") for x in texts_]
            rows = list(zip(borrowed, ids, texts_, bodies, anchor_lists(bodies), strict=True))
            if held is not None:
                rows.insert(0, held)
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[0]]
            held = rows[-1]
            changed = [edited(x[2], y[2]).encode("utf-8") for x, y in pairs]
            own = anchor_lists(changed)
            columns = [
                [x[1] for x, _ in pairs],
                [len(x[2]) for x, _ in pairs],
                [hashlib.sha256(c).hexdigest() for c in changed],
                [fingerprint(x[4][1]).tobytes().hex() for x, _ in pairs],
                [fingerprint(e[1]).tobytes().hex() for e in own],
                [likeness(x[4], e, (len(x[3]), len(c))) for (x, _), e, c in zip(pairs, own, changed, strict=True)],
                [likeness(x[4], y[4], (len(x[3]), len(y[3]))) for x, y in pairs],
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next.

    Ids are cut into ranges at quantiles; an id (or null) of more rows than a range is cut by the hash
    of its texts. Each range is sorted in one task and borrows the first document of the range that
    follows (the last range that of the first one), so texts are shuffled once and no task sees more
    than its range.
    """
    spark = docs.sparkSession
    docs = texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    found = docs.agg(
        F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts"), F.count(F.lit(1)).alias("n")
    ).first()
    fill = max(1, found.n // parts)
    # At most one id for each range has more rows than a range.
    crowded = {r.doc_id: -(-r.n // fill) for r in counts.filter(F.col("n") > fill).collect()}
    alone = {c for h in crowded if h is not None for c in (h, h + 1) if c < 1 << 63}
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_search(sorted({*(found.cuts or []), *alone}), F.col("doc_id")))
    pieces = spark.createDataFrame(list(crowded.items()) or [(None, 1)], "crowd bigint, pieces int")
    share = F.col("hash") / F.lit(2.0**64) + F.lit(0.5)
    ranged = (
        docs.join(F.broadcast(pieces), F.expr("doc_id <=> crowd"), "left")
        .withColumn("piece", F.coalesce(F.least(F.floor(share * F.col("pieces")), F.col("pieces") - 1), F.lit(0)))
        .select(F.struct((-place).alias("place"), F.col("piece").cast("int").alias("piece")).alias("part"), "doc_id", "hash", "text")
    )
    first = F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id")).alias("down"), "hash", "doc_id")
    # One row per range.
    heads = sorted(ranged.groupBy("part").agg(F.min(first).alias("head")).collect())
    loans = [(p.part, q.head.doc_id, q.head.hash) for p, q in zip(heads, heads[1:] + heads[:1], strict=True)]
    to = spark.createDataFrame(loans, "part struct<place:int,piece:int>, head bigint, head_hash bigint")
    lent = docs.join(F.broadcast(to.select("head", "head_hash").distinct()), F.expr("doc_id <=> head and hash = head_hash"), "left_semi")
    lent = lent.groupBy("doc_id", "hash").agg(F.min("text").alias("text"))
    borrowed = to.join(lent, F.expr("head <=> doc_id and head_hash = hash")).select(
        "part", F.lit(True).alias("borrowed"), "doc_id", "text", "hash"
    )
    every = ranged.select("part", F.lit(False).alias("borrowed"), "doc_id", "text", "hash").unionByName(borrowed)
    placed = every.repartition("part").sortWithinPartitions(
        "part", "borrowed", F.col("doc_id").desc_nulls_last(), "hash", "text"
    )
    return placed.mapInArrow(_compare, OUT)


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``position`` (byte), ``anchor``: all closed syncmers, for positional matching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if 0 < b - a < K:
                    whole = np.array([xxhash.xxh3_64_intdigest(data[a:b].tobytes())], np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, 1), pa.array([0], pa.int64()), pa.array(whole.view(np.int64))],
                        ["doc_id", "position", "anchor"],
                    )
                    continue
                for c in range(a, max(a, b - K) + 1, PASS_BYTES):
                    places, hashes = anchor_places(data[c : min(b, c + PASS_BYTES + K - 1)])
                    ids = pa.array([batch.column(0)[row].as_py()] * len(places), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(places + (c - a)), pa.array(hashes.view(np.int64))],
                        ["doc_id", "position", "anchor"],
                    )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, position bigint, anchor bigint")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
