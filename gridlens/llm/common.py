"""Helpers the operators share: column checks, batch slicing, word tables, hashing on byte arrays."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import shared_dir

# Text bytes one numpy pass works on; a pass needs about 60 bytes of memory per text byte.
PASS_BYTES = 1 << 20

# The white space of the word rule.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` alone, so that no other column can clash; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in the folder every executor shares."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet and read back: lineage ends here and lost executors
    recompute nothing before it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done with: it does so when the driver
    collects its garbage, which otherwise may be half an hour later. For operators whose written
    tables replace shuffles as large as their input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return a worker's freed memory to the system, at the end of a task that needed much of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def passes(sizes: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column as one array, and where each row begins (n + 1 offsets)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte: high bytes are zeros, which compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def numbers(data: bytes, width: int) -> np.ndarray:
    """What :func:`planes` was given."""
    held = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((held.shape[1], 8), np.uint8)
    out[:, :width] = held.T
    return out.view("<u8").ravel().astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEED = np.random.default_rng(20240229)
# One random odd word for each byte value.
BYTE_WORDS = mixed(_SEED.integers(1, 1 << 63, 256, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k``-byte windows, by doubling: 2, 4, 8 .. bytes, then the rest."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = {1: BYTE_WORDS[data]}
    width = 1
    while width * 2 <= k:
        h, shift = power[width], np.uint64(pow(_BASE, width, 1 << 64))
        power[width * 2] = h[:-width] * shift + h[width:]
        width *= 2
    out, done = power[width][:n].copy(), width
    while done < k:
        while width > k - done:
            width //= 2
        out = out * np.uint64(pow(_BASE, width, 1 << 64)) + power[width][done : done + n]
        done += width
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = np.minimum(out[:-rest], out[rest:])
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * PASS_BYTES)
        _POWERS[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]))
    return _POWERS[0][:n]


_INVERSE = pow(_BASE, -1, 1 << 64)
_INVERSES = [np.ones(1, np.uint64)]


def _inverses(n: int) -> np.ndarray:
    if len(_INVERSES[0]) < n:
        size = max(n, 2 * PASS_BYTES)
        _INVERSES[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE, np.uint64)]))
    return _INVERSES[0][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word (the ``WORD`` rule, A-Z only) of all rows, and the index of
    the first word of each row (n + 1 offsets)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    borders = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    starts[borders] = ~space[borders]
    begin = np.flatnonzero(starts)
    ends = ~space
    ends[:-1] &= space[1:]
    ends[borders - 1] = ~space[borders - 1]
    end = np.flatnonzero(ends) + 1
    terms = BYTE_WORDS[_LOWER[data]] * _powers(len(data))
    terms[space] = 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    # The sum from begin to end, moved back to power 0, does not depend on the word's place.
    hashes = (sums[end] - sums[begin]) * _inverses(len(data))[begin]
    hashes = mixed(hashes + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(begin, offsets).astype(np.int64)
