"""Compression classifier: a text is as good as the dictionary of good texts shortens it better.

Two zstandard dictionaries are built from pieces of labelled good and bad texts. Every whole text is
compressed in pieces of ``PIECE`` bytes with each of them and with none; the size with the bad
dictionary less the size with the good one, per byte, and the logarithm of the plain rate become a
score by logistic regression. Pieces keep what a long text learns of itself from hiding what the
dictionaries know, and bound the memory of a call.

Labels are used in a sample of at most ``SAMPLE`` texts a class, those of smallest hash, and only of
rows whose crc32 of the id leaves no ``HELD_OUT`` modulo ``FOLDS``. Each of the other remainders is
scored by dictionaries of the rest to fit the regression; the final dictionaries use them all. Too
few pieces to train a dictionary are used as its content instead. A sampled text weighs as many texts
as its class has for each one sampled, so the sample's size does not set the odds of the classes.

Defined results: a null or empty text scores the share of good labels (a half without labels),
counted over all labelled texts that are not held out; so do all texts when a class has no labelled text; a null id is not held out; a null label is none, of
several labels of one id the smallest counts; repeated rows are scored alike; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.common import raw, table, texts

PIECE = 1024
LEVEL = 9
DICTIONARY_BYTES = 32768
# Labelled texts of a class used for fitting, pieces taken from each and their size.
SAMPLE = 2000
SAMPLE_PIECES = 6
SAMPLE_PIECE = 512
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.7


@dataclass
class Model:
    """Dictionaries, the regression (intercept and weights) and the score of an empty text."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] | None
    share: float


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % FOLDS


def dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICTIONARY_BYTES]


def _compressors(*dictionaries: bytes) -> list[zstandard.ZstdCompressor]:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    made = [zstandard.ZstdCompressor(level=LEVEL, **plain)]
    for data in dictionaries:
        known = zstandard.ZstdCompressionDict(data)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=known, **plain))
    return made


def _features(body: memoryview, compressors: list[zstandard.ZstdCompressor]) -> tuple[float, float]:
    """The difference of the compressed sizes per byte and the logarithm of the plain rate."""
    n = len(body)
    plain, good, bad = (
        sum(len(c.compress(body[i : i + PIECE])) for i in range(0, n, PIECE)) for c in compressors
    )
    return (bad - good) / (n + 1), float(np.log(plain / (n + 1) + 0.01))


def _bodies(column: pa.Array) -> Iterator[memoryview]:
    data, at = raw(column)
    whole = memoryview(np.ascontiguousarray(data))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield whole[a:b]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some pieces of each labelled text, chosen from all of it by its hash."""
    names = ["quality", "fold", "key", "pieces"]
    for batch in batches:
        keys, chosen = [], []
        for body in _bodies(batch.column(2)):
            key = xxhash.xxh3_64_intdigest(body)
            starts = range(0, len(body), SAMPLE_PIECE)
            some = random.Random(key).sample(starts, min(len(starts), SAMPLE_PIECES))
            keys.append(key - (1 << 63))
            chosen.append([bytes(body[i : i + SAMPLE_PIECE]) for i in some])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(chosen, pa.list_(pa.binary()))], names
        )


def _fold_features(dictionaries: dict[int, tuple[bytes, bytes]]):
    """Features of each labelled text by the dictionaries that have not seen its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {f: _compressors(*pair) for f, pair in dictionaries.items()}
        for batch in batches:
            folds = batch.column(1).to_pylist()
            found = []
            for f, body in zip(folds, _bodies(batch.column(2)), strict=True):
                known = len(body) and f in made
                found.append((xxhash.xxh3_64_intdigest(body) - (1 << 63), *(_features(body, made[f]) if known else (None, None))))
            kinds = (pa.int64(), pa.float64(), pa.float64())
            columns = [pa.array([x[j] for x in found], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["quality", "key", "difference", "rate"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, stands_for: np.ndarray, rounds: int = 30, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton steps on standardised features, a row as often as it ``stands_for``; the weights returned
    are for the features as they are."""
    mean = np.average(x, 0, stands_for)
    spread = np.sqrt(np.average((x - mean) ** 2, 0, stands_for)) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = (a * (stands_for * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w += np.linalg.solve(curve, a.T @ (stands_for * (y - p)) - ridge * w)
    own = w[1:] / spread
    return float(w[0] - own @ mean), *own.tolist()


def _limited(rows: DataFrame, sample: int) -> pd.DataFrame:
    """At most ``sample`` rows of each class, those of smallest hash."""
    found = [rows.filter(F.col("quality") == q).orderBy("key").limit(sample).toPandas() for q in (0, 1)]
    return pd.concat(found, ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Dictionaries and regression from labelled texts that are not held out."""
    known = (
        labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .filter(fold(F.col("doc_id")) != HELD_OUT)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    # Labelled texts of each class, of which the sample below is a part: two rows.
    copies = texts(docs, id_col, text_col).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    counted = copies.join(known, "doc_id").groupBy("quality").agg(F.sum("n").alias("n")).collect()
    total = {r["quality"]: r["n"] for r in counted}
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = [known.filter(F.col("quality") == q).orderBy(*order).limit(sample) for q in (0, 1)]
    # At most 2 * sample rows of two numbers.
    few = F.broadcast(some[0].unionByName(some[1]))
    rows = texts(docs, id_col, text_col).join(few, "doc_id")
    rows = rows.select("quality", fold(F.col("doc_id")).cast("int").alias("fold"), "text")

    taken = _limited(rows.mapInArrow(_pieces, "quality int, fold int, key bigint, pieces array<binary>"), sample)
    by_class: dict[tuple[int, int], list[bytes]] = {}
    for q, f, pieces in taken[["quality", "fold", "pieces"]].itertuples(index=False):
        by_class.setdefault((q, f), []).extend(map(bytes, pieces))
    folds = sorted({f for _, f in by_class})

    def built(skipped: int | None) -> tuple[bytes, bytes]:
        return tuple(
            dictionary([x for f in folds if f != skipped for x in by_class.get((q, f), [])]) for q in (1, 0)
        )

    share = total.get(1, 0) / sum(total.values()) if total else 0.5
    model = Model(*built(None), None, share)
    pairs = {f: built(f) for f in folds}
    pairs = {f: pair for f, pair in pairs.items() if all(pair)}
    schema = "quality int, key bigint, difference double, rate double"
    measured = _limited(rows.mapInArrow(_fold_features(pairs), schema), sample).dropna()
    if measured["quality"].nunique() == 2:
        sampled = taken["quality"].value_counts()
        stands_for = measured["quality"].map({q: n / sampled[q] for q, n in total.items() if q in sampled})
        model.weights = _logistic(
            measured[["difference", "rate"]].to_numpy(), measured["quality"].to_numpy(float), stands_for.to_numpy(float)
        )
    return model


def _scores(model: Model, column: pa.Array, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    out = np.full(len(column), model.share)
    if model.weights:
        start, *weights = model.weights
        for i, body in enumerate(_bodies(column)):
            if len(body):
                found = start + float(np.dot(weights, _features(body, compressors)))
                out[i] = 1 / (1 + np.exp(-np.clip(found, -30, 30)))
    return out


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _compressors(model.good, model.bad) if model.weights else []
        for batch in batches:
            found = pa.array(_scores(model, batch.column(1), made))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _compressors(model.good, model.bad) if model.weights else []
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            keep = pa.array(_scores(model, column, made) >= threshold)
            yield batch.select(batch.schema.names[:-1]).filter(keep)

    # Positions, not names, tell the columns apart.
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select("*", body.alias("__body")).mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
