"""Token ids in ORC files: run-length encoded stripes, row indexes and Bloom filters on document ids.

``write_tokens`` encodes every document, ``read_tokens`` reads chosen ones with stripe and row-group
pruning, ``token_index`` reads everything back and gives each document its place in the id stream.

Defined results: a null text is empty and has the end id alone; null ids sort first; repeated rows
are separate documents; other columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlens.llm.common import fresh_path, passes, raw, table, texts, written
from gridlens.llm.words import PieceArena

SCHEMA = "doc_id bigint, ids array<int>"
# Rows between two entries of the row index, and the bytes of a stripe before compression.
INDEX_STRIDE = 1000
STRIPE_BYTES = 32 << 20

_TABLES: dict[tuple[str, int], PieceArena] = {}
# White space ends a piece of the tokenizer; so does the end of a run of Latin letters before an
# ASCII character. Other white space and letters stay inside a piece and are left to the library.
_CUT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\x00-\x7f]|\Z)|[^ \n]+")
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
# Words of one call to the library.
_TOGETHER = 2000


def _table(path: str, end_id: int) -> PieceArena:
    if (path, end_id) not in _TABLES:
        library = Tokenizer.from_file(path)
        last = np.zeros(library.get_vocab_size(with_added_tokens=True), bool)
        last[[i for token, i in library.get_vocab().items() if token.endswith("</w>")]] = True

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Plain words go to the library many at a time, as one text: each ends with the one
            id that ends a word. Everything else goes piece by piece."""
            is_plain = np.fromiter(map(bool, map(_PLAIN, pieces)), bool, len(pieces))
            plain = list(map(pieces.__getitem__, np.flatnonzero(is_plain).tolist()))
            other = list(map(pieces.__getitem__, np.flatnonzero(~is_plain).tolist()))
            lines = [" ".join(plain[a : a + _TOGETHER]) for a in range(0, len(plain), _TOGETHER)]
            whole = [np.array(x.ids, np.int32) for x in library.encode_batch_fast(lines, add_special_tokens=False)]
            single = [np.array(x.ids, np.int32) for x in library.encode_batch_fast(other, add_special_tokens=False)]
            words = np.concatenate([*whole, np.zeros(0, np.int32)])
            lengths = np.empty(len(pieces), np.int64)
            lengths[is_plain] = np.diff(np.flatnonzero(last[words]), prepend=-1)
            lengths[~is_plain] = [len(x) for x in single]
            # Back into the order of the pieces.
            out = np.empty(lengths.sum(), np.int32)
            of_plain = np.repeat(is_plain, lengths)
            out[of_plain], out[~of_plain] = words, np.concatenate([*single, np.zeros(0, np.int32)])
            return out, lengths

        _TABLES[path, end_id] = PieceArena(encode, end_id)
    return _TABLES[path, end_id]


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _table(path, end_id)
        for batch in batches:
            column = batch.column(1)
            for a, b in passes(np.diff(raw(column)[1])):
                rows = [_CUT.findall(x) for x in column.slice(a, b - a).to_pylist()]
                values, ends = known.gather(rows)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["doc_id", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode ``docs`` and write ids in ascending document order, one file for each range of ids.

    ``tokenizer``: file of a tokenizer whose pieces never hold white space. Texts are dealt out by
    range of (id, text hash), so a repeated id does not fill one task.
    """
    ordered = (
        texts(docs, id_col, text_col)
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    )
    (
        ordered.mapInArrow(_encoder(tokenizer, end_id), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("compression", "snappy")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of the files; with ``doc_ids`` only stripes and row groups that may hold them."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        at = ids.offsets.to_numpy()
        whole = memoryview(values).cast("B")
        crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "file", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document in the files.

    ``start`` is a two-level running sum: within each file, after the total of the files before it.
    """
    rows = read_tokens(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"))
    kept = rows.mapInArrow(_digest, "doc_id bigint, file string, n_tokens bigint, ids_crc32 bigint")
    kept = written(kept, "token-index")
    sums = kept.groupBy("file").agg(
        F.sum("n_tokens").alias("tokens"),
        F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"),
    )
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = sums.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("files_before"))
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32"]
    inside = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        kept.withColumn("rows_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(files, "file")
        .select("doc_id", (F.col("files_before") + F.col("rows_before")).alias("start"), "n_tokens", "ids_crc32")
    )


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_index(spark, path)
