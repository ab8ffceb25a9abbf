"""Alignment of two tokenizers over a corpus, with an identity map for tokens of the same bytes.

Both tokenizers cut the bytes of the same text; offsets where both end a token cut the text into
groups, and the tokens that end a group together are linked. Most groups are one token beside one
token of the same bytes: for these an array computed from the two vocabularies gives the partner, and
counting is adding to a vector as long as the vocabulary. Only links of other groups, and those of
tokens whose bytes have two ids, are counted as pairs in a shuffle.

Between a word and the blanks before the next both tokenizers end a token, so the stretches from one
such place to the next are aligned once each and looked up again; a worker keeps a bounded table.

To judge the links of every document by the counts, the vectors and the most frequent pairs (a fixed
number) are sent to the documents. The pairs left are joined with their counts; each of them has at
most one in ``FREQUENT_PAIRS`` of all links, so no key of that join is hot.

Defined results: a null or empty text has no tokens, nor has a text that one of the tokenizers changes
(so that the bytes of its tokens are not those of the text); repeated rows are separate documents that
count each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlens.llm.byte_pairs import byte_symbols
from gridlens.llm.common import passes, raw, table, texts, written

# Pairs whose counts go to every task beside the vectors.
FREQUENT_PAIRS = 1 << 16
# Text bytes aligned at once, and characters that go to a tokenizer as one text.
PASS_BYTES = 1 << 20
JOINED_CHARS = 1 << 16
# Stretches a worker keeps, and their characters; both bound its memory (about 250 MB).
KEPT_STRETCHES = 400_000
KEPT_CHARS = 6_000_000

# A stretch: up to the last of some blanks' place that follows a word and leads to another word.
STRETCH = re.compile(r"\s*\S+(?:(?! +\S)\s+\S+)*(?:\s+\Z)?")

SCHEMA = (
    "doc_id bigint, is_vector boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " same array<int>, same_n array<bigint>, pairs array<bigint>, pairs_n array<bigint>"
)


class Vocabularies:
    """Token bytes of both tokenizers, and for each token of the first the one of the same bytes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        symbols = byte_symbols()
        self.a_text = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        special = {i: x.content for i, x in self.a.get_added_tokens_decoder().items()}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_text[i] = special[i].encode() if i in special else bytes(symbols[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # A piece that stands for no bytes of a text never agrees with one.
        hidden = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(len(pieces))]
        self.b_text = [
            b"" if hidden[i] else bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()
            for i, x in enumerate(pieces)
        ]
        # A piece of the second that went on over blanks after a word would join two stretches.
        self.stretches = not any(re.search("[^▁]▁", x) for x in pieces)
        self.a_length = np.array([len(x) for x in self.a_text], np.int64)
        self.b_length = np.array([len(x) for x in self.b_text], np.int64)
        by_text: dict[bytes, int] = {}
        for i, x in enumerate(self.b_text):
            if x:
                by_text.setdefault(x, i)
        self.same = np.array([by_text.get(x, -1) for x in self.a_text], np.int64)
        # Decimal ids with what follows them in the digest: inside a group, and at its end.
        self.words = [f"{i},".encode() for i in range(len(self.a_text))] + [f"{i}|".encode() for i in range(len(self.a_text))]
        self.words += [f"{i},".encode() for i in range(len(pieces))] + [f"{i};".encode() for i in range(len(pieces))]

        self.forget()

    def forget(self) -> None:
        """Drop all kept stretches."""
        self.place: dict[str, int] = {}
        self.chars = 0
        self.groups: list[bytes] = []
        # Per stretch: tokens of both, groups, whether its bytes agree, and where its links begin.
        self.counts = np.zeros((0, 4), np.int64)
        self.starts, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        """The stretches of a text that begins with a blank."""
        return (STRETCH.findall(text) if self.stretches else []) or [text]

    def tokens(self, some: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both tokenizers for texts that begin with a blank; None where the bytes differ."""
        a = [x.ids for x in self.a.encode_batch_fast(some, add_special_tokens=False)]
        b = self.b.encode([x[1:] for x in some], num_threads=1) if some else []
        out: list[tuple[list[int], list[int]] | None] = []
        for text, ids_a, ids_b in zip(some, a, b, strict=True):
            if text == " ":
                ids_b = [self.b.piece_to_id("▁")]
            data = text.encode()
            equal = (
                b"".join(map(self.a_text.__getitem__, ids_a)) == data == b"".join(map(self.b_text.__getitem__, ids_b))
            )
            out.append((ids_a, ids_b) if equal else None)
        return out

    def encode(self, stretches: list[str]) -> tuple[list[int], list[int], list[bool]]:
        """Ids of all stretches in a row, and which stretches have any. Stretches that end in a word
        go to the tokenizers many at a time, as one text."""
        ids_a: list[int] = []
        ids_b: list[int] = []
        good: list[bool] = []
        at = 0
        while at < len(stretches):
            end, size = at, 0
            while end < len(stretches) and not stretches[end][-1].isspace() and size < JOINED_CHARS:
                size += len(stretches[end])
                end += 1
            end = max(end, at + 1)
            found = self.tokens(["".join(stretches[at:end])]) if self.stretches else [None]
            if found[0] is None:
                found = self.tokens(stretches[at:end])
                good += [x is not None for x in found]
            else:
                good += [True] * (end - at)
            for x in found:
                if x is not None:
                    ids_a += x[0]
                    ids_b += x[1]
            at = end
        return ids_a, ids_b, good

    def keep(self, stretches: list[str]) -> None:
        """Align new stretches and add them to the table."""
        ids_a, ids_b, good = self.encode(stretches)
        n = len(stretches)
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        bytes_ = np.array([len(x.encode()) if ok else 0 for x, ok in zip(stretches, good, strict=True)], np.int64)
        ends, ends_a, ends_b = np.cumsum(bytes_), np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
        alone = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
        link_a, link_b = a[last_a], b[last_b]
        is_same = alone & (self.same[link_a] == link_b)
        # Links of the same bytes are named by the first id, others by a number beyond the vocabulary.
        links = np.where(is_same, link_a, len(self.a_text) + link_a * len(self.b_text) + link_b)
        sizes = [
            np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (ends_a, ends_b, both)
        ]
        n_a, n_b, n_groups = sizes
        self.groups += self.written(a, b, last_a, last_b, n_a + n_b)
        self.counts = np.concatenate([self.counts, np.column_stack([*sizes, np.array(good, np.int64).reshape(n)])])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_groups)])
        self.links = np.concatenate([self.links, links])
        first = len(self.place)
        self.place.update(zip(stretches, range(first, first + n), strict=True))
        self.chars += sum(map(len, stretches))

    def written(self, a, b, last_a, last_b, sizes) -> list[bytes]:
        """Each stretch's groups as text: tokens in the order of their groups, the first tokenizer's
        before the second's."""
        is_last_a, is_last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        is_last_a[last_a], is_last_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(is_last_a) - is_last_a, np.cumsum(is_last_b) - is_last_b
        before_b = np.append(0, last_b + 1)  # tokens of the second in the groups before one
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before_b[group_a]] = a + is_last_a * len(self.a_text)
        codes[np.arange(len(b)) + last_a[group_b] + 1] = b + is_last_b * len(self.b_text) + 2 * len(self.a_text)
        ends = np.cumsum(sizes).tolist()
        word, flat = self.words.__getitem__, codes.tolist()
        return [b"".join(map(word, flat[i:j])) for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def align(self, rows: list[str]) -> tuple[dict, np.ndarray]:
        """Per text the columns of ``SCHEMA`` from ``n_a`` on, and the vector of one-to-one links."""
        if len(self.place) > KEPT_STRETCHES or self.chars > KEPT_CHARS:
            self.forget()
        cuts = [self.cut(f" {x}") if x else [] for x in rows]
        missing = set().union(*cuts).difference(self.place)
        if missing:
            self.keep(sorted(missing))
        n, size_a, size_b = len(rows), len(self.a_text), len(self.b_text)
        place = self.place.__getitem__
        codes = [list(map(place, x)) for x in cuts]
        lengths = np.array([len(x) for x in codes], np.int64)
        flat = np.array([c for x in codes for c in x], np.int64)
        doc = np.repeat(np.arange(n), lengths)
        bad = np.zeros(n, bool)
        bad[doc[self.counts[flat, 3] == 0]] = True
        use = ~bad[doc]
        flat, doc = flat[use], doc[use]
        ends = np.searchsorted(doc, np.arange(n + 1))
        sums = np.diff(np.vstack([np.zeros((1, 3), np.int64), np.cumsum(self.counts[flat, :3], 0)])[ends], axis=0)
        # The links of every stretch, in the order of the text.
        held = self.counts[flat, 2]
        at = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(self.starts[flat], held)
        link, doc_of = self.links[at], np.repeat(doc, held)
        is_same = link < size_a

        def per_doc(docs: np.ndarray, keys: np.ndarray, width: int) -> tuple[pa.Array, pa.Array]:
            """Distinct keys of each text, and how often each."""
            values, counts = np.unique(docs * width + keys, return_counts=True)
            ends = np.searchsorted(values, np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
            kind = pa.int32() if width == size_a else pa.int64()
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values % width).cast(kind))
            return lists, pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int64)))

        same, same_n = per_doc(doc_of[is_same], link[is_same], size_a)
        pairs, pairs_n = per_doc(doc_of[~is_same], link[~is_same] - size_a, size_a * size_b)
        digests = [
            hashlib.sha256(b"".join(map(self.groups.__getitem__, x))[:-1]).hexdigest() if x and not skip else ""
            for x, skip in zip(codes, bad.tolist(), strict=True)
        ]
        n_a, n_b, groups = (pa.array(sums[:, i]) for i in range(3))
        columns = {
            "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": groups, "groups_sha256": pa.array(digests, pa.string()),
            "same": same, "same_n": same_n, "pairs": pairs, "pairs_n": pairs_n,
        }
        return columns, np.bincount(link[is_same], minlength=size_a)


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def loaded(a_path: str, b_path: str) -> Vocabularies:
    key = (a_path, b_path)
    if key not in _LOADED:
        _LOADED[key] = Vocabularies(a_path, b_path)
    return _LOADED[key]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links of every text, written once: a row per document (``row`` is unique) with its distinct
    links and their numbers, and a row per task (``is_vector``) with the task's vector.

    ``a_path``: file of a byte-level tokenizer; ``b_path``: sentencepiece model that adds a blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(a_path, b_path)
        vector = np.zeros(len(both.a_text), np.int64)
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            column = batch.column(1)
            for i, j in passes(np.diff(raw(column)[1]), PASS_BYTES):
                found, counts = both.align(column.slice(i, j - i).to_pylist())
                vector += counts
                found |= {"doc_id": batch.column(0).slice(i, j - i), "is_vector": pa.array(np.zeros(j - i, bool))}
                yield pa.RecordBatch.from_arrays([found[x] for x in names], names)
        held = np.flatnonzero(vector)
        total = {"is_vector": [True], "same": [held.tolist()], "same_n": [vector[held].tolist()]}
        kinds = {"doc_id": pa.int64(), "is_vector": pa.bool_(), "groups_sha256": pa.string(), "same": pa.list_(pa.int32())}
        kinds |= dict.fromkeys(("same_n", "pairs", "pairs_n"), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(total.get(x, [None]), kinds.get(x, pa.int64())) for x in names], names)

    rows = texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "alignment")


def link_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``pair``, ``a``, ``b``, ``n``, ``same`` (counted in the vectors), ``best`` (no other token of the
    first tokenizer is linked with ``b`` more often) of all linked id pairs; written once.

    The highest count of each ``b`` has at most one row per token of a vocabulary, so it is broadcast.
    """
    both = loaded(a_path, b_path)
    size_b = len(both.b_text)
    spark = aligned.sparkSession
    partners = spark.createDataFrame(
        [(i, x) for i, x in enumerate(both.same.tolist()) if x >= 0], "a int, partner bigint"
    )
    vectors = aligned.filter("is_vector").select(F.inline(F.arrays_zip(F.col("same").alias("a"), F.col("same_n").alias("n"))))
    same = vectors.groupBy("a").agg(F.sum("n").alias("n")).join(F.broadcast(partners), "a")
    pairs = aligned.filter("not is_vector").select(
        F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pairs_n").alias("n")))
    )
    every = same.select((F.col("a") * size_b + F.col("partner")).alias("pair"), "n", F.lit(True).alias("same")).unionByName(
        pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("same", F.lit(False))
    )
    counted = every.groupBy("pair").agg(F.sum("n").alias("n"), F.max("same").alias("same"))
    counted = written(
        counted.select("pair", F.floor(F.col("pair") / size_b).alias("a"), F.pmod("pair", F.lit(size_b)).alias("b"), "n", "same"),
        "alignment-counts",
    )
    highest = counted.groupBy("b").agg(F.max("n").alias("highest"))
    judged = counted.join(F.broadcast(highest), "b").withColumn("best", F.col("n") == F.col("highest"))
    return written(judged.select("pair", "a", "b", "n", "same", "best"), "alignment-best")


def document_links(aligned: DataFrame, counts: DataFrame, a_path: str, b_path: str,
                   frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """The documents of ``aligned`` with ``n_best`` and ``count_sum`` of their links.

    ``frequent`` bounds the pairs that go to every task; it never changes the result.
    """
    both = loaded(a_path, b_path)
    of_same, is_best = np.zeros(len(both.a_text), np.int64), np.zeros(len(both.a_text), np.int64)
    for r in counts.filter("same").select("a", "n", "best").collect():  # at most the vocabulary
        of_same[r.a], is_best[r.a] = r.n, r.best
    top = counts.filter("not same").orderBy(F.desc("n"), "pair").limit(frequent).select("pair", "n", "best").collect()
    top.sort()
    keys = np.array([r.pair for r in top], np.int64)
    key_n, key_best = np.array([r.n for r in top], np.int64), np.array([r.best for r in top], np.int64)
    names = ["row", "count_sum", "n_best", "pairs", "pairs_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, same_n, pairs, pairs_n = (batch.column(i) for i in range(1, 5))
            ids, n = same.flatten().to_numpy(), same_n.flatten().to_numpy()
            at = np.append(0, np.cumsum(same.value_lengths().to_numpy()))
            found, m = pairs.flatten().to_numpy(), pairs_n.flatten().to_numpy()
            pair_at = np.append(0, np.cumsum(pairs.value_lengths().to_numpy()))
            place = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
            known = keys[place] == found if len(keys) else np.zeros(len(found), bool)
            sums = []
            for vector, values in ((of_same, key_n), (is_best, key_best)):
                one = np.append(0, np.cumsum(vector[ids] * n))
                two = np.append(0, np.cumsum(np.where(known, values[place] * m, 0) if len(keys) else m * 0))
                sums.append(pa.array(np.diff(one[at]) + np.diff(two[pair_at])))
            left = np.append(0, np.cumsum(~known))[pair_at].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~known])) for x in (found, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, *rest], names)

    documents = aligned.filter("not is_vector")
    schema = "row bigint, count_sum bigint, n_best bigint, pairs array<bigint>, pairs_n array<bigint>"
    scored = written(documents.select("row", "same", "same_n", "pairs", "pairs_n").mapInArrow(run, schema), "alignment-rest")
    rare = (
        scored.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pairs_n").alias("m"))))
        .join(counts.select("pair", "n", "best"), "pair")
        .groupBy("row")
        .agg(F.sum(F.col("m") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best"))
    )
    sums = scored.select("row", "count_sum", "n_best").unionByName(
        rare.select("row", F.col("more").alias("count_sum"), F.col("more_best").alias("n_best"))
    )
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return documents.select("row", *kept, "groups_sha256").join(sums, "row").select(*kept, "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align(table(spark, sf_dir, "documents"), *files)
    return document_links(aligned, link_counts(aligned, *files), *files)
