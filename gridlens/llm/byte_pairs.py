"""Byte-pair encoding and decoding over a contiguous rank array.

Each short piece of text is one row of part ids beside one row of the ranks of neighbouring parts.
The lowest rank is found by a scan, its boundary is deleted by moving the rest of the row up, and
the two ranks beside it are looked up again, until no pair of the row can merge. Rows of equal
length are scanned together. A piece too long for a scan (quadratic) uses a heap of the same ranks.

Defined results: a null text is empty and has no ids; repeated rows are separate documents; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import pre_tokenizers

from gridlens.llm.common import passes, raw, table, texts
from gridlens.llm.words import PieceTable

NO_RANK = np.int64(1) << 40
# Bytes of a piece up to which the rank array is scanned.
SCANNED = 64
# Pieces scanned together.
TOGETHER = 8192

# White space as the tokenizer library sees it, and its rule for pieces.
BLANK = r"\t-\r \x85\xa0  -     　"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)
# Characters whose class is the same in every Unicode version in use; a text with others is cut
# by the library's own rule.
SETTLED = r"[^\x00-՗‐- ₠-₿　-ヿ一-龥가-힣]"


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary: printable Latin-1 stands
    for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Merges and byte texts of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in spec["model"]["merges"]]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.text = [b""] * self.size
        for token, i in vocab.items():
            if token not in self.special:
                self.text[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.text[i] = token.encode()
        self.first = np.zeros(256, np.int32)
        for char, b in symbols.items():
            self.first[b] = vocab[char]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array([a * self.size + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([r for r, _ in self.pairs.values()], np.int64)[order], NO_RANK)
        self.merged = np.append(np.array([m for _, m in self.pairs.values()], np.int32)[order], 0)
        self.cut = regex.compile(PIECES)
        self.unsettled = regex.compile(SETTLED)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """The pieces a text is cut into before merging; special tokens stand alone."""
        parts = self.split.split(text) if self.split else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif self.unsettled.search(part):
                out.extend(part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part))
            else:
                out.extend(self.cut.findall(part))
        return out

    def place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the merge table; the last row if it cannot merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return at

    def scan(self, data: np.ndarray) -> np.ndarray:
        """Merge all rows of equal byte length; the parts of a row, then -1."""
        parts = self.first[data]
        n, width = parts.shape
        if width == 1:
            return parts
        place = self.place(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        ranks = self.ranks[place]
        out = np.full((n, width), -1, np.int32)
        rows = np.arange(n)
        columns = np.arange(width)
        while True:
            low = ranks.argmin(1)
            going = ranks[np.arange(len(ranks)), low] < NO_RANK
            if not going.all():
                done = ~going
                out[rows[done], : parts.shape[1]] = parts[done]
                parts, ranks, place, low, rows = parts[going], ranks[going], place[going], low[going], rows[going]
            if not len(rows):
                return out
            each = np.arange(len(rows))
            parts[each, low] = self.merged[place[each, low]]
            # Delete the boundary: later parts and ranks move up by one.
            width = parts.shape[1]
            later = columns[: width - 1] + (columns[: width - 1] > low[:, None])
            parts = np.take_along_axis(parts, later, 1)
            if width == 2:
                out[rows, :1] = parts
                return out
            kept = columns[: width - 2] + (columns[: width - 2] >= low[:, None])
            ranks, place = np.take_along_axis(ranks, kept, 1), np.take_along_axis(place, kept, 1)
            for at in (low - 1, low):  # the merged part's left and right neighbours
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                left, right = parts[ok, at[ok]], parts[ok, at[ok] + 1]
                found = self.place(left, right)
                found[(left < 0) | (right < 0)] = len(self.keys) - 1
                place[ok, at[ok]], ranks[ok, at[ok]] = found, self.ranks[found]

    def heap(self, data: bytes) -> list[int]:
        """Merge one long piece: ranks in a heap, neighbours as linked positions."""
        parts = [int(self.first[b]) for b in data]
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get((parts[i], parts[j]))):
                heapq.heappush(queue, (found[0], i, parts[i], parts[j], found[1]))

        for i in range(n - 1):
            push(i)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [x for x in parts if x >= 0]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit bytes."""
        data = [x.encode("utf-8") for x in pieces]
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(x) for x in data])
        for i, x in enumerate(pieces):
            if x in self.special:
                out[i] = np.array([self.special[x]], "<u4").tobytes()
                lengths[i] = 0
            elif lengths[i] > SCANNED:
                out[i] = np.array(self.heap(data[i]), "<u4").tobytes()
        for width in np.unique(lengths[(lengths > 0) & (lengths <= SCANNED)]):
            same = np.flatnonzero(lengths == width)
            for a in range(0, len(same), TOGETHER):
                some = same[a : a + TOGETHER]
                rows = np.frombuffer(b"".join(data[i] for i in some), np.uint8).reshape(len(some), width)
                ids = self.scan(rows)
                count = (ids >= 0).sum(1)
                whole = ids[ids >= 0].astype("<u4").tobytes()
                ends = np.cumsum(count) * 4
                for i, b, c in zip(some.tolist(), ends.tolist(), (count * 4).tolist(), strict=True):
                    out[i] = whole[b - c : b]
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        joined = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").encode("utf-8")


_LOADED: dict[str, tuple[BytePairs, PieceTable]] = {}


def loaded(path: str) -> tuple[BytePairs, PieceTable]:
    if path not in _LOADED:
        pairs = BytePairs(path)
        _LOADED[path] = pairs, PieceTable(pairs.encode)
    return _LOADED[path]


def _rows(path: str, out_columns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, known = loaded(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for a, b in passes(np.diff(raw(column)[1])):
                ids = known.lookup([pairs.pieces(x) for x in column.slice(a, b - a).to_pylist()])
                yield out_columns(batch.slice(a, b - a), ids, pairs)

    return run


def _encoded(batch: pa.RecordBatch, ids: list[bytes], _: BytePairs) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4")))
    return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])


def _digests(batch: pa.RecordBatch, ids: list[bytes], pairs: BytePairs) -> pa.RecordBatch:
    decoded = [pairs.decode(x) for x in ids]
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` of every whole text."""
    return texts(docs, id_col, text_col).mapInArrow(_rows(tokenizer, _encoded), "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``text`` from ``doc_id``, ``ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, _ = loaded(tokenizer)
        for batch in batches:
            found = [np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            out = pa.array([pairs.decode(x).decode("utf-8") for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and SHA-256 of the ids and of the text decoded from them."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return texts(docs, id_col, text_col).mapInArrow(_rows(tokenizer, _digests), schema)


def op4_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
