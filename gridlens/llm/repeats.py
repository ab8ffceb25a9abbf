"""Exact repeats of 100 bytes and more, from the interval tree of an enhanced suffix array.

Equal 100-byte strings hold equal minimizers: the 32-byte window of smallest hash. So the suffix
array is sparse: it holds the suffixes that begin at minimizers which occur more than once. Each is
read with the text around it that a 100-byte string through it can reach (its context). Contexts
that are equal as a whole need no array: all but the first occurrence are repeats. The distinct
contexts of one minimizer are sorted with their common prefixes, a stack scan lists the prefix
intervals, and inside an interval the left extensions decide which members repeat an earlier one,
and how far: the maximal repeats with all their occurrences. A minimizer with more than ``GROUP``
distinct contexts is settled by its single 100-byte strings instead, each by its first place.

Hashes of 64 bits choose and gather, 128 bits compare whole contexts.

A document is told by its id and the hash of its text (``text_key``), so that rows of one id, or
without an id, are as many documents as they have different texts.

Defined results: a null text is empty; rows that share an id are ordered by the xxhash64 of their
text, rows of equal id and text are one document, each reported; null ids are after all others;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.common import PASS_BYTES, give_back, mixed, numbers, passes, planes, raw, release_shuffles, sliding_min, table, texts, window_hashes, written

LENGTH = 100
K = 32
SIDE = LENGTH - K
# Distinct contexts of one minimizer that a task sorts.
GROUP = 1 << 16
# Minimizers of a chunk, its most documents (two bytes each), ranges of hashes per shuffle partition,
# and the bits of a hash that are not compared when repeated ones are looked for.
CHUNK_MARKS = 1 << 18
CHUNK_DOCS = 1 << 16
RANGES = 4
REST_BITS = 24
# Contexts sorted together in one numpy pass.
TOGETHER = 10_000
# Bits of the filters that keep texts without repeats from being shuffled: fixed size.
FILTER_BITS = 1 << 24
NO_ID = (1 << 63) - 1


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that are the smallest of some 100-byte string."""
    hashes = window_hashes(data, K)
    width = LENGTH - K + 1
    if len(hashes) < width:
        return np.zeros(0, np.int64), hashes[:0]
    low = sliding_min(hashes, width)
    # The largest minimum over the strings that hold a window is the window's own iff it is one.
    edge = np.zeros(width - 1, np.uint64)
    padded = np.concatenate([edge, low, edge])
    high = ~sliding_min(~padded, width)
    at = np.flatnonzero(high == hashes)
    return at, hashes[at]


def _small(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some MB of their texts, which bounds what a task holds at once."""
    for batch in batches:
        for a, b in passes(np.diff(raw(batch.column(column))[1]), 2 * PASS_BYTES):
            yield batch.slice(a, b - a)


def _documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and bytes of each text."""
    data, at = raw(column)
    for row in range(len(column)):
        yield row, data[at[row] : at[row + 1]]


def _minimizers_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, places and hashes for every text; short texts are hashed together, long ones by parts."""
    data, at = raw(column)
    for a, b in passes(np.diff(at), PASS_BYTES // 2):
        begin, end = int(at[a]), int(at[b])
        if b - a == 1:
            size, step = end - begin, PASS_BYTES // 2
            for c in range(0, max(1, size - LENGTH + 1), step):
                places, hashes = minimizers(data[begin + c : min(end, begin + c + step + LENGTH - 1)])
                yield a, places + c, hashes
            continue
        # A string over a border of texts may mark a window that no string of one text marks;
        # such a window is only one more place to look at.
        places, hashes = minimizers(data[begin:end])
        first = np.searchsorted(places, at[a:b] - begin)
        last = np.searchsorted(places, at[a + 1 : b + 1] - begin - K, "right")
        for row in range(a, b):
            i, j = first[row - a], last[row - a]
            yield row, places[i:j] + begin - at[row], hashes[i:j]


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


POSTED = "part int, chunk bigint, kind int, ids binary, rest binary"
# Kinds of rows: minimizers that stand once in their chunk, one place for each that stands more often
# there, all places of the latter, and the chunk's documents.
ONCE, OFTEN, PLACES, DOCUMENTS = range(4)


def _where(marks: np.ndarray, docs: np.ndarray, places: np.ndarray) -> bytes:
    """The rest of each minimizer's hash, its document in the chunk and its place there."""
    return planes(marks & np.uint64((1 << REST_BITS) - 1), 3) + planes(docs, 2) + planes(places, 4)


def _chunk_rows(chunk: int, parts: int, documents: list[tuple], found: list[tuple]) -> pa.RecordBatch:
    rows = [(chunk % parts, chunk, DOCUMENTS, None, np.array(documents, np.int64).tobytes())]
    marks = np.concatenate([x[0] for x in found])
    docs = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    places = np.concatenate([x[1] for x in found])
    order = np.argsort(marks, kind="stable")
    marks, docs, places = marks[order], docs[order], places[order]
    ids = marks >> np.uint64(REST_BITS)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(ids)))
    alone = np.repeat(times == 1, times)
    if not alone.all():
        steps = np.diff(ids[~alone], prepend=np.uint64(0))
        rows.append((chunk % parts, chunk, PLACES, planes(steps, 5), _where(marks[~alone], docs[~alone], places[~alone])))
    for kind, at in ((ONCE, first[times == 1]), (OFTEN, first[times > 1])):
        if not len(at):
            continue
        own = ids[at]
        part = ((own >> np.uint64(20)) * np.uint64(parts)) >> np.uint64(20)
        held, begin = np.unique(part, return_index=True)
        for p, i, j in zip(held.tolist(), begin.tolist(), [*begin[1:].tolist(), len(own)], strict=True):
            some = at[i:j]
            steps = planes(np.diff(own[i:j], prepend=np.uint64(0)), 5)
            rows.append((p, chunk, kind, steps, _where(marks[some], docs[some], places[some]) if kind == ONCE else None))
    return _columns(rows, POSTED)


def _send(parts: int, most_marks: int, most_docs: int):
    """Minimizers of each chunk of documents by range of hashes: every hash once for each chunk, so no
    range is crowded by a passage that very many documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, documents, found, held = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            before_it = None
            lengths = np.diff(raw(batch.column(1))[1]).tolist()
            ids, keys = batch.column(0).to_numpy().tolist(), batch.column(2).to_numpy().tolist()
            for row, places, hashes in _minimizers_of(batch.column(1)):
                if lengths[row] < LENGTH or not len(places):
                    continue
                if before_it != row:
                    if held >= most_marks or len(documents) == most_docs:
                        yield _chunk_rows(chunk, parts, documents, found)
                        chunk, documents, found, held = chunk + 1, [], [], 0
                    documents.append((ids[row], keys[row]))
                    found.append((hashes, places))
                else:  # a further piece of a long text
                    found[-1] = tuple(map(np.concatenate, zip(found[-1], (hashes, places), strict=True)))
                before_it = row
                held += len(places)
        if documents:
            yield _chunk_rows(chunk, parts, documents, found)
        documents = found = None
        give_back()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by range: sends back to each chunk its minimizers that other chunks have too."""
    now, held = None, []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[2] in (PLACES, DOCUMENTS):
                out.append(row)
                continue
            if row[0] != now:
                out += _elsewhere(held)
                now, held = row[0], []
            held.append(row)
        if out:
            yield _columns(out, POSTED)
    if held:
        yield _columns(_elsewhere(held), POSTED)


def _elsewhere(rows: list[tuple]) -> list[tuple]:
    if not rows:
        return []
    lists = [np.cumsum(numbers(row[3], 5)) for row in rows]
    ids = np.concatenate(lists)
    weight = np.repeat([1 if row[2] == ONCE else 2 for row in rows], [len(x) for x in lists])
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ids[order]) > 0))
    times = np.add.reduceat(weight[order], first)
    repeated = np.empty(len(ids), bool)
    repeated[order] = np.repeat(times > 1, np.diff(np.append(first, len(ids))))
    out, at = [], 0
    for (part, chunk, kind, _, rest), own in zip(rows, lists, strict=True):
        keep = repeated[at : at + len(own)]
        at += len(own)
        if kind == ONCE and keep.any():
            kept = np.frombuffer(rest, np.uint8).reshape(9, -1)[:, keep].tobytes()
            out.append((part, chunk, ONCE, planes(np.diff(own[keep], prepend=np.uint64(0)), 5), kept))
    return out


LISTS = "doc bigint, text_key bigint, marks array<bigint>, places array<int>"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by chunk: each document's repeated minimizers and their places."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            if row[0] != now:
                if held:
                    yield _document_lists(held)
                now, held = row[0], []
            held.append(row)
    if held:
        yield _document_lists(held)


def _document_lists(rows: list[tuple]) -> pa.RecordBatch:
    documents = next(np.frombuffer(row[3], np.int64).reshape(-1, 2) for row in rows if row[1] == DOCUMENTS)
    marks, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, kind, ids, rest in rows:
        if kind != DOCUMENTS:
            n = len(ids) // 5
            marks.append((np.cumsum(numbers(ids, 5)) << np.uint64(REST_BITS)) + numbers(rest[: 3 * n], 3))
            docs.append(numbers(rest[3 * n : 5 * n], 2).astype(np.int64))
            places.append(numbers(rest[5 * n :], 4).astype(np.int64))
    marks, docs, places = (np.concatenate(x) for x in (marks, docs, places))
    order = np.lexsort((places, docs))
    marks, docs, places = marks[order].view(np.int64), docs[order], places[order].astype(np.int32)
    held, first = np.unique(docs, return_index=True)
    ends = pa.array(np.append(first, len(docs)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(documents[held, 0]), pa.array(documents[held, 1]), pa.ListArray.from_arrays(ends, pa.array(marks)),
         pa.ListArray.from_arrays(ends, pa.array(places))], [x.split()[0] for x in LISTS.split(", ")],
    )


def repeated_minimizers(docs: DataFrame) -> DataFrame:
    """``doc``, ``text_key``, ``marks``, ``places``: minimizers that occur more than once, of every
    document that has any; written once. A few that do not may be among them (40 bits of the hash are
    compared)."""
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = docs.mapInArrow(_send(parts, CHUNK_MARKS, CHUNK_DOCS), POSTED)
    answered = posted.repartition("part").sortWithinPartitions("part").mapInArrow(_answer, POSTED)
    found = answered.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_lists, LISTS)
    return written(found, "repeat-lists")


def _filter_bits(rows: DataFrame, *keys: str) -> np.ndarray:
    """A bit table of fixed size with the hashes of the keys."""
    word = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    words = rows.select(word.alias("at")).selectExpr("at div 64 as word", "shiftleft(1L, cast(at % 64 as int)) as bits")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[found["word"].to_numpy(np.int64)] = found["bits"]
    return table


def _marked(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 6] >> (places & 63)) & 1 > 0


def _with_bit(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("bit", F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)))


def _only_marked(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys may be among the wanted ones; saves shuffling the others before a join."""
    packed = _filter_bits(wanted, *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_marked(packed, batch.column(batch.num_columns - 1).to_numpy()))
            yield batch.filter(keep).select(batch.schema.names[:-1])

    return _with_bit(rows, *keys).mapInArrow(run, rows.schema)


SEEN = "mark bigint, doc bigint, text_key bigint, place int, before int, length int, c1 bigint, c2 bigint"


def _around(body: bytes, place: int) -> tuple[int, bytes]:
    """The context of a minimizer, and how many bytes of it lie before the minimizer."""
    start = max(0, place - SIDE)
    return place - start, body[start : place + LENGTH]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the context of each repeated minimizer of a text."""
    before_it = None
    for batch in _small(batches, 1):
        out: list[tuple] = []
        for row, data in _documents(batch.column(1)):
            doc, key, body = batch.column(0)[row].as_py(), batch.column(2)[row].as_py(), data.tobytes()
            # Rows of one document mostly follow each other; one of them is enough.
            if (doc, key) == before_it:
                continue
            before_it = doc, key
            marks, places = batch.column(3)[row], batch.column(4)[row]
            for mark, place in zip(marks.values.to_numpy().tolist(), places.values.to_numpy().tolist(), strict=True):
                before, context = _around(body, place)
                digest = np.frombuffer(xxhash.xxh3_128_digest(context, before), np.int64).tolist()
                out.append((mark, doc, key, place, before, len(context), *digest))
            if len(out) >= TOGETHER:
                yield _columns(out, SEEN)
                out = []
        yield _columns(out, SEEN)


HEADS = "mark bigint, doc bigint, text_key bigint, place int, before int, context binary"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts themselves, of the first places of distinct ones."""
    for batch in _small(batches, 1):
        out: list[tuple] = []
        for row, data in _documents(batch.column(1)):
            doc, key, body = batch.column(0)[row].as_py(), batch.column(2)[row].as_py(), data.tobytes()
            marks, places = batch.column(3)[row], batch.column(4)[row]
            for mark, place in zip(marks.values.to_numpy().tolist(), places.values.to_numpy().tolist(), strict=True):
                out.append((mark, doc, key, place, *_around(body, place)))
            if len(out) >= TOGETHER:
                yield _columns(out, HEADS)
                out = []
        yield _columns(out, HEADS)


def _common(x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the rows of two byte matrices."""
    differ = x != y
    return np.minimum(np.where(differ.any(1), differ.argmax(1), x.shape[1]), limit)


def prefix_intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Stack scan: (first, last, depth) of all intervals with a common prefix of at least ``least``;
    ``common[i]`` is shared by suffixes i - 1 and i."""
    found, stack = [], []
    n = len(common)
    for i in range(1, n + 1):
        depth = int(common[i]) if i < n else 0
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, top = stack.pop()
            if top >= least:
                found.append((first, i - 1, top))
        if depth and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))
    return found


def _reach(order: list[int], shared: list[int]) -> list[int]:
    """For each member of a left-sorted row the longest left extension it shares with a member of
    smaller order; two scans with a stack of smaller orders."""
    n = len(order)
    best = [-1] * n
    for step in (1, -1):
        stack: list[tuple[int, int]] = []  # order, what it shares with the present member
        for i in range(n) if step == 1 else range(n - 1, -1, -1):
            if stack:
                link = shared[i] if step == 1 else shared[i + 1]
                # Members that share more with the last one than the last one with this share the same
                # with this: the smallest order stands for them.
                first = None
                while stack and stack[-1][1] > link:
                    first = stack.pop()[0]
                if first is not None and not (stack and stack[-1][1] == link):
                    stack.append((first, link))
            while stack and stack[-1][0] > order[i]:
                stack.pop()
            if stack:
                best[i] = max(best[i], stack[-1][1])
            stack.append((order[i], 1 << 30))
    return best


def repeat_groups(group: np.ndarray, order: np.ndarray, before: np.ndarray, contexts: list[bytes]):
    """Maximal repeats among contexts sorted by ``group``: yields (members, left, right) for every
    interval, where ``left`` is the longest left extension each member shares with an earlier one
    (-1 for none) and ``right`` the common length from the minimizer on."""
    n = len(contexts)
    right = np.zeros((n, LENGTH), np.uint8)
    left = np.zeros((n, SIDE), np.uint8)
    ahead = np.zeros(n, np.int64)
    for i, (context, b) in enumerate(zip(contexts, before.tolist(), strict=True)):
        tail = np.frombuffer(context, np.uint8)
        ahead[i] = len(tail) - b
        right[i, : ahead[i]] = tail[b:]
        left[i, :b] = tail[:b][::-1]
    by_right = np.argsort(right.view(f"S{LENGTH}").ravel(), kind="stable")
    by_right = by_right[np.argsort(group[by_right], kind="stable")]
    left_rank = np.empty(n, np.int64)
    left_rank[np.argsort(left.view(f"S{SIDE}").ravel(), kind="stable")] = np.arange(n)
    x, y = by_right[:-1], by_right[1:]
    common = np.zeros(n, np.int64)
    common[1:] = _common(right[x], right[y], np.minimum(ahead[x], ahead[y])) * (group[x] == group[y])
    intervals = prefix_intervals(common, K)
    twos = np.array([(a, d) for a, b, d in intervals if b == a + 1], np.int64).reshape(-1, 2)
    if len(twos):
        x, y = by_right[twos[:, 0]], by_right[twos[:, 0] + 1]
        shared = _common(left[x], left[y], np.minimum(before[x], before[y]))
        yield np.where(order[x] > order[y], x, y), shared, twos[:, 1]
    for a, b, depth in intervals:
        if b == a + 1:
            continue
        members = by_right[a : b + 1]
        members = members[np.argsort(left_rank[members])]
        x, y = members[:-1], members[1:]
        shared = _common(left[x], left[y], np.minimum(before[x], before[y]))
        if (shared >= LENGTH - depth).any():
            found = _reach(order[members].tolist(), [0, *shared.tolist()])
            yield members, np.array(found), np.full(len(members), depth)


SPANS = "doc bigint, text_key bigint, start int, stop int"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of distinct contexts that come sorted by minimizer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= TOGETHER:
            rows = pa.Table.from_batches(held).combine_chunks()
            marks = rows.column("mark").to_numpy()
            # The last minimizer may go on in the next batch.
            whole = int((marks == marks[-1]).argmax())
            if whole:
                yield from _settle(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows:
            yield from _settle(rows)
    give_back()


def _settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Spans of the contexts of some minimizers; rows of one document may have sent a context twice."""
    keys = [rows.column(c).to_numpy() for c in ("mark", "doc", "text_key", "place")]
    fresh = np.append(True, np.any([x[1:] != x[:-1] for x in keys], axis=0))
    if not fresh.all():
        rows = rows.filter(pa.array(fresh))
    column = {c: rows.column(c).to_numpy() for c in ("mark", "doc", "text_key", "place", "before")}
    rank = np.lexsort((column["place"], column["text_key"], column["doc"]))
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    out = []
    groups = repeat_groups(column["mark"], order, column["before"].astype(np.int64), rows.column("context").to_pylist())
    for members, left, right in groups:
        keep = (left >= 0) & (left + right >= LENGTH)
        out.append((members[keep], left[keep], right[keep]))
    if out:
        members, left, right = (np.concatenate(x) for x in zip(*out, strict=True))
        place = column["place"][members].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column["doc"][members]), pa.array(column["text_key"][members]),
             pa.array((place - left).astype(np.int32)), pa.array((place + right).astype(np.int32))],
            ["doc", "text_key", "start", "stop"],
        )


STRINGS = "s1 bigint, s2 bigint, doc bigint, text_key bigint, start int"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All 100-byte strings through a minimizer, by digest and first place."""
    for batch in batches:
        out = []
        for doc, key, place, before, context in zip(
            *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc", "text_key", "place", "before", "context")),
            strict=True,
        ):
            for i in range(min(before, len(context) - LENGTH) + 1):
                digest = np.frombuffer(xxhash.xxh3_128_digest(context[i : i + LENGTH]), np.int64).tolist()
                out.append((*digest, doc, key, place - before + i))
            if len(out) >= TOGETHER:
                yield _columns(out, STRINGS)
                out = []
        yield _columns(out, STRINGS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc``, ``text_key``, ``start``, ``stop``: bytes of ``docs`` (``doc``, ``text``, ``text_key``)
    that a string with an earlier place covers. Spans overlap."""
    text = ["doc", "text_key"]
    # Rows of one document have the same places.
    spark = docs.sparkSession
    found = repeated_minimizers(docs)
    release_shuffles(spark)
    lists = found.groupBy(*text).agg(F.any_value("marks").alias("marks"), F.any_value("places").alias("places"))
    seen = written(_with_lists(docs, lists, found).mapInArrow(_contexts, SEEN), "repeat-contexts")
    release_shuffles(spark)

    one = ["mark", "c1", "c2"]
    where = F.struct("doc", "text_key", "place")
    firsts = written(seen.groupBy(*one).agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")), "repeat-firsts")
    release_shuffles(spark)
    # Equal contexts: all but the first are repeats as a whole.
    later = written(
        seen.select(*one, "doc", "text_key", "place", "before", "length")
        .filter(F.col("length") >= LENGTH)
        .join(firsts.filter("n > 1").select(*one, "first"), one)
        .filter(where != F.col("first"))
        .select("doc", "text_key", (F.col("place") - F.col("before")).alias("start"),
                (F.col("place") - F.col("before") + F.col("length")).cast("int").alias("stop")),
        "repeat-later",
    )
    release_shuffles(spark)
    # Distinct contexts: only their first places can still be repeats of another context.
    sizes = firsts.groupBy("mark").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    heads = written(firsts.join(sizes, "mark").select("mark", "first.*", "contexts"), "repeat-places")
    release_shuffles(spark)
    few = _at_places(docs, heads.filter(F.col("contexts") <= GROUP)).mapInArrow(_heads, HEADS)
    few = few.repartition("mark").sortWithinPartitions("mark", *text, "place")
    spans = later.unionByName(written(few.mapInArrow(_spans, SPANS), "repeat-few"))
    release_shuffles(spark)
    crowded = heads.filter(F.col("contexts") > GROUP)
    if crowded.isEmpty():
        return spans
    strings = _at_places(docs, crowded).mapInArrow(_heads, HEADS).mapInArrow(_strings, STRINGS)
    string = ["s1", "s2"]
    place = F.struct("doc", "text_key", "start")
    first = strings.groupBy(*string).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    many = strings.join(first, string).filter(place != F.col("first"))
    many = many.select("doc", "text_key", "start", (F.col("start") + LENGTH).alias("stop"))
    return spans.unionByName(many)


def _with_lists(docs: DataFrame, lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc``, ``text``, ``text_key`` of the texts with places, and their ``marks`` and ``places``."""
    text = ["doc", "text_key"]
    return _only_marked(docs, wanted, *text).join(lists, text).select("doc", "text", "text_key", "marks", "places")


def _at_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The same from ``mark``, ``doc``, ``text_key``, ``place``."""
    lists = places.groupBy("doc", "text_key").agg(F.collect_set(F.struct("mark", "place")).alias("all"))
    lists = lists.select("doc", "text_key", F.col("all.mark").alias("marks"), F.col("all.place").alias("places"))
    return _with_lists(docs, lists, places)


KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string"


def _cut(with_text: bool):
    """Rows of doc_id, text, starts, stops: the text without its repeated bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, data in _documents(batch.column(1)):
                starts, stops = batch.column(2)[row], batch.column(3)[row]
                removed = spans = 0
                kept = data
                if starts.is_valid:
                    change = np.zeros(len(data) + 1, np.int32)
                    np.add.at(change, starts.values.to_numpy(), 1)
                    np.add.at(change, stops.values.to_numpy(), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    kept = data[~gone]
                body = kept.tobytes()
                text = body.decode("utf-8", "replace") if with_text else None
                out.append((len(data), removed, spans, hashlib.sha256(body).hexdigest(), text))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                [x.split()[0] for x in KEPT.split(", ")],
            )

    return run


def _apart(packed: np.ndarray):
    """Texts without repeats are digested at once; the others pass on with the key of their text.
    The digested ones meet no list: what stands for their ``doc`` only spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 1):
            marked = _marked(packed, batch.column(4).to_numpy())
            spread = mixed(np.arange(batch.num_rows, dtype=np.uint64)).view(np.int64)
            doc = pa.array(np.where(marked, batch.column(0).to_numpy(), spread))
            key = pa.array(batch.column(3).to_numpy(), mask=~marked)
            out = []
            for row, data in _documents(batch.column(1)):
                body = data.tobytes()
                if marked[row]:
                    out.append((len(data), body.decode("utf-8"), None))
                else:
                    out.append((len(data), None, hashlib.sha256(body).hexdigest()))
            kinds = [pa.int64()] + [pa.string()] * 2
            n_bytes, text, sha = zip(*out, strict=True) if out else [[]] * 3
            body = [pa.array(c, k) for c, k in zip((n_bytes, text, sha), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [doc, batch.column(2), body[0], key, *body[1:]], ["doc", "doc_id", "n_bytes", "text_key", "text", "sha"]
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and the kept ``text``)."""
    named = texts(docs, id_col, text_col)
    own = ["doc", "text_key"]
    every = named.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text", "doc_id", F.xxhash64("text").alias("text_key"))
    spans = repeated_spans(every.select("doc", "text", "text_key"))
    lists = spans.groupBy(*own).agg(F.collect_set(F.struct("start", "stop")).alias("all"))
    lists = written(lists.select(*own, F.col("all.start").alias("starts"), F.col("all.stop").alias("stops")), "repeat-spans")
    release_shuffles(docs.sparkSession)
    marked = np.full(FILTER_BITS // 64, -1, np.int64) if with_text else _filter_bits(lists, *own)
    ways = _with_bit(every, *own).mapInArrow(
        _apart(marked), "doc bigint, doc_id bigint, n_bytes bigint, text_key bigint, text string, sha string"
    )
    whole = ways.join(lists, own, "left")
    return whole.select("doc_id", "n_bytes", "text", "sha", "starts", "stops").mapInArrow(_finish(with_text), KEPT)


def _finish(with_text: bool):
    cut = _cut(with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 2):
            done = batch.column(3).is_valid()
            ready = batch.filter(done)
            none = pa.nulls(ready.num_rows, pa.string())
            zero = pa.array(np.zeros(ready.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [ready.column(0), ready.column(1), zero, zero, ready.column(3), none],
                [x.split()[0] for x in KEPT.split(", ")],
            )
            rest = batch.filter(pa.compute.invert(done))
            if rest.num_rows:
                yield from cut(iter([rest.select(["doc_id", "text", "starts", "stops"])]))

    return run


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("text")
