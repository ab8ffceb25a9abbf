"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

Two texts link when their sets of word 5-grams have a Jaccard similarity of at least 0.8. A set in
one global order, rarest grams first, can only link with sets that share a gram of its prefix.

The order comes from exact document frequencies. Half of all grams (by a bit of their hash) are
counted: a task sends the grams of a chunk of documents as sorted, delta-coded lists, one for each
range of hashes, and gets back those that occur elsewhere too. A document with enough grams of its
own has no prefix to send at all. Grams that very many documents hold are told from a table of fixed
size (``BUCKETS``) and are not counted but put last, with the other half; so no range is hot.

Texts of equal words are one node. Large groups of near copies are not expanded into pairs: every node
is verified with one partner of another component, chosen by shared prefix grams, again and again as
long as enough of these pairs link (``PROGRESS``). Buckets that then hold a single component can add nothing. In all others
every remaining pair between components is compared, so no link between components is lost; a pair is
taken from the first gram it shares, not from each (``BEFORE``). Pairs
inside a component that is already connected are not verified: the result has components, not a list
or count of links.

Prefixes are compared by 40-bit hashes, which may only add candidates; pairs are verified once, on
whole sets of 64-bit hashes.

Defined results: a null or blank text has an empty set, links with nothing and is its own
component; a text of fewer words than a gram has its whole sequence as the only gram; equal texts
(also repeated rows) share a component; a component is named by its smallest id, ignoring null
ids; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.common import WORD, mixed, numbers, passes, planes, raw, table, texts, word_hashes, written
from gridlens.llm.graphs import components

WORDS = 5
PERCENT = 80
# Buckets of the frequency table: its size (2 MB) does not depend on the corpus.
BUCKETS = 1 << 18
CHUNK = 1 << 10
# Buckets this much fuller than the others hold a gram that so large a part of the documents has.
HEAVY_PART = 256
HEAVY_LEAST = 64
# Text bytes of a chunk, its most documents (two bytes each), and ranges of hashes per shuffle partition.
CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 1 << 16
RANGES = 4
ID_BITS = 40
# Places that grams of one 40-bit hash may be apart from the order.
SLACK = 2
# Classes of grams whose parities bound the difference of two sets: 256 bytes a node for pairs; rows of
# single grams have them folded to 64 bytes.
PARITIES = 2048
FOLDED = 512
# Grams before each gram of a node by which a pair is known from an earlier bucket.
BEFORE = 8
# Part of the chosen pairs that must link for another round of one partner each.
PROGRESS = 0.1
# Members of one hub that a task verifies; more are spread with a copy of the hub's text.
MEMBERS = 500
# Most bits of the filter for texts that take part in a verification; it only saves a shuffle.
FILTER_BITS = 1 << 26
# Pivots that cut a set for the suffix filter.
PIVOTS = np.arange(1, 128, dtype=np.uint64) << np.uint64(57)

_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Row number, sorted distinct gram hashes and word-sequence digest of every text."""
    done = 0
    for a, b in passes(np.diff(raw(column)[1])):
        data, at = raw(column.slice(a, b - a))
        words, first = word_hashes(data, at)
        grams = np.zeros(0, np.uint64)
        if len(words) >= WORDS:
            grams = words[: len(words) - WORDS + 1].copy()
            for i in range(1, WORDS):
                grams = grams * _STEP + words[i : len(words) - WORDS + 1 + i]
            grams = mixed(grams)
        for row in range(b - a):
            i, j = first[row], first[row + 1]
            key = xxhash.xxh3_128_digest(words[i:j].tobytes())
            if j - i >= WORDS:
                own = np.unique(grams[i : j - WORDS + 1])
            elif j > i:
                own = np.frombuffer(xxhash.xxh3_64_digest(key), np.uint64)
            else:
                own = grams[:0]
            yield done + row, own, key
        done += b - a


def _node(key: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(key, np.int64).tolist())


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64)


def _parity(grams: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` classes of grams, whether the set has an odd number of them. Two sets
    differ at least by as many grams as their parities."""
    place = ((grams >> np.uint64(24)) & np.uint64(PARITIES - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


SCAN = "doc_id bigint, key bigint, n bigint, k1 bigint, parity array<bigint>, chunk int, counts array<bigint>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size and node of each document, and at the end this task's frequency table."""
    counts = np.zeros(BUCKETS, np.int64)
    names = [x.split()[0] for x in SCAN.split(", ")]
    kind = pa.list_(pa.int64())
    for batch in batches:
        sizes, keys, buckets, parities = [], [], [], [np.zeros(0, np.int64)]
        for _, own, key in gram_sets(batch.column(1)):
            sizes.append(len(own))
            keys.append(_node(key)[0])
            buckets.append(_bucket(own))
            parities.append(_parity(own))
            if sum(map(len, buckets[-100:])) > BUCKETS or len(buckets) == 1000:
                counts += np.bincount(np.concatenate(buckets), minlength=BUCKETS)
                buckets = []
        if buckets:
            counts += np.bincount(np.concatenate(buckets), minlength=BUCKETS)
        n, width = len(sizes), PARITIES // 64
        ends = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
             pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parities))), pa.nulls(n, pa.int32()), pa.nulls(n, kind)], names,
        )
    n = BUCKETS // CHUNK
    none = pa.nulls(n, pa.int64())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BUCKETS + 1, CHUNK, dtype=np.int32)), pa.array(counts))
    yield pa.RecordBatch.from_arrays([none] * 4 + [pa.nulls(n, kind), pa.array(np.arange(n, dtype=np.int32)), lists], names)


def _frequencies(scanned: DataFrame) -> np.ndarray:
    """The frequency table of the corpus: BUCKETS numbers, whatever the corpus."""
    each = scanned.filter("chunk is not null").select("chunk", F.posexplode("counts").alias("place", "n"))
    total = each.groupBy("chunk", "place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[total["chunk"].to_numpy(np.int64) * CHUNK + total["place"].to_numpy(np.int64)] = total["n"]
    return counts


def _prefix(n: np.ndarray | int) -> np.ndarray | int:
    """How many grams of a set, in the global order, hold one of any set it links with."""
    return n - (PERCENT * n + 99) // 100 + 1


POSTED = "part int, chunk bigint, ids binary, docs binary, rest binary"


def _posted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in POSTED.split(", ")]
    )


def _send(counts: np.ndarray, heavy: np.ndarray, parts: int, most_bytes: int, most_docs: int):
    """Counted grams of each chunk by range of hashes, and a row with the chunk's documents: nodes, set
    sizes, numbers of counted grams, and the prefix grams that are not counted."""

    def chunk_rows(chunk: int, sets: list[tuple]) -> pa.RecordBatch:
        nodes, sizes, light, rest = zip(*sets, strict=True)
        lengths = np.array([len(x) for x in light])
        ids = np.concatenate(light) >> np.uint64(64 - ID_BITS)
        order = np.argsort(ids, kind="stable")
        ids, docs = ids[order], np.repeat(np.arange(len(sets)), lengths)[order]
        part = ((ids >> np.uint64(ID_BITS - 20)) * np.uint64(parts)) >> np.uint64(20)
        held, first = np.unique(part, return_index=True)
        rows = []
        for p, i, j in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(ids)][: len(held)], strict=True):
            steps = np.diff(ids[i:j], prepend=np.uint64(0))
            rows.append((p, chunk, planes(steps, 5), planes(docs[i:j], 2), None))
        shape = np.array([sizes, lengths, [len(x) for x in rest]], np.int64)
        rows.append((chunk % parts, chunk, np.array(nodes, np.int64).tobytes(), shape.tobytes(), np.concatenate(rest).tobytes()))
        return _posted(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sets, held = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            lengths = np.diff(raw(batch.column(1))[1]).tolist()
            for row, own, key in gram_sets(batch.column(1)):
                n = len(own)
                if not n:
                    continue
                bucket = _bucket(own)
                counted = (own >> np.uint64(20)) & np.uint64(1) == 0
                last = heavy[bucket] | ~counted
                light, rest = own[~last], own[:0]
                if len(light) < _prefix(n):
                    rest, bucket = own[last], bucket[last]
                    order = np.lexsort((rest, counts[bucket], ~counted[last]))
                    rest = rest[order[: _prefix(n) - len(light)]]
                sets.append((_node(key)[0], n, light, rest))
                held += lengths[row]
                if held >= most_bytes or len(sets) == most_docs:
                    yield chunk_rows(chunk, sets)
                    chunk, sets, held = chunk + 1, [], 0
        if sets:
            yield chunk_rows(chunk, sets)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by range: sends back to every chunk its grams that occur more than once, with their
    document frequency (255 stands for all higher ones). Rows of documents pass."""
    now, held = None, []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[4] is not None:
                out.append(row)
                continue
            if row[0] != now:
                out += _shared(held)
                now, held = row[0], []
            held.append(row)
        if out:
            yield _posted(out)
    if held:
        yield _posted(_shared(held))


def _shared(rows: list[tuple]) -> list[tuple]:
    if not rows:
        return []
    lists = [np.cumsum(numbers(row[2], 5)) for row in rows]
    ids = np.concatenate(lists)
    order = np.argsort(ids, kind="stable")
    new = np.append(True, np.diff(ids[order]) > 0)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(ids)))
    frequency = np.empty(len(ids), np.int64)
    frequency[order] = np.repeat(np.minimum(times, 255), times)
    out, at = [], 0
    for (part, chunk, _, docs, _), own in zip(rows, lists, strict=True):
        times = frequency[at : at + len(own)]
        at += len(own)
        keep = times > 1
        if keep.any():
            steps = np.diff(own[keep], prepend=np.uint64(0))
            docs = planes(numbers(docs, 2)[keep], 2) + times[keep].astype(np.uint8).tobytes()
            out.append((part, chunk, planes(steps, 5), docs, None))
    return out


ENTRIES = "gram bigint, node bigint, n int, place int"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by chunk: prefix grams that other documents may share, with node, set size and place in
    the order. Grams of their own come first and are not listed."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            if row[0] != now:
                if held:
                    yield _chunk_entries(held)
                now, held = row[0], []
            held.append(row)
    if held:
        yield _chunk_entries(held)


def _chunk_entries(rows: list[tuple]) -> pa.RecordBatch:
    (nodes, shape, rest), = [row[1:] for row in rows if row[3] is not None]
    nodes, rest = np.frombuffer(nodes, np.int64), np.frombuffer(rest, np.uint64)
    n, light, resting = np.frombuffer(shape, np.int64).reshape(3, -1)
    lists = [row for row in rows if row[3] is None]
    ids = np.concatenate([np.cumsum(numbers(x[1], 5)) for x in lists] or [np.zeros(0, np.uint64)])
    sizes = [len(x[1]) // 5 for x in lists]
    docs = np.concatenate([numbers(x[2][: 2 * m], 2) for x, m in zip(lists, sizes, strict=True)] or [ids]).astype(np.int64)
    times = np.concatenate([np.frombuffer(x[2][2 * m :], np.uint8) for x, m in zip(lists, sizes, strict=True)] or [docs])
    order = np.lexsort((ids, times, docs))
    ids, docs = ids[order], docs[order]
    shared = np.bincount(docs, minlength=len(n))
    place = np.arange(len(ids)) - (np.cumsum(shared) - shared)[docs] + (light - shared)[docs]
    keep = place < _prefix(n)[docs]
    # Grams that are not counted follow all counted ones; their keys are below zero.
    after = np.repeat(np.arange(len(n)), resting)
    later = light[after] + np.arange(len(rest)) - (np.cumsum(resting) - resting)[after]
    gram = np.concatenate([ids[keep].astype(np.int64), -(rest >> np.uint64(1)).astype(np.int64) - 1])
    doc = np.concatenate([docs[keep], after])
    return pa.RecordBatch.from_arrays(
        [pa.array(gram), pa.array(nodes[doc]), pa.array(n[doc].astype(np.int32)),
         pa.array(np.concatenate([place[keep], later]).astype(np.int32))], ["gram", "node", "n", "place"],
    )


def prefix_entries(docs: DataFrame, counts: np.ndarray, documents: int) -> DataFrame:
    """Prefix grams that may be shared, of all documents; written once."""
    heavy = counts > 2 * counts.mean() + max(HEAVY_LEAST, documents / HEAVY_PART)
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = docs.select("doc_id", "text").mapInArrow(_send(counts, heavy, parts, CHUNK_BYTES, CHUNK_DOCS), POSTED)
    counted = posted.repartition("part").sortWithinPartitions("part").mapInArrow(_count, POSTED)
    found = counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_entries, ENTRIES)
    return written(found, "jaccard-entries")


def _need(a: Column, b: Column) -> Column:
    """Grams two sets of these sizes must share."""
    return F.ceil((a + b) * PERCENT / F.lit(100.0 + PERCENT) - F.lit(1e-9))


def _folded(parity: Column) -> Column:
    """The parities of ``FOLDED`` classes: each of them is made of classes that lie as far apart."""
    width = FOLDED // 64
    words = []
    for i in range(width):
        word = parity[i]
        for j in range(i + width, PARITIES // 64, width):
            word = word.bitwiseXOR(parity[j])
        words.append(word)
    return F.array(*words)


def _near(x: str, y: str, classes: int) -> Column:
    """Whether the sets' parities allow so small a difference as that of a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i])) for i in range(classes // 64)), F.lit(0))
    return differ <= n + m - 2 * _need(n, m)


def _may_link(x: str, y: str) -> Column:
    """Length filter and positional filter at a shared gram (grams of one hash may be out of order),
    and the bound on the difference of the sets from their folded parities."""
    n, m, i, j = (F.col(f"{t}.{c}") for c, t in (("n", x), ("n", y), ("place", x), ("place", y)))
    room = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1) + SLACK
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT) & (room >= _need(n, m)) & _near(x, y, FOLDED)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Suffix filter, then the exact test. Sets cut at fixed pivots differ at least by the sizes
    of their cuts."""
    n, m = len(x), len(y)
    need = -(-PERCENT * (n + m) // (100 + PERCENT))
    if min(n, m) < need:
        return False
    cuts = [np.diff(np.concatenate([[0], np.searchsorted(s, PIVOTS), [len(s)]])) for s in (x, y)]
    if np.minimum(cuts[0], cuts[1]).sum() < need:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= PERCENT * (n + m - shared)


VERIFIED = "a bigint, b bigint"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by hub, part and role: the hub's texts come before their members' texts."""
    hubs: list[np.ndarray] = []
    at = None
    for batch in batches:
        hub, part, member = (batch.column(i).to_pylist() for i in range(3))
        found = []
        for row, own, _ in gram_sets(batch.column(4)):
            if at != (hub[row], part[row]):
                at, hubs = (hub[row], part[row]), []
            if member[row] is None:
                hubs.append(own)
            elif any(_linked(x, own) for x in hubs):
                found.append((hub[row], member[row]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"]
        )


def _keep_nodes(wanted: DataFrame):
    """A bit table of wanted nodes, of at most ``FILTER_BITS``, and the batch filter that uses it."""
    size = 1 << 12
    while size < min(FILTER_BITS, 16 * wanted.count()):
        size *= 2
    places = wanted.select(F.col("node").bitwiseAND(size - 1).alias("at"))
    words = places.selectExpr("shiftright(at, 6) as word", "shiftleft(1L, cast(at & 63 as int)) as bits")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(size // 64, np.int64)
    table[found["word"].to_numpy(np.int64)] = found["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.array([_node(key)[0] for _, _, key in _sequences(batch.column(0))], np.int64)
            place = nodes & (size - 1)
            keep = (table[place >> 6] >> (place & 63)) & 1 > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[keep]), batch.column(0).filter(pa.array(keep))], ["node", "text"]
            )

    return run


def _sequences(column: pa.Array) -> Iterator[tuple[int, None, bytes]]:
    for a, b in passes(np.diff(raw(column)[1])):
        words, first = word_hashes(*raw(column.slice(a, b - a)))
        for row in range(b - a):
            yield a + row, None, xxhash.xxh3_128_digest(words[first[row] : first[row + 1]].tobytes())


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text of each node that may be verified, written once; texts of one node have the same words."""
    own = docs.select("text").mapInArrow(_keep_nodes(nodes), "node bigint, text string")
    return written(own.groupBy("node").agg(F.min("text").alias("text")), "jaccard-texts")


def verify_pairs(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of nodes that link. ``a`` is the hub: its text is sent once for every
    ``MEMBERS`` of its partners, each partner's text once for each of its pairs."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts")).filter("parts > 1")
    dealt = pairs.join(parts, "a", "left").select(
        F.col("a").alias("hub"), F.pmod(F.hash("b"), F.coalesce("parts", F.lit(1))).alias("part"), F.col("b").alias("member"),
        F.col("b").alias("node"),
    )
    dealt = written(dealt, "jaccard-dealt")
    hubs = dealt.select("hub", "part", F.lit(None).cast("bigint").alias("member"), F.col("hub").alias("node")).distinct()
    rows = dealt.unionByName(hubs).join(bodies, "node").select("hub", "part", "member", "node", "text")
    placed = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("member").asc_nulls_first())
    return placed.mapInArrow(_verify, VERIFIED)


def _first_partners(entries: DataFrame, tried: DataFrame | None) -> DataFrame:
    """One new partner of another component for each node: by gram, the components of smallest and
    largest label offer their smallest node; a node takes the partner it shares most grams with."""
    offers = entries.groupBy("gram").agg(
        F.min(F.struct("label", "node", "n")).alias("low"), F.max(F.struct("label", "node", "n")).alias("high")
    )
    offers = offers.filter("low.label < high.label")
    seen = entries.join(offers, "gram").withColumn(
        "offer", F.when(F.col("label") != F.col("low.label"), F.col("low")).otherwise(F.col("high"))
    )
    fits = (F.col("n") * 100 >= F.col("offer.n") * PERCENT) & (F.col("offer.n") * 100 >= F.col("n") * PERCENT)
    shared = seen.filter(fits).groupBy("node", F.col("offer.node").alias("hub")).agg(F.count(F.lit(1)).alias("grams"))
    if tried is not None:
        shared = shared.join(tried.select(F.col("a").alias("hub"), F.col("b").alias("node")), ["hub", "node"], "left_anti")
    best = shared.groupBy("node").agg(F.max_by("hub", F.struct("grams", -F.col("hub"))).alias("hub"))
    return best.select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _pairs_in_buckets(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that share a gram and pass the filters. In each bucket the largest component
    is only compared with the others, never with itself. A pair that shares one of the ``BEFORE`` grams that come
    before in both sets (by hash) was in that gram's bucket: texts that share many grams make a pair about once,
    not once for each gram."""
    groups = entries.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("nodes"))
    major = groups.groupBy("gram").agg(
        F.max_by("label", F.struct("nodes", "label")).alias("major"), F.count(F.lit(1)).alias("labels")
    )
    before = Window.partitionBy("node").orderBy("gram").rowsBetween(-BEFORE, -1)
    parities = sets.select("node", _folded(F.col("parity")).alias("parity")).groupBy("node").agg(F.any_value("parity").alias("parity"))
    mixed_grams = written(
        entries.join(major.filter("labels > 1").drop("labels"), "gram")
        .withColumn("before", F.collect_list("gram").over(before)).join(parities, "node"),
        "jaccard-mixed",
    )
    x, y = mixed_grams.filter("label <> major").alias("x"), mixed_grams.alias("y")
    test = (
        F.expr("x.gram = y.gram and x.label <> y.label and (y.label = y.major or x.node < y.node)") & _may_link("x", "y")
        & ~F.arrays_overlap("x.before", "y.before")
    )
    return x.join(y, test).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _remaining_pairs(entries: DataFrame, tried: DataFrame | None, sets: DataFrame) -> DataFrame:
    """All pairs of different components that pass the filters and were not verified."""
    in_order = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    ordered = _pairs_in_buckets(entries, sets).select(*in_order).distinct()
    if tried is not None:
        ordered = ordered.join(tried.select(*in_order), ["a", "b"], "left_anti")
    ordered = written(ordered, "jaccard-remaining")
    nodes = ordered.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = sets.join(nodes, "node").groupBy("node").agg(F.max("n").alias("n"), F.any_value("parity").alias("parity"))
    sides = ordered.join(whole.alias("x"), F.expr("a = x.node")).join(whole.alias("y"), F.expr("b = y.node"))
    ordered = written(sides.filter(_near("x", "y", PARITIES)).select("a", "b"), "jaccard-near")
    # The node with more partners is the hub.
    count = ordered.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("partners"))
    counted = (
        ordered.join(count.select(F.col("node").alias("a"), F.col("partners").alias("of_a")), "a")
        .join(count.select(F.col("node").alias("b"), F.col("partners").alias("of_b")), "b")
    )
    swap = F.col("of_b") > F.col("of_a")
    return counted.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


def link_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned documents (``doc_id``, ``key``, ``n``, ``k1``, ``parity``) and the labels of linked nodes
    (``node``, ``label``); a node is the first half of a text's word digest, ``k1``."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    scanned = written(keyed.mapInArrow(_scan, SCAN), "jaccard-scan")
    rows = scanned.filter("chunk is null").select("doc_id", "key", "n", "k1", "parity")
    entries = prefix_entries(docs, _frequencies(scanned), rows.count())
    shared = entries.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    grams = written(
        entries.join(shared.select("gram"), "gram").groupBy("gram", "node").agg(F.max("n").alias("n"), F.max("place").alias("place")),
        "jaccard-grams",
    )
    bodies = node_texts(docs, grams.select("node").distinct())
    labels = tried = None
    while True:
        pairs = written(_first_partners(_labelled(grams, labels), tried), "jaccard-pairs")
        found = written(verify_pairs(pairs, bodies), "jaccard-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = _merged(labels, found)
        if found.count() < PROGRESS * pairs.count() or pairs.isEmpty():
            break
    sets = rows.select(F.col("k1").alias("node"), "n", "parity")
    rest = written(_remaining_pairs(_labelled(grams, labels), tried, sets), "jaccard-pairs")
    return rows, _merged(labels, written(verify_pairs(rest, bodies), "jaccard-links"))


def _labelled(grams: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return grams.withColumn("label", F.col("node"))
    return grams.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after new links: these join components, so only the labels they touch are worked on."""
    if labels is None:
        return components(links)
    own = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    other = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    ends = links.join(own, "a", "left").join(other, "b", "left")
    lifted = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    fresh = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(fresh.withColumn("label", F.col("node")))
    moved = every.join(lifted.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return written(moved.select("node", F.coalesce("to", "label").alias("label")), "jaccard-labels")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every document."""
    rows, labels = link_nodes(texts(docs, id_col, text_col))
    named = rows.join(labels.withColumnRenamed("node", "k1"), "k1", "left").withColumn("label", F.coalesce("label", "k1"))
    smallest = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that of the smallest id (null ids
    last, then by text hash); texts without words all stay. Texts are not shuffled, except those
    of rows that are repeated whole."""
    rows, labels = link_nodes(texts(docs, id_col, text_col))
    named = rows.join(labels.withColumnRenamed("node", "k1"), "k1", "left").withColumn("label", F.coalesce("label", "k1"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = named.filter("n > 0").groupBy("label").agg(F.min(order).alias("first"))
    counted = named.filter("n > 0").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    keep = first.join(counted, F.expr("first.doc_id <=> doc_id and first.key = key"))
    keep = written(keep.select(F.struct("doc_id", "key", "rows").alias("__keep")), "jaccard-keep")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.struct(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("key"), body.rlike(WORD).alias("words"))
    whole = docs.select(F.struct("*").alias("__doc"), own.alias("__own"))
    blank = whole.filter("not __own.words")
    found = whole.filter("__own.words").join(keep, F.expr("__own.doc_id <=> __keep.doc_id and __own.key = __keep.key"))
    single = found.filter("__keep.rows = 1")
    repeated = found.filter("__keep.rows > 1").dropDuplicates(["__own"])
    return blank.select("__doc.*").unionAll(single.select("__doc.*")).unionAll(repeated.select("__doc.*"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


# Ids are unique in the table it is meant for.
OP7_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM split, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS place(i) WHERE len(words) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT reach.a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.a GROUP BY reach.a
"""
