"""Ranked lexical search: MaxScore over sharded posting lists, tightened by bounds of term pairs.

An index shard holds the posting lists of some thousand documents: for every term its documents, the
integer impacts and the greatest impact, and for chosen pairs of terms the greatest impact that both
reach together in one document (from the intersection of the two lists). A query adds up its terms
from the highest bound down; once the bounds of the terms left cannot lift a new document to the k-th
score, they are looked up for the documents found so far alone, and these are given up as soon as
the bounds left cannot lift them either. The terms left are bounded pair by pair: two frequent terms
rarely reach their greatest impacts in the same document, so the joint bound is below their sum.

A first part of the shards is searched without a start value; the k-th score found there is the start
value of all other shards. Whole results: bounds only skip what cannot enter, ties included.

Queries are taken in blocks of bounded size. The terms of a block go to every task; the documents are
read once per block and keep only the block's terms.

Defined results: a null or empty text has no terms, a document without terms counts for nothing, an
item without terms or matches has no rows; null ids come last in ties; repeated ids are separate
documents, and repeated item ids separate items; other columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.common import table, texts, written

# Documents and postings of a shard (about 8 MB), distinct terms of the queries of a block, and the
# part of the shards that is searched first.
SHARD_DOCS = 8192
SHARD_POSTINGS = 1 << 19
BLOCK_TERMS = 1 << 18
FIRST_OF = 32

# Term bytes (digits, letters, all non-ASCII; A-Z lower-cased), the weight and the
# length rule of the score.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WEIGHT = "floor(1000*ln((2*{n}+2)/(2*df+1)))"
SCALE, SHARE, NORM, SATURATION = 1_000_000_000, 25, 1000, 12

ITEM_TERMS = "item bigint, item_id bigint, terms array<binary>, times array<int>"
POSTINGS = "doc_id bigint, n bigint, terms array<int>, tf array<int>"
SHARD = (
    "shard int, doc_ids array<bigint>, has_id array<boolean>, rows array<bigint>, terms array<int>, starts array<int>,"
    " docs array<int>, impacts array<bigint>, pairs array<bigint>, joint array<bigint>"
)
FOUND = "item bigint, doc_id bigint, row bigint, score bigint"


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode().translate(LOWER))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` (unique), ``item_id``, distinct ``terms`` and how often each stands in the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2), batch.column(0), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())),
                ],
                ["item", "item_id", "terms", "times"],
            )

    rows = texts(items, id_col, text_col).withColumn("item", F.monotonically_increasing_id())
    return written(written(rows, "rank-item-texts").mapInArrow(run, ITEM_TERMS), "rank-items").filter(F.size("terms") > 0)


def _blocks(items: DataFrame) -> list[tuple[int, int]]:
    """Ranges of items that hold about ``BLOCK_TERMS`` terms; a longer item is a block of its own."""
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("item"))
    part = F.shiftright("item", 33)  # the items of one task
    sizes = items.select("item", F.size("terms").alias("n"), part.alias("part"))
    block = F.floor((F.col("upto") - F.col("n")) / BLOCK_TERMS)
    ranges = sizes.withColumn("upto", upto).groupBy("part", block.alias("block")).agg(
        F.min("item").alias("low"), F.max("item").alias("high"), F.sum("n").alias("n")
    )
    out: list[list[int]] = []
    held = 0
    for r in ranges.orderBy("low").toLocalIterator():
        if out and held + r.n <= BLOCK_TERMS:
            out[-1][1] = r.high
            held += r.n
        else:
            out.append([r.low, r.high])
            held = r.n
    return [(a, b) for a, b in out]


def postings(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (unique), ``doc_id``, number of terms ``n``, and of the given terms those a document
    holds and how often; written once. Documents without any term are left out."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            held = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if words:
                    counts = Counter(filter(place.__contains__, words))
                    for column, x in zip(held, (doc, len(words), [place[w] for w in counts], list(counts.values())), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(held, kinds, strict=True)], ["doc_id", "n", "terms", "tf"]
            )

    rows = texts(docs, id_col, text_col).mapInArrow(run, POSTINGS)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "rank-postings")


class Corpus:
    """Numbers of documents and terms, the weight of each term of the block, the number of shards."""

    def __init__(self, rows: DataFrame, n_terms: int) -> None:
        counts = rows.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"),
            F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings"), F.count(F.when(F.size("terms") > 0, 1)).alias("held"),
        ).first()
        self.n, self.length = counts.n, counts.length
        self.shards = max(1, -(-counts.held // SHARD_DOCS), -(-counts.postings // SHARD_POSTINGS))
        self.weights = np.zeros(n_terms, np.int64)
        frequency = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.expr(WEIGHT.format(n=f"cast({self.n} as double)")).cast("bigint")
        for r in frequency.select("term", weight.alias("w")).collect():  # at most the terms of a block
            self.weights[r.term] = r.w

    def impacts(self, weights: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - SHARE + SHARE * n * self.n // self.length
        return weights * (SCALE * tf // (NORM * tf + SATURATION * m))


def paired(items: list[list[int]], weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs whose joint impacts are stored: each item's terms, most frequent first, two by two."""
    found = set()
    for terms in items:
        ordered = sorted((t for t in terms if weights[t] > 0), key=lambda t: (weights[t], t))
        found |= set(zip(ordered[::2], ordered[1::2], strict=False))
    return sorted(found)


class Shard:
    """Posting lists of one shard and the joint impacts of its term pairs."""

    def __init__(self, row: dict) -> None:
        self.size = len(row["rows"])
        self.pair_width = 1 << 32
        self.terms = {t: i for i, t in enumerate(row["terms"].tolist())}
        self.starts, self.docs, self.impacts = row["starts"], row["docs"], row["impacts"]
        self.best = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(self.terms) else np.zeros(0, np.int64)
        self.joint = dict(zip(row["pairs"].tolist(), row["joint"].tolist(), strict=True))

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        i = self.terms[term]
        a, b = self.starts[i], self.starts[i + 1]
        return self.docs[a:b], self.impacts[a:b]

    def bound(self, some: list[tuple[int, int]]) -> int:
        """Greatest sum one or two terms (with their times) reach in one document."""
        alone = [int(self.best[self.terms[t]]) * times for t, times in some]
        if len(some) == 1:
            return alone[0]
        (a, x), (b, y) = some
        joint = self.joint.get(min(a, b) * self.pair_width + max(a, b))
        if joint is None:
            return sum(alone)
        if joint:  # both stand in some document; what one term has beyond the other's times is bounded alone
            less = min(x, y)
            joint = joint * less + int(self.best[self.terms[a]]) * (x - less) + int(self.best[self.terms[b]]) * (y - less)
        return max(joint, *alone)

    def search(self, terms: list[tuple[int, int]], order: dict[int, tuple], start: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that may be among the ``k`` best: all that reach the ``k``-th score
        found here or ``start``; and the number of postings read.

        ``order`` gives each term its place in the pairing of ``paired``.
        """
        held = sorted((x for x in terms if x[0] in self.terms), key=lambda x: order[x[0]])
        units = []
        for _, some in _by_unit(held, order):
            units.append((self.bound(some), some))
        units.sort(key=lambda u: -u[0])
        left = np.cumsum([0] + [u[0] for u in units[::-1]])[::-1]  # bound of a unit and all after it
        scores, reached, at, visited = np.zeros(self.size, np.int64), max(start, 1), 0, 0
        while at < len(units) and left[at] >= reached:
            for term, times in units[at][1]:
                docs, impacts = self.list_of(term)
                scores[docs] += impacts * times
                visited += len(docs)
            at += 1
            if self.size > k:
                reached = max(reached, int(np.partition(scores, -k)[-k]))
        some = np.flatnonzero((scores > 0) & (scores + left[min(at, len(units))] >= reached))
        while at < len(units):
            for term, times in units[at][1]:
                docs, impacts = self.list_of(term)
                place = np.searchsorted(docs, some)
                place[place == len(docs)] = 0
                hit = docs[place] == some
                scores[some[hit]] += impacts[place[hit]] * times
                visited += len(some)
            at += 1
            if len(some) > k:
                reached = max(reached, int(np.partition(scores[some], -k)[-k]))
            some = some[scores[some] + left[at] >= reached]
        return some, scores[some], visited


def _by_unit(held: list[tuple[int, int]], order: dict[int, tuple]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Terms that belong to one pair together, others alone."""
    units: dict[int, list[tuple[int, int]]] = {}
    for x in held:
        units.setdefault(order[x[0]][0], []).append(x)
    return sorted(units.items())


def build_index(rows: DataFrame, corpus: Corpus, pairs: list[tuple[int, int]]) -> DataFrame:
    """One row per shard: posting lists with impacts and the joint impacts of pairs; written once."""
    weights, width = corpus.weights, 1 << 32
    sent = rows.sparkSession.sparkContext.broadcast((weights, pairs))

    def run(group: pa.Table) -> pa.Table:
        weights, pairs = sent.value
        ids, numbers = group.column("doc_id").combine_chunks(), group.column("row").to_numpy()
        n, lists = group.column("n").to_numpy(), group.column("terms").combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        docs = np.repeat(np.arange(len(n), dtype=np.int32), lengths)
        terms = lists.flatten().to_numpy()
        tf = group.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
        impacts = corpus.impacts(weights[terms], tf, n[docs])
        use = np.flatnonzero(impacts > 0)
        use = use[np.lexsort((docs[use], terms[use]))]
        docs, terms, impacts = docs[use], terms[use], impacts[use]
        held, first = np.unique(terms, return_index=True)
        starts = np.append(first, len(terms)).astype(np.int32)
        place = {t: i for i, t in enumerate(held.tolist())}
        keys, joint, dense, last = [], [], np.zeros(len(n), np.int64), None
        for a, b in pairs:
            if a not in place or b not in place:
                continue
            i, j = place[a], place[b]
            if last != i:
                dense[:] = 0
                dense[docs[starts[i] : starts[i + 1]]] = impacts[starts[i] : starts[i + 1]]
                last = i
            other = dense[docs[starts[j] : starts[j + 1]]]
            both = np.where(other > 0, other + impacts[starts[j] : starts[j + 1]], 0)
            keys.append(min(a, b) * width + max(a, b))
            joint.append(int(both.max()))
        out = {
            "shard": group.column("shard")[0].as_py(), "doc_ids": ids.fill_null(0).to_numpy(),
            "has_id": ids.is_valid().to_numpy(zero_copy_only=False), "rows": numbers, "terms": held, "starts": starts,
            "docs": docs, "impacts": impacts, "pairs": keys, "joint": joint,
        }
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        kinds += [pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.list_(pa.int64())] * 3
        return pa.table([pa.array([v], t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    shard = F.pmod(F.xxhash64("row"), F.lit(corpus.shards)).cast("int")
    placed = rows.filter(F.size("terms") > 0).withColumn("shard", shard)
    return written(placed.groupBy("shard").applyInArrow(run, SHARD), "rank-index")


def search(index: DataFrame, items: list[tuple[int, list[tuple[int, int]]]], order: dict[int, dict], starts: dict[int, int],
           k: int) -> DataFrame:
    """Candidates of every item from the shards of ``index``: ``item``, ``doc_id``, ``row``, ``score``."""
    sent = index.sparkSession.sparkContext.broadcast((items, order, starts))

    def run(group: pa.Table) -> pa.Table:
        items, order, starts = sent.value
        row = {x: group.column(x)[0].values.to_numpy(zero_copy_only=False) for x in group.column_names if x != "shard"}
        shard = Shard(row)
        # Equal scores: smaller ids first, null ids last, then rows.
        rank = np.empty(shard.size, np.int64)
        rank[np.lexsort((row["rows"], row["doc_ids"], ~row["has_id"]))] = np.arange(shard.size)
        found = ([], [], [])
        for item, terms in items:
            docs, scores, _ = shard.search(terms, order[item], starts.get(item, 0), k)
            best = np.lexsort((rank[docs], -scores))[:k]
            for column, x in zip(found, (np.full(len(best), item), docs[best], scores[best]), strict=True):
                column.append(x)
        which, docs, scores = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found)
        ids = pa.array(row["doc_ids"][docs], pa.int64(), mask=~row["has_id"][docs])
        return pa.table([pa.array(which), ids, pa.array(row["rows"][docs]), pa.array(scores)], names=["item", "doc_id", "row", "score"])

    return index.groupBy("shard").applyInArrow(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of every item with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pair_places(terms: list[int], weights: np.ndarray) -> dict[int, tuple]:
    """Unit and place of each term that counts: the pairs of ``paired``."""
    ordered = sorted((t for t in terms if weights[t] > 0), key=lambda t: (weights[t], t))
    return {t: (i // 2, i % 2) for i, t in enumerate(ordered)}


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's ``k`` best documents with a score above 0."""
    queries = item_terms(items, item_col)
    out = None
    for low, high in _blocks(queries):
        block = [(r["item"], r["terms"], r["times"]) for r in queries.filter(F.col("item").between(low, high)).collect()]
        words = sorted({bytes(t) for _, terms, _ in block for t in terms})
        place = {t: i for i, t in enumerate(words)}
        wanted = [(item, [place[bytes(t)] for t in terms], times) for item, terms, times in block]
        rows = postings(docs, words)
        corpus = Corpus(rows, len(words))
        order = {item: pair_places(terms, corpus.weights) for item, terms, _ in wanted}
        counted = [
            (item, [(t, n) for t, n in zip(terms, times, strict=True) if corpus.weights[t] > 0]) for item, terms, times in wanted
        ]
        index = build_index(rows, corpus, paired([terms for _, terms, _ in wanted], corpus.weights))
        first = written(search(index.filter(F.pmod("shard", F.lit(FIRST_OF)) == 0), counted, order, {}, k), "rank-first")
        kth = best_of(first, k).filter(F.col("rank") == k).select("item", "score").collect()  # one per item of the block
        rest = search(index.filter(F.pmod("shard", F.lit(FIRST_OF)) != 0), counted, order, dict(map(tuple, kth)), k)
        found = written(best_of(first.unionByName(rest), k), "rank-found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM n),
w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, total GROUP BY term, docs
), q AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))))::BIGINT AS score
  FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), total
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
