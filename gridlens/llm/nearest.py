"""Exact top-k search by inner product: a KD-tree for each shard of the vectors.

A tree splits its vectors at the median of the widest dimension and keeps the tight bounding box of
every node. A query visits nodes best first, by the largest inner product its box allows, until no
box reaches the kth score. Every query is first searched in one shard; its kth score there is the
starting bound in all others, which mostly visit few leaves.

Queries are dealt in blocks: each pair of shard and block is one bounded group.

Defined results: vectors that are null or hold a null or non-finite component take no part; only
vectors of equal length are compared; a query's candidates are all rows of another id, repeated rows
each on their own; repeated rows of one query are answered once, different vectors of one query id are
queries with ranks of their own; ties go to the smaller id; null ids
take no part; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.common import table, written

TOP = 5
# Vectors of a shard and queries of a block: the bound of a task.
SHARD_ROWS = 16384
BLOCK_ROWS = 16384
LEAF = 64


class Tree:
    """Median splits with tight boxes over the rows of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.low, self.high, self.children, self.leaves = [], [], [], []
        order = np.arange(len(ids))
        todo = [(order, -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            own = vectors[rows]
            node, low, high = len(self.low), own.min(0), own.max(0)
            self.low.append(low)
            self.high.append(high)
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = node
            wide = int((high - low).argmax())
            if len(rows) <= LEAF or high[wide] == low[wide]:
                self.leaves.append((ids[rows], own))
                continue
            self.leaves.append(None)
            middle = len(rows) // 2
            split = np.argpartition(own[:, wide], middle)
            todo += [(rows[split[:middle]], node, 0), (rows[split[middle:]], node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product each box allows each query (queries x nodes)."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> list[tuple]:
        """Up to k pairs (score, -id), no score below ``floor``."""
        best: list[tuple] = []
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            if self.leaves[node] is None:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            ids, vectors = self.leaves[node]
            scores = vectors @ query
            for i in np.flatnonzero(scores >= floor):
                if ids[i] == own_id:
                    continue
                entry = (scores[i], -ids[i])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    floor = max(floor, best[0][0])
        return best


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if vectors.num_rows and queries.num_rows:
            tree = Tree(_ids(vectors, "vec_id"), _matrix(vectors))
            asked, floors = _matrix(queries), queries.column("floor").to_pylist()
            for a in range(0, len(asked), 512):
                bounds = tree.bounds(asked[a : a + 512])
                for i, own in enumerate(bounds, a):
                    query_id, key = queries.column("query_id")[i].as_py(), queries.column("query_key")[i].as_py()
                    floor = -np.inf if floors[i] is None else floors[i]
                    for score, negative in tree.search(query_id, asked[i], own, k, floor):
                        out.append((query_id, key, -int(negative), int(score)))
        kinds = [pa.int64()] * 4
        names = ["query_id", "query_key", "vec_id", "score"]
        return pa.table([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], names=names)

    return run


def _ids(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy().astype(np.int64)


def _matrix(rows: pa.Table) -> np.ndarray:
    """Components as doubles, exact for inner products below 2^53, else as 64-bit integers."""
    flat = rows.column("vector").combine_chunks()
    values = (flat.flatten() if isinstance(flat, pa.ListArray) else flat.chunk(0).flatten()).to_numpy(zero_copy_only=False)
    matrix = values.reshape(rows.num_rows, -1)
    largest = int(np.abs(matrix).max(initial=0))
    return matrix.astype(np.float64 if largest * largest * matrix.shape[1] < 1 << 53 else np.int64)


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``vec_id``, ``vector``: floor(scale * x) of every component, of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, bad))
    return kept.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vector"),
    ).filter(F.size("vector") > 0)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k largest inner products of each query.

    Both inputs have ``vec_id``, ``vector`` (integers).
    """
    rows = vectors.count()
    shards = max(1, -(-rows // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("shard")
    stored = written(vectors.select("vec_id", "vector", F.size("vector").alias("dim"), shard), "vectors")
    asked = queries.dropDuplicates(["vec_id", "vector"])
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    key = F.xxhash64("vector")
    asked = written(
        asked.select(
            F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim"), key.alias("query_key"),
            F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).alias("block"),
            F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(shards)).alias("home"),
        ),
        "queries",
    )
    dealt = stored.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    keys = ["dim", "shard", "block"]

    def searched(some: DataFrame) -> DataFrame:
        return (
            dealt.groupBy(*keys)
            .cogroup(some.select("query_id", "query_key", "vector", "floor", *keys).groupBy(*keys))
            .applyInArrow(_search(k), "query_id bigint, query_key bigint, vec_id bigint, score bigint")
        )

    at_home = asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("double"))
    first = written(searched(at_home), "home-results")
    who = ["query_id", "query_key"]
    # The kth score so far; with fewer than k results any score may still count.
    kth = first.groupBy(*who).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    others = (
        asked.join(kth, who, "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
        .filter("shard <> home")
    )
    every = first.unionByName(searched(others)) if shards > 1 else first
    order = Window.partitionBy(*who).orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) as score
  from v as q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
