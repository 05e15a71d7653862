"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots.  A shard of vectors posts them in one inverted file for
each pivot: the vectors that have the pivot in their order, with the place it takes there.  A query reads the files of
the pivots in its own order only, which add up to the footrule distance between its order and every vector's.  The
nearest by footrule, ties included, are reranked by exact Euclidean distance, and shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div, prepare

#: Vectors the pivots are chosen from (a bounded sample; every vector is indexed), pivots, pivots in an order.
PIVOT_SAMPLE = 2048
PIVOTS = 1024
ORDER = 128
#: Share of a shard's vectors that the footrule ranking passes on, and candidates for each neighbour asked for at least.
CANDIDATE_SHARE = 0.04
CANDIDATES_EACH = 10
#: Vectors and queries in a task.
SHARD_VECTORS = 16_384
BLOCK_QUERIES = 16_384


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (doubles) and dim of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    found = table.column(name).combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(found) else np.zeros((0, dim))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots by farthest-first traversal: one dense group cannot take them all."""
    sample = np.unique(sample, axis=0)
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def orders(vectors: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """The size nearest pivots of each vector, nearest first; of equally near ones the earlier pivot first."""
    distance = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    if size >= len(pivots):
        return np.argsort(distance, axis=1, kind="stable")
    near = np.sort(np.argpartition(distance, size - 1, axis=1)[:, :size], axis=1)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(distance, near, 1), axis=1, kind="stable"), 1)


class PivotFiles:
    """One inverted file per pivot: the shard's vectors that have it in their order, and its place there."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, order: int):
        self.pivots, self.order, self.n = pivots, min(order, len(pivots)), len(vectors)
        found = np.concatenate([orders(vectors[at : at + 4096], pivots, self.order) for at in range(0, len(vectors), 4096)])
        pivot = found.ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        self.vectors = (by_pivot // self.order).astype(np.int32)
        self.places = (by_pivot % self.order).astype(np.int16)
        self.starts = np.searchsorted(pivot[by_pivot], np.arange(len(pivots) + 1))

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """What every vector's footrule distance from a query's order lies below the distance of orders without a common
        pivot (half of it).

        A pivot outside an order has the place `self.order` there: one that both hold, at p and q, takes
        2 * (self.order - max(p, q)) off the sum, and no other pivot takes anything off.
        """
        spans = [slice(self.starts[p], self.starts[p + 1]) for p in order.tolist()]
        place = np.repeat(np.arange(len(order), dtype=np.int16), [s.stop - s.start for s in spans])
        shared = self.order - np.maximum(np.concatenate([self.places[s] for s in spans]), place)
        return np.bincount(np.concatenate([self.vectors[s] for s in spans]), shared, self.n)

    def candidates(self, order: np.ndarray, share: float, least: int) -> np.ndarray:
        wanted = max(least, int(np.ceil(share * self.n)))
        if wanted >= self.n:
            return np.arange(self.n)
        near = self.nearness(order)
        return np.flatnonzero(near >= np.partition(near, self.n - wanted)[self.n - wanted])


def nearest(files: PivotFiles, ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, order: np.ndarray, k: int, share: float):
    """ids and exact distances of the k nearest candidates, nearest first, ties to the smaller id."""
    at = files.candidates(order, share, CANDIDATES_EACH * k)
    at = at[ids[at] != query_id]
    distance = np.sqrt(((vectors[at] - query) ** 2).sum(1))
    if len(at) > k:
        near = distance <= np.partition(distance, k - 1)[k - 1]
        at, distance = at[near], distance[near]
    best = np.lexsort((ids[at], distance))[:k]
    return ids[at[best]], distance[best]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int = PIVOTS, order: int = ORDER, share: float = CANDIDATE_SHARE
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest found vectors.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, as base or as query; nor
    do null ids.  Vectors of different lengths are never compared.  A query's own id is no candidate; repeated ids are
    candidates each.  Queries of one id with different vectors are ranked apart; equal ones are one query.  Ties go to
    the smaller id.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col).dropDuplicates(["vec_id", "v"]).withColumn("query", F.xxhash64("v"))
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample: dict[int, list] = {}
    for r in base.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= PIVOT_SAMPLE).select("dim", "v").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    sent = spark.sparkContext.broadcast({dim: spread(np.array(v, float), n_pivots) for dim, v in sample.items()})
    n_shards, n_blocks = max(1, ceil_div(base.count(), SHARD_VECTORS)), max(1, ceil_div(asked.count(), BLOCK_QUERIES))

    # Each shard of vectors meets each block of queries once.
    base = base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("long")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))

    def meet(key, left, right):
        rows: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            mine, wanted = matrix(left, "v", dim), matrix(right, "v", dim)
            pivots = sent.value[dim]
            files = PivotFiles(mine, pivots, order)
            found = orders(wanted, pivots, files.order)
            mine_ids, wanted_ids, names = ints_of(left, "vec_id"), ints_of(right, "vec_id"), ints_of(right, "query")
            for i, query_id in enumerate(wanted_ids.tolist()):
                near, distance = nearest(files, mine_ids, mine, query_id, wanted[i], found[i], k, share)
                rows[3] += [names[i]] * len(near)
                rows[0] += [query_id] * len(near)
                rows[1] += near.tolist()
                rows[2] += distance.tolist()
        return pa.table({"query_id": pa.array(rows[0], pa.int64()), "vec_id": pa.array(rows[1], pa.int64()), "score": pa.array(rows[2], pa.float64()), "query": pa.array(rows[3], pa.int64())})

    keys = ["dim", "shard", "block"]
    found = asked.groupBy(*keys)
    met = base.groupBy(*keys).cogroup(found).applyInArrow(meet, "query_id long, vec_id long, score double, query long")
    ranked = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return met.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ints_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()
