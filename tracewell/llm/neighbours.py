"""Approximate nearest neighbours by collision counting.

A largest inner product becomes a least distance when each vector gets one more component that brings it to the
length of the longest. Each of ``PROJECTIONS`` random directions gives a sorted array of a block's projections, and a
query has a place in it. A window around that place holds the vectors that collide with the query. Virtual
rehashing: a query's windows start small and grow in each round, at once to the width at which it may stop where it has k already. A vector whose
collisions reach the threshold is verified with its exact product, in double
precision on the original components. A query stops in a block when its k-th best distance lies within the windows' radius,
or when windows hold the whole block. Collisions are counted by comparing places in the sorted arrays with the ends of windows, 32 at
an instruction; to walk the windows and add one at each vector's count touches fewer numbers and took some twenty times as long.

All vectors are indexed, in blocks of up to ``BLOCK`` rows and ``BYTES``; queries go in lots of up to ``QUERIES``, and a unit of work is a
block and a lot, which builds the block's arrays once. The best k of each unit meet in one aggregate of k * units rows a query. Every lot meets every block: vectors without
structure have neighbours in half of any parts that a partition makes (of 64 clusters of the test vectors, 32 hold 0.9 of the nearest), so that the work grows
with queries times vectors, but a vector is copied only once for each lot.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. Only
vectors of one length meet. Rows that repeat an id are candidates each; a query's own rows are those of its id. Ties go to the smaller id. With fewer candidates than k all are
returned. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, PROJECTIONS, THRESHOLD = 20, 48, 0.5
#: The first window's half width as a share of the longest vector, its least growth, and the half width at which a query may
#: stop, as a share of its k-th best distance (a normal projection of that distance is below 0.67 of it every other time).
WIDTH, GROWTH, SURE = 0.7, 1.2, 0.88
#: Rows and bytes of a block at most, queries of a lot at most; the least that a table is cut into, so that a small one has tasks enough.
BLOCK, BYTES, QUERIES, LEAST_BLOCK, LEAST_LOT = 32_768, 32 << 20, 16_384, 4096, 1024
#: Queries that a unit works on together.
TOGETHER = 256


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dim): the rows that take part."""
    v = F.col(vector)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0)
    return df.where(good).select(F.col(key).alias("id"), v.alias("v"), F.size(v).alias("dim"))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(PROJECTIONS, dim + 1))


class Block:
    """A block's vectors with their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        self.along = directions(vectors.shape[1])
        at = np.c_[vectors, rest] @ self.along.T
        order = np.argsort(at, axis=0, kind="stable").T
        self.places = np.take_along_axis(at.T, order, 1)
        # Each vector's place in each sorted array: whether it lies in a window is one comparison of its place.
        self.place = np.empty(order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.place.dtype)[None, :], 1)

    def windows(self, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and projection, the part of the sorted array within half of its centre."""
        low = np.stack([np.searchsorted(p, c - half) for p, c in zip(self.places, centres.T)], 1)
        high = np.stack([np.searchsorted(p, c + half, "right") for p, c in zip(self.places, centres.T)], 1)
        return low, high

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and products of its nearest found in this block, best first."""
        n, need = len(self.ids), int(np.ceil(THRESHOLD * PROJECTIONS))
        # Scaled to the common length a query has the same order of products.
        scale = self.longest / np.sqrt((queries**2).sum(1))
        centres = (queries * scale[:, None]) @ self.along[:, :-1].T
        score = [np.zeros(0)] * len(queries)
        found = [np.zeros(0, np.int64)] * len(queries)
        verified = np.zeros((len(queries), n), bool)
        open_ = np.arange(len(queries))
        half = np.full(len(queries), WIDTH * self.longest)
        kind = self.place.dtype
        while len(open_):
            low, high = self.windows(centres[open_], half[open_])
            still = []
            for q, a, b in zip(open_, low, high):
                inside = (self.place - a.astype(kind)[:, None]) < (b - a).astype(kind)[:, None]  # unsigned: below the window wraps
                counts = np.add.reduce(inside, axis=0, dtype=np.uint8)
                fresh = np.flatnonzero((counts >= need) & ~verified[q])
                verified[q, fresh] = True
                fresh = fresh[self.ids[fresh] != own[q]]
                found[q] = np.r_[found[q], fresh]
                score[q] = np.r_[score[q], (self.vectors[fresh] * queries[q]).sum(1)]  # equal vectors, equal sums
                if (a == 0).all() and (b == n).all():
                    continue
                wanted = half[q] * GROWTH
                if len(found[q]) >= k:
                    kth = np.partition(score[q], len(score[q]) - k)[len(score[q]) - k]
                    sure = np.sqrt(max(0.0, 2 * self.longest**2 - 2 * kth * scale[q])) * SURE
                    if sure <= half[q]:
                        continue
                    wanted = sure  # the k-th distance can only fall, so that this round is the last
                half[q] = wanted
                still.append(q)
            open_ = np.array(still, int)
        out = []
        for at, value in zip(found, score):
            top = np.lexsort((self.ids[at], -value))[:k]
            out.append((self.ids[at][top], value[top]))
        return out


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of df, its own aside, by largest inner product."""
    rows, asked = usable(df, key, vector), usable(queries, key, vector)
    double = F.transform("v", lambda x: x.cast("double"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate(double, F.lit(0.0), lambda a, x: a + x * x)).alias("square"))
    asked_n = asked.groupBy("dim").agg(F.count("*").alias("m"))
    most = F.greatest(F.least(F.lit(BLOCK), F.floor(BYTES / (8 * F.col("dim")))), F.lit(1))
    block = F.least(most, F.greatest(F.ceil(F.col("n") / 6), F.lit(LEAST_BLOCK)))
    lot = F.least(F.least(F.lit(QUERIES), most), F.greatest(F.ceil(F.col("m") / 2), F.lit(LEAST_LOT)))
    plan = sizes.join(asked_n, "dim").select("dim", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / lot).cast("int").alias("lots"), F.sqrt("square").alias("longest"))
    plan = F.broadcast(plan)  # a row for each length of vectors
    mine = rows.join(plan, "dim").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
    theirs = asked.join(plan, "dim").withColumn("lot", F.pmod(F.xxhash64("id", "v"), F.col("lots")).cast("int"))
    left = mine.select("dim", "block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "id", "v", "longest")
    right = theirs.select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "lot", "id", "v")

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        matrix = lambda t: np.array(t.column("v").combine_chunks().flatten(), float).reshape(t.num_rows, -1)
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if held.num_rows and asking.num_rows:
            block = Block(held.column("id").to_numpy(), matrix(held), held.column("longest")[0].as_py())
            own, wanted = asking.column("id").to_numpy(), matrix(asking)
            for at in range(0, len(own), TOGETHER):
                got = block.search(wanted[at : at + TOGETHER], own[at : at + TOGETHER], k)
                out[0].append(np.repeat(own[at : at + TOGETHER], [len(x) for x, _ in got]))
                for rows_, x in zip(out[1:], zip(*got)):
                    rows_.extend(x)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out))))

    found = left.groupBy("dim", "block", "lot").cogroup(right.groupBy("dim", "block", "lot")).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(20)) == 0))
