"""Approximate nearest neighbours by collision-counting hashing.

A block of vectors has ``PROJECTIONS`` arrays, each the vectors sorted by one
random projection. For a query, a window centred at its own projection is opened
in every array; the window is widened step by step (virtual rehashing) and each
vector's collisions, the windows it has been in, are counted. Vectors with
enough collisions are verified by their distance. The query ends when its k-th
distance is within the radius that the windows stand for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, ship

#: Sorted arrays of a block, and the share of them a vector must collide in.
PROJECTIONS, COLLISIONS = 64, 0.56
#: Half a window's width for radius 1, and the factor from one radius to the next.
HALF_WIDTH, GROWTH = 1.0, 1.25
#: Vectors and queries that are compared at once.
BLOCK_ROWS, QUERY_ROWS = 8192, 16384
SEED = 7


class SortedProjections:
    """The sorted arrays of one block of vectors of equal length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        projected = vectors @ self.axes
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)
        # a first radius that few vectors lie within
        spread = np.sqrt(((vectors - vectors.mean(0)) ** 2).sum(1)).mean()
        self.radius = max(spread / 16, 1e-12)

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest found, as (distance, id), nearest first, ties by id."""
        at, n, base = query @ self.axes, len(self.ids), np.arange(PROJECTIONS) * len(self.ids)
        low = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at, strict=True)])
        high, flat = low.copy(), self.order.ravel()
        count = np.zeros(n, np.int64)
        checked = self.ids == own
        need = math.ceil(COLLISIONS * PROJECTIONS)
        best: list[tuple[float, int]] = []
        radius = self.radius
        while True:
            half = HALF_WIDTH * radius
            ends = np.array([np.searchsorted(s, (x - half, np.nextafter(x + half, np.inf))) for s, x in zip(self.sorted, at, strict=True)])
            a, b = np.minimum(ends[:, 0], low), np.maximum(ends[:, 1], high)
            # what the wider windows add at both sides
            count += np.bincount(ragged(flat, np.r_[base + a, base + high], np.r_[low - a, b - high]), minlength=n)
            low, high = a, b
            fresh = np.flatnonzero((count >= need) & ~checked)
            if len(fresh):
                checked[fresh] = True
                gap = self.vectors[fresh] - query
                distance = np.sqrt((gap * gap).sum(1))
                ids = self.ids[fresh]
                first = np.lexsort((ids, distance))[:k]
                best = sorted([*best, *zip(distance[first].tolist(), ids[first].tolist(), strict=True)])[:k]
            if len(best) == k and best[-1][0] <= radius or not low.any() and (high == n).all():
                return best
            radius *= GROWTH


def usable(vector: Column) -> Column:
    """Is a vector neither null, empty nor zero, and are all its components finite?"""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(table: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the
    Euclidean distance of the original vectors in double precision, nearest
    first, ties to the smaller id. Candidates are all rows but those with the
    query's id; all of them, if there are fewer than ``k``. Vectors that are null,
    empty, zero or have null or non-finite components take no part, nor do null
    ids; vectors are compared with those of their length. Repeated rows are
    candidates of their own, and a repeated query is answered once. An empty
    table gives an empty result. Other columns are ignored, whatever their names.

    Vectors are dealt out in blocks of about BLOCK_ROWS rows, queries in blocks of
    QUERY_ROWS; each pair of blocks is one group, and a query's results of all
    blocks are merged by rank.
    """
    ship(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null").where(usable(F.col("v")))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n, q = rows.count(), queries.count()
    n_blocks, n_query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-q // QUERY_ROWS))
    number = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)).cast("int")).withColumn("query_block", number(n_query_blocks))
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)).cast("int")).withColumn("block", number(n_blocks))

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        by_size: dict[int, list[int]] = {}
        vectors = data.column("v").to_pylist()
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        ids = data.column("id").to_numpy()
        blocks = {size: SortedProjections(ids[at], np.array([vectors[i] for i in at])) for size, at in by_size.items()}
        for own, v in zip(asked.column("id").to_pylist(), asked.column("v").to_pylist(), strict=True):
            if len(v) in blocks:
                found += [(own, i, d) for d, i in blocks[len(v)].search(own, np.array(v), k)]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    near = data.groupBy("block", "query_block").cogroup(asked.groupBy("block", "query_block")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

