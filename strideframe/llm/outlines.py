"""Exact search of the most similar course outlines, with one KD-tree per shard.

Records: outlines (course_id long, outline array of numbers), the resampled
silhouette of a course as one vector. A component x counts as floor(256 * x), x as
double; likeness is the inner product of these integers, exact while it and its
partial sums fit in 53 bits (else rounded as doubles are).
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.session import cut

SHARD_ROWS = 4096
LEAF_ROWS = 128
BLOCK_QUERIES = 512


class KdTree:
    """Median splits along the widest side; every node knows the tight box of its rows and their smallest id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        order = np.arange(len(ids))
        low, high, least = [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(self.span)
            if parent >= 0:
                pair = list(self.children[parent] or (0, 0))
                pair[side] = me
                self.children[parent] = (pair[0], pair[1])
            part = rows[order[lo:hi]]
            self.span.append((lo, hi))
            self.children.append(None)
            low.append(part.min(0))
            high.append(part.max(0))
            least.append(ids[order[lo:hi]].min())
            if hi - lo > LEAF_ROWS:
                axis = int(np.argmax(high[-1] - low[-1])) if rows.shape[1] else 0
                mid = (hi - lo) // 2
                if rows.shape[1]:
                    order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], mid)]
                self.children[me] = (0, 0)
                todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high, self.least = np.array(low), np.array(high), np.array(least)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no row of a node's box has a larger inner product."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, -id) of at least `floor`, best-first; the kth score found so far cuts the boxes below it."""
        best: list[tuple[float, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            worst = best[0] if len(best) == k else (floor, -(2**63))
            if -bound < worst[0]:
                break
            if (-bound, -int(self.least[node])) < worst:
                continue
            pair = self.children[node]
            if pair:
                for child in pair:
                    if bounds[child] >= worst[0]:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = self.span[node]
            scores = self.rows[lo:hi] @ query
            for i in np.flatnonzero(scores >= worst[0]):
                if self.ids[lo + i] == query_id:
                    continue
                entry = (float(scores[i]), -int(self.ids[lo + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return best


def grid_outlines(outlines: DataFrame) -> DataFrame:
    """(course_id, cells array<double>, dim): one row per id with a usable outline.

    Unusable are null ids, null outlines and outlines with a null or non-finite
    component. Of rows that repeat an id the smallest outline stays.
    """
    x = outlines.select("course_id", F.transform("outline", lambda v: v.cast("double")).alias("x")).where(
        "course_id IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")
    cells = x.select("course_id", F.transform("x", lambda v: F.floor(v * 256).cast("double")).alias("cells"))
    return cells.groupBy("course_id").agg(F.min("cells").alias("cells")).withColumn("dim", F.size("cells"))


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    flat = t.column(column).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))


def nearest_outlines(outlines: DataFrame, asked: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, course_id, score): for each outline that `asked` holds for, its k most similar other ones.

    Ties go to the smaller id; only outlines of one length are compared; fewer than k
    others give fewer rows. Shards by hash of the id hold about SHARD_ROWS outlines
    and one KD-tree each. A query first searches the tree it lives in; its kth score
    then goes along to all other trees in blocks of BLOCK_QUERIES, where it cuts every
    box that cannot reach it. A stated query set is searched against all rows, so the
    work is their product; neither side is broadcast.
    """
    rows = cut(grid_outlines(outlines).withColumn("asked", F.coalesce(asked, F.lit(False))))
    n_shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("course_id"), F.lit(n_shards)).cast("int"))

    def plant(t: pa.Table) -> pa.Table:
        tree = KdTree(t.column("course_id").to_numpy(), _matrix(t, "cells"))
        return pa.table({"shard": t.column("shard")[:1], "dim": t.column("dim")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = cut(rows.select("shard", "dim", "course_id", "cells").groupBy("shard", "dim").applyInArrow(plant, "shard int, dim int, tree binary"))
    schema = "query_id long, home int, course_id long, score double"

    def visit(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "home": [], "course_id": [], "score": []}
        if left.num_rows and right.num_rows:
            tree = pickle.loads(left.column("tree")[0].as_py())
            ids, homes, floors = (right.column(c).to_pylist() for c in ("course_id", "home", "floor"))
            queries = _matrix(right, "cells")
            bounds = tree.bounds(queries)
            shard = key[0].as_py()
            for q in range(len(ids)):
                if floors[q] is not None and homes[q] == shard:
                    continue
                for score, other in tree.search(ids[q], queries[q], bounds[q], k, -np.inf if floors[q] is None else floors[q]):
                    out["query_id"].append(ids[q])
                    out["home"].append(homes[q])
                    out["course_id"].append(-other)
                    out["score"].append(score)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("home", pa.int32()), ("course_id", pa.int64()), ("score", pa.float64())]))

    queries = rows.where("asked").withColumn("home", F.col("shard"))
    at_home = queries.select("shard", "dim", "course_id", "home", "cells", F.lit(None).cast("double").alias("floor"))
    first = cut(trees.groupBy("shard", "dim").cogroup(at_home.groupBy("shard", "dim")).applyInArrow(visit, schema))
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).select(
        F.col("query_id").alias("course_id"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(float("-inf"))).alias("floor"))
    n_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("course_id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block")
    abroad = queries.join(kth, "course_id", "left").select(
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "dim", block, "course_id", "home", "cells",
        F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    spread = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    rest = spread.groupBy("shard", "dim", "block").cogroup(abroad.groupBy("shard", "dim", "block")).applyInArrow(visit, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "course_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "course_id", F.col("score").cast("long").alias("score"))
