"""Decoys for course outlines: similar courses of another shape, found in R-trees.

Records: outlines (course_id long, shape, outline array of numbers), the resampled
silhouette of a course as one vector and the key of its shape. A component x counts
as floor(256 * x), x as double; likeness is the inner product of these integers,
exact while it and its partial sums fit in 53 bits.

Trees are packed by sort-tile-recursive. The rows are dealt to tiles of alike outlines
on Spark, one tree a tile; the boxes of the trees are packed in trees of their own,
which tell a search the few tiles it has to visit.
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
LEAF_ROWS = 64
FAN_OUT = 16
BLOCK_ASKS = 512
#: Axes by which rows are dealt to tiles on Spark; within a tile the tree uses its own.
TILE_AXES = 3


def str_order(low: np.ndarray, high: np.ndarray, ids: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Sort-tile-recursive: the boxes in packs of at most `capacity`, by their centres.

    The axes are those of the widest spread. With P packs and d axes left, the boxes
    are sorted by one axis and cut into ceil(P^(1/d)) slabs, each of which goes on
    with the next axis. Ties are sorted by id, so that equal rows lie in order.
    """
    centre = (low + high) / 2
    packs = -(-len(ids) // capacity)
    n_axes = min(centre.shape[1], max(1, int(np.ceil(np.log2(max(2, packs))))))
    axes = np.argsort(-np.ptp(centre, axis=0), kind="stable")[:n_axes] if centre.shape[1] else []
    todo, out = [(np.argsort(ids, kind="stable"), 0)], []
    while todo:
        rows, k = todo.pop(0)
        need = -(-len(rows) // capacity)
        if k < len(axes):
            rows = rows[np.argsort(centre[rows, axes[k]], kind="stable")]
        if need <= 1 or k >= len(axes) - 1:
            out += [rows[i:i + capacity] for i in range(0, len(rows), capacity)]
            continue
        slabs = int(np.ceil(need ** (1 / (len(axes) - k)) - 1e-9))
        size = capacity * -(-need // slabs)
        todo += [(rows[i:i + size], k + 1) for i in range(0, len(rows), size)]
    return out


class RTree:
    """An R-tree packed bottom up. Nodes are numbered from the leaves to the root, which is the last one.

    Each node has its box, its smallest id and, where all its rows are of one shape,
    the code of that shape (else -1).
    """

    def __init__(self, ids, marks, shapes, low, high, leaf_rows: int, fan_out: int):
        self.names = sorted(set(shapes), key=repr)
        code = {s: i for i, s in enumerate(self.names)}
        codes = np.array([code[s] for s in shapes], np.int64)
        packs = str_order(low, high, ids, leaf_rows)
        order = np.concatenate(packs) if packs else np.zeros(0, np.int64)
        self.ids, self.marks, self.codes, self.low, self.high = ids[order], marks[order], codes[order], low[order], high[order]
        ends = np.cumsum([len(p) for p in packs])
        self.spans = [(int(e) - len(p), int(e)) for e, p in zip(ends, packs)]
        self.children: list[list[int]] = []
        box_low = [self.low[a:b].min(0) for a, b in self.spans]
        box_high = [self.high[a:b].max(0) for a, b in self.spans]
        least = [self.ids[a:b].min() for a, b in self.spans]
        pure = [self.codes[a] if (self.codes[a:b] == self.codes[a]).all() else -1 for a, b in self.spans]
        level = list(range(len(self.spans)))
        while len(level) > 1:
            at = np.array(level)
            up = []
            for pack in str_order(np.array([box_low[i] for i in at]), np.array([box_high[i] for i in at]), at, fan_out):
                kids = [int(i) for i in at[pack]]
                up.append(len(box_low))
                self.children.append(kids)
                box_low.append(np.min([box_low[i] for i in kids], axis=0))
                box_high.append(np.max([box_high[i] for i in kids], axis=0))
                least.append(min(least[i] for i in kids))
                pure.append(pure[kids[0]] if len({pure[i] for i in kids}) == 1 else -1)
            level = up
        self.box_low, self.box_high, self.least, self.pure = np.array(box_low), np.array(box_high), np.array(least), np.array(pure)

    def intervals(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asks, nodes) least and greatest inner product with a row of the node's box: the sums of the intervals of the coordinates."""
        up, down = np.maximum(asked, 0), np.minimum(asked, 0)
        return up @ self.box_low.T + down @ self.box_high.T, up @ self.box_high.T + down @ self.box_low.T

    def kids(self, node: int) -> list[int]:
        return self.children[node - len(self.spans)]

    def search(self, ask: dict, least: np.ndarray, greatest: np.ndarray, k: int) -> list[tuple[float, int, int]]:
        """The k best (score, -id, mark) with a score in the ask's window, best-first.

        A box is left out if its interval misses the window, if it ends strictly below
        the kth score (found, or given as floor), or holds only rows of the wrong shape.
        """
        wanted = self.names.index(ask["shape"]) if ask["shape"] in self.names else -2
        lo, hi, same = ask["lo"], ask["hi"], ask["same"]
        best: list[tuple[float, int, int]] = []

        def worst():
            return best[0][:2] if len(best) == k else (ask["floor"], -(2**63))

        def open_(node):
            if least[node] > hi or greatest[node] < lo or (self.pure[node] >= 0 and (self.pure[node] == wanted) != same):
                return None
            top = min(greatest[node], hi)
            return None if (top, -int(self.least[node])) < worst() else top

        heap, root = [], len(self.least) - 1
        if root >= 0 and (top := open_(root)) is not None:
            heap = [(-top, int(self.least[root]), root)]
        while heap:
            top, _, node = heapq.heappop(heap)
            if -top < worst()[0]:
                break
            if open_(node) is None:
                continue
            if node >= len(self.spans):
                for kid in self.kids(node):
                    if (top := open_(kid)) is not None:
                        heapq.heappush(heap, (-top, int(self.least[kid]), kid))
                continue
            a, b = self.spans[node]
            scores = self.low[a:b] @ ask["cells"]
            fits = (scores >= max(lo, worst()[0])) & (scores <= hi) & ((self.codes[a:b] == wanted) == same)
            for i in np.flatnonzero(fits):
                if self.ids[a + i] == ask["course_id"] and self.marks[a + i] == ask["mark"]:
                    continue
                entry = (float(scores[i]), -int(self.ids[a + i]), int(self.marks[a + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return best

    def reach(self, ask: dict, least: np.ndarray, greatest: np.ndarray) -> list[int]:
        """Ids of the boxes that may hold a row of the window at or above the floor."""
        found, todo = [], [len(self.least) - 1] if len(self.least) else []
        while todo:
            node = todo.pop()
            if least[node] > ask["hi"] or greatest[node] < max(ask["lo"], ask["floor"]):
                continue
            if node >= len(self.spans):
                todo += self.kids(node)
                continue
            a, b = self.spans[node]
            up, down = np.maximum(ask["cells"], 0), np.minimum(ask["cells"], 0)
            first, last = self.low[a:b] @ up + self.high[a:b] @ down, self.high[a:b] @ up + self.low[a:b] @ down
            found += self.ids[a:b][(first <= ask["hi"]) & (last >= max(ask["lo"], ask["floor"]))].tolist()
        return found


def usable_outlines(outlines: DataFrame) -> DataFrame:
    """(course_id, shape, cells array<double>, dim, mark): the rows that take part, one a row of outlines.

    Left out are rows with a null id or shape, and outlines that are null or hold a
    null or non-finite component. `mark` tells rows that repeat an id apart.
    """
    x = outlines.select("course_id", "shape", F.transform("outline", lambda v: v.cast("double")).alias("x")).where(
        "course_id IS NOT NULL AND shape IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")
    cells = x.select(F.col("course_id").cast("long").alias("course_id"), "shape", F.transform("x", lambda v: F.floor(v * 256).cast("double")).alias("cells"))
    counted = cells.groupBy("course_id", "shape", "cells").agg(F.count("*").alias("n"))
    again = counted.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return again.select("course_id", "shape", "cells", F.size("cells").alias("dim"), F.xxhash64("shape", "cells", "again").alias("mark"))


def deal_tiles(rows: DataFrame) -> DataFrame:
    """rows with `shard`: sort-tile-recursive on Spark, by the axes of the widest spread, to about SHARD_ROWS rows a shard.

    Each axis cuts every tile at quantiles of its own. A tile that equal outlines keep
    larger is dealt on by a hash of the row, so no shard grows with the table.
    """
    rows = rows.withColumn("tile", F.col("dim").cast("string"))
    n_rows, dims = rows.agg(F.count("*"), F.max("dim")).first()
    slabs = int(np.ceil((max(1, n_rows) / SHARD_ROWS) ** (1 / TILE_AXES) - 1e-9))
    if slabs > 1 and dims:
        spread = rows.select(F.posexplode("cells").alias("axis", "x")).groupBy("axis").agg(F.variance("x").alias("v"))
        axes = [r[0] for r in spread.orderBy(F.desc_nulls_last("v"), "axis").limit(TILE_AXES).collect()]  # one row a coordinate before the limit
        for axis in axes:
            x = F.coalesce(F.get("cells", F.lit(axis)), F.lit(0.0))
            cuts = rows.groupBy("tile").agg(F.percentile_approx(x, [i / slabs for i in range(1, slabs)], 10 * slabs).alias("cuts"))
            slab = F.size(F.filter("cuts", lambda c: c < x))
            rows = cut(rows.join(cuts, "tile").withColumn("tile", F.concat_ws("/", "tile", slab)).drop("cuts"))
    parts = rows.groupBy("tile").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("parts"))
    part = F.pmod(F.xxhash64("course_id", "mark"), F.col("parts"))
    return rows.join(parts, "tile").withColumn("shard", F.concat_ws("#", "tile", part)).drop("tile", "parts")


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    flat = t.column(column).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))


def plant(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees (shard, dim, tree) of rows with shards, and the trees (piece, dim, n_shards, names, tree) over their boxes."""
    def leafy(t: pa.Table) -> pa.Table:
        cells = _matrix(t, "cells")
        tree = RTree(t.column("course_id").to_numpy(), t.column("mark").to_numpy(), t.column("shape").to_pylist(), cells, cells, LEAF_ROWS, FAN_OUT)
        return pa.table({"shard": t.column("shard")[:1], "dim": t.column("dim")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary()),
                         "low": pa.array([tree.box_low[-1].tolist()], pa.list_(pa.float64())), "high": pa.array([tree.box_high[-1].tolist()], pa.list_(pa.float64()))})

    def upper(t: pa.Table) -> pa.Table:
        names = t.column("shard").to_pylist()
        own = np.arange(len(names))
        tree = RTree(own, own, [0] * len(names), _matrix(t, "low"), _matrix(t, "high"), FAN_OUT, FAN_OUT)
        return pa.table({"piece": t.column("piece")[:1], "dim": t.column("dim")[:1], "tree": pa.array([pickle.dumps((names, tree))], pa.binary())})

    trees = cut(rows.select("shard", "dim", "course_id", "mark", "shape", "cells").groupBy("shard", "dim").applyInArrow(
        leafy, "shard string, dim int, tree binary, low array<double>, high array<double>"))
    n_pieces = max(1, -(-trees.count() // SHARD_ROWS))
    piece = F.pmod(F.xxhash64("shard"), F.lit(n_pieces)).cast("int").alias("piece")
    roots = cut(trees.select("shard", "dim", "low", "high", piece).groupBy("piece", "dim").applyInArrow(upper, "piece int, dim int, tree binary"))
    return trees.select("shard", "dim", "tree"), roots


_FOUND = pa.schema([("ask", pa.string()), ("other_id", pa.int64()), ("other_mark", pa.int64()), ("score", pa.float64())])
_ROUTE = pa.schema([("ask", pa.string()), ("shard", pa.string())])


def _asks(t: pa.Table) -> tuple[list[dict], np.ndarray]:
    cells = _matrix(t, "cells")
    asks = t.select(["ask", "course_id", "mark", "shape", "same", "lo", "hi", "floor"]).to_pylist()
    for ask, own in zip(asks, cells):
        ask["cells"] = own
    return asks, cells


def best_in_window(trees: DataFrame, roots: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(ask, other_id, other_mark, score): for each ask its k best rows; ties go to the smaller id.

    asks: (ask string, course_id, mark, shape, shard, dim, cells, same, lo, hi), where
    rows of the same shape (or only those of another) with a score from lo to hi
    count, the asking row itself left out. An ask searches its own tile first. Its
    kth score there is the floor with which the boxes of all tiles are looked
    through; only tiles whose box reaches floor and window are visited.
    """
    def visit(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {f.name: [] for f in _FOUND}
        if left.num_rows and right.num_rows:
            tree = pickle.loads(left.column("tree")[0].as_py())
            own, cells = _asks(right)
            least, greatest = tree.intervals(cells)
            for q, ask in enumerate(own):
                for score, other, mark in tree.search(ask, least[q], greatest[q], k):
                    for column, value in zip(out, (ask["ask"], -other, mark, score)):
                        out[column].append(value)
        return pa.table(out, schema=_FOUND)

    def route(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"ask": [], "shard": []}
        if left.num_rows and right.num_rows:
            names, tree = pickle.loads(left.column("tree")[0].as_py())
            own, cells = _asks(right)
            least, greatest = tree.intervals(cells)
            for q, ask in enumerate(own):
                reached = [names[i] for i in tree.reach(ask, least[q], greatest[q])]
                out["ask"] += [ask["ask"]] * len(reached)
                out["shard"] += reached
        return pa.table(out, schema=_ROUTE)

    n_blocks = max(1, -(-asks.count() // BLOCK_ASKS))
    block = F.pmod(F.xxhash64("ask"), F.lit(n_blocks)).cast("int")
    columns = ["ask", "course_id", "mark", "shape", "dim", "cells", "same", "lo", "hi"]
    found_type, blocks = "ask string, other_id long, other_mark long, score double", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))

    def visits(asked: DataFrame) -> DataFrame:
        """A tree is copied only to the blocks whose asks come to it."""
        asked = asked.withColumn("block", block)
        near = trees.join(asked.select("shard", "dim", F.col("block").alias("copy")).distinct(), ["shard", "dim"])
        return near.groupBy("shard", "dim", "copy").cogroup(asked.groupBy("shard", "dim", "block")).applyInArrow(visit, found_type)

    first = cut(visits(asks.select(*columns, "shard", F.lit(float("-inf")).alias("floor"))))
    kth = first.groupBy("ask").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).select("ask", F.col("low").alias("floor"))
    # an ask has rows of many tiles, whose names take a few bytes each in a file and far more in memory: Spark, which
    # goes by the file, would broadcast them, so joins by ask are named
    floored = asks.join(kth.hint("merge"), "ask", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    spread = roots.withColumn("block", blocks)
    n_pieces = roots.agg(F.max("piece")).first()[0] or 0
    looking = floored.select(*columns, "floor", F.explode(F.sequence(F.lit(0), F.lit(n_pieces))).alias("piece"), block.alias("block"))
    routes = cut(spread.groupBy("piece", "dim", "block").cogroup(looking.groupBy("piece", "dim", "block")).applyInArrow(route, "ask string, shard string"))
    abroad = floored.withColumnRenamed("shard", "home").join(routes.hint("merge"), "ask").where("home <> shard").select(*columns, "floor", "shard")
    both = first.unionByName(visits(abroad))
    w = Window.partitionBy("ask").orderBy(F.desc("score"), "other_id", "other_mark")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def decoy_outlines(outlines: DataFrame, asked: Column, n_positives: int = 5, k: int = 5, least_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): decoys for each row that `asked` holds for.

    The positives of an anchor are the n_positives most similar other rows of its
    shape. For each, the k most similar rows of another shape follow whose score is
    from least_percent to 100 percent of the positive's (none where that is below 0).
    Higher scores come first, ties go to the smaller id; fewer rows where fewer fit.

    Rows with a null id, shape or outline, or with a null or non-finite component,
    take no part. Rows that repeat an id all take part, each with results of its own.
    Only outlines of one length are compared, of any length, 0 included. Empty tables
    give no rows. Further columns are not read; `asked` may only use course_id and shape.

    A stated set of anchors is searched against all rows; nothing is broadcast, and a
    shape or outline that many rows share is spread over shards of bounded size.
    """
    rows = cut(deal_tiles(cut(usable_outlines(outlines))))
    trees, roots = plant(rows)
    anchors = cut(rows.where(asked).withColumn("ask", F.concat_ws(":", "course_id", "mark")))
    all_scores = anchors.select("*", F.lit(True).alias("same"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    positives = cut(best_in_window(trees, roots, all_scores, n_positives).select(
        F.col("ask").alias("anchor"), F.col("other_id").alias("positive_id"), F.col("other_mark").alias("positive_mark"), F.col("score").alias("hi")))
    windows = anchors.withColumnRenamed("ask", "anchor").join(positives.hint("merge"), "anchor").select(
        "course_id", "mark", "shape", "shard", "dim", "cells", F.lit(False).alias("same"), (F.ceil(F.col("hi") * least_percent / 100)).cast("double").alias("lo"), "hi",
        "positive_id", F.concat_ws(":", "anchor", "positive_id", "positive_mark").alias("ask"))
    windows = cut(windows.where("lo <= hi"))
    found = best_in_window(trees, roots, windows, k)
    named = found.join(windows.select("ask", F.col("course_id").alias("anchor_id"), "positive_id", F.col("hi").alias("positive_score")).hint("merge"), "ask")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
                        F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))
