"""Connected components as a star forest, by joins and aggregates only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.session import cut, release


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def star_forest(links: DataFrame) -> DataFrame:
    """(node, root): every node of `links` (a, b) with the smallest node it can reach.

    Large-star and small-star steps alternate until every node hangs on its root.
    Each round moves only link rows, and its result is written to the shared
    folder, so neither the driver nor one task holds a component. Self links and
    links with a null end have no effect; a node without other links is left out.
    """
    cur = cut(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("v <> u").distinct()
        large = cut(large)
        least = _least_neighbour(large.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = least.select(F.col("u").alias("v"), F.col("m").alias("u"))
        moved = large.join(least.withColumnRenamed("u", "v"), "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        spent, cur = (cur, large), cut(hung.unionByName(moved).distinct())
        release(*spent)
        if cur.join(cur.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() and cur.groupBy("v").count().where("count > 1").isEmpty():
            return cur.select(F.col("v").alias("node"), F.col("u").alias("root"))


def spanning(n: int, good: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the pairs i < j of 0 .. n - 1 for which good(i, [j, ...]) holds.

    Every pair is tried unless links found before already join its two ends, so the
    components are those of all pairs, and a group of near copies costs one row of it.
    """
    label, a, b = np.arange(n), [], []
    for c in range(n - 1):
        rest = c + 1 + np.flatnonzero(label[c + 1:] != label[c])
        if not len(rest):
            continue
        hit = rest[good(c, rest)]
        if len(hit):
            gone, first = np.unique(label[hit], return_index=True)
            a.append(np.full(len(first), c))
            b.append(hit[first])
            label[np.isin(label, gone)] = label[c]
            if (label == label[c]).all():
                break
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def pair_parts(rows: DataFrame, own: str, most: int, task_rows: int) -> DataFrame:
    """rows (root, ...) with `part` and `task`: any two rows of a root meet in a part; parts of one task come together.

    Up to `most` rows a root are one part. More are dealt by hash of `own` into chunks
    of about that many, with one part for every two chunks, so no task holds a large root.
    """
    counts = rows.groupBy("root").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    dealt = rows.join(counts, "root").withColumn("chunk", F.pmod(F.xxhash64(own, F.lit(3)), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("part", F.xxhash64("root", F.least("chunk", "other"), F.greatest("chunk", "other")))
    n = counts.join(rows.groupBy("root").count(), "root").agg(F.sum(F.col("count") * F.col("chunks"))).first()[0] or 0
    return dealt.withColumn("task", F.pmod(F.xxhash64("part", F.lit(1)), F.lit(max(1, -(-n // task_rows))))).drop("chunks", "chunk", "other")
