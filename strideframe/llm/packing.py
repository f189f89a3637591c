"""Length buckets with least padding, and batches under a point budget inside each bucket.

Records: courses (course_id, n_points, any further columns). A null length counts
as 0; ties, repeated rows and rows without an id are packed like any other.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = 4096
STEPS = 256
SLICE_ROWS = 50_000


def _bin(n: Column) -> Column:
    """Histogram bin of a length: the length itself up to EXACT, above it STEPS bins per doubling."""
    power = F.floor(F.log2(n.cast("double") + 0.5))
    return F.when(n <= EXACT, n).otherwise(EXACT + (power - 12) * STEPS + F.floor((n / F.pow(F.lit(2.0), power) - 1) * STEPS) + 1).cast("long")


def length_histogram(courses: DataFrame) -> DataFrame:
    """(bin, longest, n, points) over all courses; at most EXACT + 51 * STEPS rows whatever the table holds."""
    n = F.greatest(F.coalesce(F.col("n_points").cast("long"), F.lit(0)), F.lit(0))
    return courses.select(n.alias("len")).groupBy(_bin(F.col("len")).alias("bin")).agg(
        F.max("len").alias("longest"), F.count("*").alias("n"), F.sum("len").alias("points"))


def best_bounds(longest: list[int], n: list[int], points: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets that minimise the padding, by dynamic programming over the histogram.

    Bucket (i, j] costs longest[j] * count - points. The best cut for j never moves
    left as j grows, so each layer is solved by halving: O(buckets * bins * log bins).
    """
    if not longest:
        return []
    m = len(longest)
    count, total = np.r_[0, np.cumsum(n)].astype(float), np.r_[0, np.cumsum(points)].astype(float)
    top = np.array(longest, float)
    best = np.r_[0.0, top * count[1:] - total[1:]]
    cuts = [np.zeros(m + 1, np.int64)]
    for _ in range(min(buckets, m) - 1):
        new, cut_at = np.zeros(m + 1), np.zeros(m + 1, np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            cost = best[i] + top[j - 1] * (count[j] - count[i]) - (total[j] - total[i])
            k = int(np.argmin(cost))
            new[j], cut_at[j] = cost[k], i[k]
            todo += [(lo, j - 1, left, int(i[k])), (j + 1, hi, int(i[k]), right)]
        best = new
        cuts.append(cut_at)
    bounds, j = [], m
    for cut_at in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(longest[j - 1]))
        j = int(cut_at[j])
    return sorted(set(bounds))


def length_bounds(courses: DataFrame, buckets: int = 8) -> list[int]:
    """Bucket bounds of a table. The driver sees only the histogram, whose size is bounded."""
    rows = sorted(length_histogram(courses).collect())
    return best_bounds([r["longest"] for r in rows], [r["n"] for r in rows], [r["points"] for r in rows], buckets)


def pack_courses(courses: DataFrame, buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """(course_id, n_points, bucket, bucket_points, batch, place, padding): the batch of every course.

    bucket_points is the length to which the bucket pads. A batch of a bucket takes
    budget // bucket_points courses, at least one, so only a course longer than the
    budget goes over it, alone. Order inside a bucket is by hash of the id. Courses
    of a bucket are numbered slice by slice, with the counts of the slices before, so
    no task sees a whole bucket. An empty table gives no rows.
    """
    n = F.greatest(F.coalesce(F.col("n_points").cast("long"), F.lit(0)), F.lit(0))
    rows = courses.select("course_id", n.alias("n_points"))
    bounds = length_bounds(rows, buckets) or [0]
    number = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        number = F.when(F.col("n_points") <= bounds[i], F.lit(i)).otherwise(number)
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    keyed = rows.withColumn("bucket", number).withColumn("mark", F.xxhash64("course_id", "n_points"))
    keyed = keyed.withColumn("part", F.pmod("mark", F.lit(slices)).cast("int"))
    counts = keyed.groupBy("bucket", "part").agg(F.count("*").alias("n"))


    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = keyed.join(before.select("bucket", "part", F.coalesce("before", F.lit(0)).alias("before")), ["bucket", "part"])
    w = Window.partitionBy("bucket", "part").orderBy("mark", "course_id", "n_points")
    placed = placed.withColumn("at", F.col("before") + F.row_number().over(w) - 1)
    length = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    take = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), length)))
    return placed.select("course_id", "n_points", "bucket", length.alias("bucket_points"), F.floor(F.col("at") / take).alias("batch"),
                         (F.col("at") % take).alias("place"), (length - F.col("n_points")).alias("padding"))
