"""Exact order statistics without a global sort: positions, percentiles and standings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.session import cut

BUCKETS = 4096
SAMPLE_TARGET = 20_000  # fixed value: size the citywide sample aims at


def with_rank(df: DataFrame, order: list[Column], out: str = "rank0") -> DataFrame:
    """Global 0-based position in `order` (make it unique), without a single-partition window.

    Rows are range-partitioned on the order and kept, numbered inside each
    partition, and shifted by the sizes of the partitions before them.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    return (placed.withColumn("_pos", F.row_number().over(inside)).join(before, "_part")
            .withColumn(out, F.col("_skip") + F.col("_pos") - 1).drop("_part", "_pos", "_skip"))


def systematic_sample(scored: DataFrame, order: list[Column], target: int = SAMPLE_TARGET) -> DataFrame:
    """Every max(1, n // target)-th row in a fixed order; fewer than 2 * target rows."""
    step = max(1, scored.count() // target)
    if step == 1:
        return scored
    return with_rank(scored, order).where(F.col("rank0") % step == 0).drop("rank0")


def standing(scores: DataFrame, sample: DataFrame, value: str = "rfs", out: str = "top_percent") -> DataFrame:
    """scores plus their citywide top percent: max(1, round(100 * (1 - below / n))).

    sample: column `value` in 0..1, fewer than 2 * SAMPLE_TARGET rows. It is
    folded into 10,001 value buckets carrying the count before the bucket and
    the bucket's own values, so a score needs one equi join.
    """
    def bucket(c: Column) -> Column:
        return F.floor(c * 10000).cast("int")

    steps = (sample.groupBy(value).agg(F.count("*").alias("c")).groupBy(bucket(F.col(value)).alias("b"))
             .agg(F.collect_list(F.struct(F.col(value).alias("v"), "c")).alias("steps"), F.sum("c").alias("own")))
    every = sample.sparkSession.range(10001).select(F.col("id").cast("int").alias("b"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    ladder = (every.join(steps, "b", "left")
              .withColumn("own", F.coalesce("own", F.lit(0)))
              .withColumn("upto", F.sum("own").over(upto))
              .withColumn("n", F.max("upto").over(Window.partitionBy(F.lit(1))))
              .select("b", "steps", (F.col("upto") - F.col("own")).alias("before"), "n"))
    joined = scores.withColumn("b", bucket(F.col(value))).join(ladder, "b")
    lower = F.aggregate(F.filter(F.coalesce("steps", F.array()), lambda s: s.v < F.col(value)), F.lit(0).cast("long"),
                        lambda a, s: a + s.c)
    below = F.col("before") + lower
    percent = F.greatest(F.lit(1.0), F.rint(100.0 * (1.0 - below / F.col("n"))))
    return joined.withColumn(out, percent.cast("int")).drop("b", "steps", "before", "n")


def value_at(df: DataFrame, value: str, picks: dict[str, tuple[int, int]], by: str | None = None) -> DataFrame:
    """Exact order statistics v[floor(n * num / den)], overall and, with `by`, per group.

    picks: output name -> (num, den). Returns one row per group (`by` null and
    is_overall true for all rows together) with n, min/max, and a column per
    pick. Two rounds of counting in value buckets find the narrow slice that
    holds each wanted position; only that slice is looked at value by value.
    """
    src = df.select(*([by] if by else []), F.col(value).cast("double").alias("v"))
    if by:
        src = src.select(F.explode(F.array(F.struct(F.lit(False).alias("is_overall"), F.col(by).alias("g")),
                                           F.struct(F.lit(True).alias("is_overall"), F.lit(None).alias("g")))).alias("k"), "v")
        src = src.select("k.is_overall", "k.g", "v")
    else:
        src = src.select(F.lit(True).alias("is_overall"), F.lit(None).cast("string").alias("g"), "v")
    totals = src.groupBy("is_overall", "g").agg(F.count("*").alias("n"), F.avg("v").alias("avg"), F.min("v").alias("lo"),
                                                F.max("v").alias("hi"))
    wanted = totals.select("is_overall", "g", "n", "avg", "lo", "hi", F.explode(F.array(*[
        F.struct(F.lit(k).alias("pick"), F.floor(F.col("n") * num / den).cast("long").alias("at"))
        for k, (num, den) in picks.items()])).alias("p")).select("*", "p.pick", "p.at").drop("p")
    slices = wanted.select("is_overall", "g", "pick", "at", "lo", "hi")
    same = F.col("g").eqNullSafe(F.col("s_g")) & (F.col("is_overall") == F.col("s_all"))

    def in_slice(sl: DataFrame) -> DataFrame:
        s = sl.withColumnsRenamed({"g": "s_g", "is_overall": "s_all"})
        return src.join(s, same & F.col("v").between(F.col("lo"), F.col("hi"))).drop("s_g", "s_all")

    keys = ["is_overall", "g", "pick", "at"]
    for _ in range(2):
        width = (F.col("hi") - F.col("lo")) / BUCKETS
        b = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
        counted = (in_slice(slices).withColumn("b", b).groupBy(*keys, "b")
                   .agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        run = F.sum("c").over(Window.partitionBy(*keys).orderBy("b"))
        slices = (counted.withColumn("run", run)
                  .where((F.col("at") < F.col("run")) & (F.col("at") >= F.col("run") - F.col("c")))
                  .withColumn("at", F.col("at") - (F.col("run") - F.col("c"))).drop("run", "c", "b"))
    exact = in_slice(slices).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    hit = (exact.withColumn("run", run)
           .where((F.col("at") < F.col("run")) & (F.col("at") >= F.col("run") - F.col("c"))))
    picked = hit.groupBy("is_overall", "g").agg(*[F.max(F.when(F.col("pick") == k, F.col("v"))).alias(k) for k in picks])
    t = totals.withColumnsRenamed({"g": "s_g", "is_overall": "s_all"})
    out = picked.join(t, same).drop("s_g", "s_all").withColumnsRenamed({"lo": "min", "hi": "max"})
    return out.withColumnRenamed("g", by) if by else out.drop("g")
