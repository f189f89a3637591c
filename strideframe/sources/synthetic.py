"""Deterministic synthetic network, hashed from node numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.geo import half_even, unit_hash

# Fixed values of the demonstration grid.
CENTER = (37.5665, 126.9780)
STEP_M = 80.0
SIDE = 60
FACILITY_TYPES = ("convenience_store", "restroom", "water", "park")


def _hash(*parts: str) -> Column:
    cols = [F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts]
    return unit_hash(F.concat_ws("|", *cols))


def grid_nodes(spark: SparkSession, side: int = SIDE) -> DataFrame:
    import math

    dlat = STEP_M / 110_540.0
    dlon = STEP_M / (111_320.0 * math.cos(math.radians(CENTER[0])))
    cells = spark.range(side * side).select((F.col("id") / side).cast("long").alias("i"), (F.col("id") % side).alias("j"))
    return cells.select("i", "j", (CENTER[0] + (F.col("i") - side // 2) * dlat).alias("lat"),
                        (CENTER[1] + (F.col("j") - side // 2) * dlon).alias("lon"))


def grid_edges(spark: SparkSession, side: int = SIDE) -> DataFrame:
    """Edges to the right and upper neighbour with hashed attributes."""
    steps = F.explode(F.array(F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj")), F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj"))))
    base = (spark.range(side * side).select(F.floor(F.col("id") / side).alias("i"), (F.col("id") % side).alias("j"), steps.alias("s"))
            .select("i", "j", (F.col("i") + F.col("s.di")).alias("ni"), (F.col("j") + F.col("s.dj")).alias("nj"))
            .where((F.col("ni") < side) & (F.col("nj") < side)))
    mid_i, mid_j = (F.col("i") + F.col("ni")) / 2, (F.col("j") + F.col("nj")) / 2
    river, hill = mid_i.between(8, 14), (mid_i > 42) & (mid_j > 42)
    s = _hash("i", "j", "=s")
    edge = ("i", "j", "ni", "nj")
    return base.select(
        *edge, F.lit(STEP_M).alias("length_m"),
        half_even(F.when(hill, 5.0 + 4.0 * s).otherwise(s), 2).alias("slope_pct"),
        F.when(river, 1.0).otherwise(0.4 + 0.6 * _hash(*edge, "=w")).alias("sidewalk_score"),
        F.when(river, 0.9).otherwise(0.3 + 0.7 * _hash(*edge, "=l")).alias("lighting_score"),
        (0.3 + 0.7 * _hash(*edge, "=c")).alias("cctv_score"),
        F.when(river, 1.0).when(_hash("i", "j", "=p") > 0.85, 0.6).otherwise(0.0).alias("park_score"),
        F.when(river, 1.0).otherwise(0.5 + 0.5 * _hash(*edge, "=x")).alias("crossing_score"))


def facility_pick(nodes: DataFrame) -> DataFrame:
    """About 1.5 % of the nodes become a facility, its type taken from the hash."""
    hashed = nodes.withColumn("h", unit_hash(F.concat(F.lit("poi|"), F.col("node_id").cast("string")))).where(F.col("h") >= 0.985)
    types = F.array(*[F.lit(t) for t in FACILITY_TYPES])
    pick = F.pmod(F.floor(F.col("h") * 1_000_000), F.lit(len(FACILITY_TYPES))) + 1
    return hashed.withColumn("type", F.element_at(types, pick.cast("int"))).drop("h")
