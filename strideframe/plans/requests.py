"""Request tables: defaults, patches, probe orders and choices among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geo, score
from strideframe.sources import shapes as cat

# Fixed values.
PACE_MIN_PER_KM = 6.5
DEFAULT_KM = 5.0
SIM_TOLERANCE = 0.015


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fills distance_km from the duration at 6:30/km, else 5 km; `note` says which rule fired."""
    timed = geo.half_even(F.col("duration_min") / PACE_MIN_PER_KM, 1)
    has_time = F.col("duration_min").isNotNull() & (F.col("duration_min") > 0)
    note = F.when(F.col("distance_km").isNotNull(), "given").when(has_time, "from duration").otherwise("default")
    km = F.when(F.col("distance_km").isNotNull(), F.col("distance_km")).when(has_time, timed).otherwise(DEFAULT_KM)
    return requests.withColumns({"note": note, "distance_km": km})


def valid_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by the ranges of the request record."""
    ok = F.coalesce(geo.in_service_box(F.col("lat"), F.col("lon")) & F.col("distance_km").between(1.0, 42.195), F.lit(False))
    return requests.where(ok), requests.where(~ok)


def refine(requests: DataFrame, patches: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests with the patch's non-null fields; shape 'none' clears; an empty patch is an error row."""
    fields = [c for c in patches.columns if c != key]
    renamed = patches.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = requests.join(renamed, key)
    changed = F.coalesce(*[F.when(F.col(f"_{c}").isNotNull(), F.lit(True)) for c in fields], F.lit(False))
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    if "shape" in fields:
        out["shape"] = F.when(F.col("_shape") == "none", None).otherwise(F.coalesce("_shape", "shape"))
    return (joined.withColumn("error", F.when(~changed, "nothing to change")).withColumns(out)
            .select(*requests.columns, "error"))


def probe_order(start_km: Column, shape: Column) -> Column:
    """Distances from start_km to 11 km in 1 km steps, likely clean sizes first."""
    preferred = F.greatest(start_km, score.lookup(shape, cat.PREFERRED_KM, 0.0))
    steps = F.rint(F.lit(cat.MAX_ART_KM) - start_km).cast("int")
    all_km = F.transform(F.sequence(F.lit(0), steps), lambda i: geo.half_even(start_km + i, 1))
    ranked = F.array_sort(F.transform(all_km, lambda d: F.struct(F.abs(d - preferred).alias("gap"), d.alias("km"))))
    return F.when(start_km <= cat.MAX_ART_KM, F.transform(ranked, lambda s: s["km"])).otherwise(F.array().cast("array<double>"))


def tolerant_pick(candidates: Column) -> Column:
    """Fold of candidates (struct with sim and km) in their given order.

    A later one wins when it is clearer by more than 0.015, or within 0.015 and
    shorter. The rule is not transitive, so the order matters.
    """
    def better(best, c):
        gain = geo.half_even(c["sim"] - best["sim"])
        return F.when(best.isNull() | (gain > SIM_TOLERANCE) | ((F.abs(gain) <= SIM_TOLERANCE) & (c["km"] < best["km"])), c).otherwise(best)

    return F.aggregate(F.slice(candidates, F.lit(2), F.greatest(F.size(candidates), F.lit(1))), F.get(candidates, F.lit(0)), better)


def alternatives(requests: DataFrame, candidates: DataFrame, limit: int = 2) -> DataFrame:
    """Other shapes that clear their gate at the same place and are not longer than asked for at the least, first `limit` in catalogue order.

    requests: request_id, lat, lon, shape, distance_km.
    """
    position = score.lookup(F.col("alternative"), {s: float(i) for i, s in enumerate(cat.SHAPES)}, 99.0)
    gate = score.lookup(F.col("shape"), {s: v["gate"] for s, v in cat.STYLES.items()}, 1.0)
    least_km = score.lookup(F.col("alternative"), cat.MIN_KM, 99.0)
    good = candidates.where(F.col("similarity") >= gate).select("lat", "lon", F.col("shape").alias("alternative"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(position))
    return (requests.join(good, ["lat", "lon"]).where((F.col("alternative") != F.col("shape")) & (least_km <= F.col("distance_km")))
            .withColumn("rank", rank).where(F.col("rank") <= limit).select("request_id", "alternative", "rank"))
