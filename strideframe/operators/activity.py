"""Activity tables: passports, relays, facility merges and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import standing

# Fixed values.
PASSPORT_RUNS = 40
RELAY_LEGS = 8
ALL_SHAPES = 4
CLUSTER_CELLS = {9: 0.075, 8: 0.05, 7: 0.03, 6: 0.016}
TARGET_AVG_MS, TARGET_P99_MS = 100.0, 3_000.0


def latest_runs(completions: DataFrame, keep: int = PASSPORT_RUNS) -> DataFrame:
    """The last `keep` distinct courses of every user; repeating a course moves it to the end.

    completions: user_id, ts, completion_id, course_key, shape, place.
    """
    last = completions.groupBy("user_id", "course_key").agg(F.max(F.struct("ts", "completion_id", "shape", "place")).alias("e")).select(
        "user_id", "course_key", "e.*")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("completion_id"))
    return last.withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep)


def passport_summary(completions: DataFrame) -> DataFrame:
    """(user_id, runs, shapes, complete, masters): badges over the kept runs."""
    runs = latest_runs(completions)
    per_place = runs.groupBy("user_id", "place").agg(F.count_distinct("shape").alias("found"), F.count("*").alias("runs"),
                                                     F.collect_set("shape").alias("shapes"))
    return per_place.groupBy("user_id").agg(
        F.sum("runs").alias("runs"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shapes")))), ",").alias("shapes"),
        F.count_if((F.col("found") == ALL_SHAPES) & (F.col("place") != "")).alias("masters")).withColumn(
            "complete", F.size(F.split("shapes", ",")) == ALL_SHAPES)


def relay_legs(events: DataFrame, keep: int = RELAY_LEGS) -> tuple[DataFrame, DataFrame]:
    """(legs, rejected): the first leg of a relay fixes its shape; other shapes are rejected; the last legs stay."""
    first = events.groupBy("user_id").agg(F.min(F.struct("ts", "completion_id", "shape")).alias("f")).select("user_id", F.col("f.shape").alias("relay_shape"))
    judged = events.join(first, "user_id")
    legs = latest_runs(judged.where(F.col("shape") == F.col("relay_shape")), keep)
    return legs, judged.where(F.col("shape") != F.col("relay_shape"))


def merge_facilities(*groups: DataFrame) -> DataFrame:
    """Union of facility groups; per (type, lat, lon at 5 dp) the first group's first row stays.

    Each group: facility_id, type, name, lat, lon. Rows without coordinates go.
    """
    tagged = None
    for i, g in enumerate(groups):
        g = g.select("facility_id", "type", "name", "lat", "lon").withColumn("grp", F.lit(i))
        tagged = g if tagged is None else tagged.unionByName(g)
    good = tagged.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    best = F.min(F.struct("grp", "facility_id", "name", "lat", "lon")).alias("f")
    return (good.groupBy("type", geo.half_even(F.col("lat"), 5).alias("k_lat"), geo.half_even(F.col("lon"), 5).alias("k_lon")).agg(best)
            .select("type", "f.facility_id", "f.name", "f.lat", "f.lon", F.col("f.grp").alias("source")))


def latency_report(log: DataFrame) -> DataFrame:
    """n, avg, p50, p99 and max per tool and over all tools, with the service targets. log: tool, latency_ms."""
    stats = standing.value_at(log, "latency_ms", {"p50_ms": (1, 2), "p99_ms": (99, 100)}, by="tool")
    return stats.select(
        F.when(F.col("is_overall"), "overall").otherwise(F.col("tool")).alias("name"), "n", F.col("avg").alias("avg_ms"),
        "p50_ms", "p99_ms", F.col("max").alias("max_ms"),
        F.when(F.col("avg") <= TARGET_AVG_MS, "PASS").otherwise("FAIL").alias("avg_target"),
        F.when(F.col("p99_ms") <= TARGET_P99_MS, "PASS").otherwise("FAIL").alias("p99_target"))


def map_clusters(places: DataFrame) -> DataFrame:
    """(level, ci, cj, lat, lon, places, courses): map buckets per zoom level with their centroid.

    places: lat, lon, courses. The members of a bucket are the rows with its key.
    """
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(v).alias("size")) for k, v in CLUSTER_CELLS.items()]))
    spread = places.select("lat", "lon", "courses", levels.alias("z"))
    return (spread.groupBy(F.col("z.level").alias("level"), F.floor(F.col("lat") / F.col("z.size") + 0.5).alias("ci"),
                           F.floor(F.col("lon") / F.col("z.size") + 0.5).alias("cj"))
            .agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("places"), F.sum("courses").alias("courses")))
