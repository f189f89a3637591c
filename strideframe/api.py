"""Table functions: each answers a whole table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.operators import activity, nearby, paths, presets
from strideframe.operators.paths import Paths
from strideframe.plans import loops, shape_courses
from strideframe.plans import requests as rq
from strideframe.sources import shapes


def plan_courses(requests: DataFrame, network: tuple[DataFrame, DataFrame], facilities: DataFrame, *, gazetteer, stations: DataFrame):
    """(courses, paths, rejected) for requests with a place name or coordinates, a distance or a duration."""
    nodes, edges = network
    where = presets.resolve_locations(requests.select(F.col("request_id").alias("query_id"), "location", "lat", "lon"), gazetteer, stations)
    placed = requests.drop("lat", "lon").join(where.withColumnRenamed("query_id", "request_id"), "request_id")
    unresolved = placed.where("error IS NOT NULL").select("request_id", F.col("error").alias("reason"))
    good, bad = rq.valid_requests(rq.with_defaults(placed.where("error IS NULL")))
    courses, walked = loops.plan_loops(good, nodes, edges, facilities)
    return courses, walked, unresolved.unionByName(bad.select("request_id", F.lit("out of range").alias("reason")))


def survey_shapes(places: DataFrame, preset_table: DataFrame) -> DataFrame:
    """One row per place and shape with the course to offer, one of them featured."""
    return presets.survey(places, preset_table, shapes.SURVEY_SHAPES)


def decide_shape_courses(requests: DataFrame, preset_table: DataFrame) -> DataFrame:
    """Per shape request: serve, suggest, relocate or generate."""
    return presets.distance_decision(requests, preset_table)


def plan_shape_courses(requests: DataFrame, preset_table: DataFrame, network: tuple[DataFrame, DataFrame], facilities: DataFrame, *, gazetteer, stations: DataFrame):
    """(answers, paths, rejected) for requests with a place name or coordinates, and a shape, a distance or a duration, or none of them.

    Answers name one way per request: serve, suggest, relocate, search, survey or refuse.
    """
    where = presets.resolve_locations(requests.select(F.col("request_id").alias("query_id"), "location", "lat", "lon"), gazetteer, stations)
    placed = requests.drop("lat", "lon").join(where.withColumnRenamed("query_id", "request_id"), "request_id")
    rejected = placed.where("error IS NOT NULL").select("request_id", F.col("error").alias("reason"))
    timed = rq.with_defaults(placed.where("error IS NULL")).withColumn("distance_km", F.when(F.col("note") != "default", F.col("distance_km")))
    fits = F.coalesce(F.col("distance_km").between(1.0, 42.195), F.lit(True))
    rejected = rejected.unionByName(timed.where(~fits).select("request_id", F.lit("out of range").alias("reason")))
    answers, walked = shape_courses.plan_shape_courses(timed.where(fits), preset_table, *network, facilities)
    return answers, walked, rejected


def shape_catalog(spark) -> DataFrame:
    return shapes.catalogue(spark)


def facilities_near_courses(course_lines: DataFrame, facilities: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Up to 15 facilities within 10 m of each course. course_lines: course_id, seq, lat, lon."""
    return nearby.facilities_along(Paths(course_lines), facilities, types, limit=15)


def refine_courses(requests: DataFrame, patches: DataFrame) -> DataFrame:
    return rq.refine(requests, patches)


def course_status(course_refs: DataFrame, courses: DataFrame) -> DataFrame:
    """Known courses of the asked ids; unknown ids come back with found = false."""
    return course_refs.join(courses.withColumn("found", F.lit(True)), "course_ref", "left").fillna({"found": False})


def record_completions(completions: DataFrame) -> DataFrame:
    return activity.passport_summary(completions)


def extend_relays(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return activity.relay_legs(events)


def course_lines(walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(course_id, seq, lat, lon) of node paths."""
    return paths.locate(walked, nodes).select("course_id", "seq", "lat", "lon")
