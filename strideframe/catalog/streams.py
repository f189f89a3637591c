"""Queries that run the streaming jobs over the event tables; their twins are batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe import fixtures as fx
from strideframe.catalog import nearby as near
from strideframe.catalog import requests as req
from strideframe.catalog.base import rounded
from strideframe.catalog.paths import located
from strideframe.operators import nearby
from strideframe.session import cut
from strideframe.streaming import jobs


def _stream(spark, sf, name):
    schema = fx.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _completions(spark, sf):
    e = _stream(spark, sf, "events").where("event_type IN ('purchase', 'signup')")
    return e.select(
        F.col("event_id").alias("completion_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 12).alias("course_key"),
        F.get(F.array(*map(F.lit, ("cat", "dog", "rabbit", "whale"))), (F.col("event_id") % 4).cast("int")).alias("shape"),
        F.concat(F.lit("place_"), F.floor((F.col("event_id") % 12) / 4).cast("string")).alias("place"))


def passport_stream(spark, sf):
    out = jobs.drain(spark, jobs.passports(_completions(spark, sf)), "update")
    return jobs.latest_per(out, "user_id").select("user_id", "runs", "shapes", "masters", "complete")


def relay_stream(spark, sf):
    out = jobs.drain(spark, jobs.relays(_completions(spark, sf)), "update")
    return jobs.latest_per(out, "user_id").select("user_id", "shape", "legs", "top_course", "rejected")


def off_route_stream(spark, sf):
    segs = cut(nearby.route_segments(located(spark, sf)))
    p, n = fx.course_path(spark, sf), fx.road_node(spark, sf)
    at = cut(p.join(n, "node_id").select("course_id", "seq", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")))
    e = _stream(spark, sf, "events").withColumns({"course_id": F.col("user_id") * 10, "seq": F.col("event_id") % 9})
    fixes = e.join(at, ["course_id", "seq"]).select(
        F.col("event_id").alias("fix_id"), "course_id", (F.col("n_lat") + ((F.col("event_id") % 41).cast("double") - 20.0) * 0.00006).alias("lat"),
        F.col("n_lon").alias("lon"), F.col("value").alias("accuracy_m"))
    out = jobs.drain(spark, fixes, transform=lambda batch: nearby.off_route(batch, segs))
    return out.select("fix_id", "course_id", "off_m", "is_off", "accuracy_m")


QUERIES = {f.__name__: f for f in (passport_stream, relay_stream, off_route_stream)}
ORACLES = {"passport_stream": req.ORACLES["passport"], "relay_stream": req.ORACLES["relay"], "off_route_stream": near.ORACLES["off_route"]}
