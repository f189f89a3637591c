"""Live jobs over several micro-batches with late and unordered rows equal their batch twins."""

import datetime
import random
import time

from pyspark.sql import functions as F

from strideframe.operators import activity
from strideframe.streaming import jobs

SCHEMA = "user_id long, ts timestamp, completion_id long, course_key long, shape string, place string"
SHAPES = ("cat", "dog", "rabbit", "whale")


def completions():
    rng = random.Random(11)
    start = datetime.datetime(2024, 5, 1)
    rows = []
    for i in range(600):
        user, course = rng.randrange(5), rng.randrange(70 if i % 2 else 9)
        rows.append((user, start + datetime.timedelta(seconds=rng.randrange(10**6), microseconds=rng.choice((0, 5, 250_000))), i, course, SHAPES[course % 4], f"place_{course // 4}"))
    # the first leg in time of user 9 comes last, and rows share a time
    rows += [(9, start + datetime.timedelta(days=3), 1001, 4, "cat", "a"), (9, start + datetime.timedelta(days=3), 1000, 5, "dog", "a"), (9, start, 1002, 7, "whale", "b")]
    return rows


def batches(spark, rows, folder, parts):
    """The rows as files, one micro-batch each, in the order given."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size:(k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def answers(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_streams_equal_batches_in_any_order(spark, tmp_path):
    rows = completions()
    whole = spark.createDataFrame(rows, SCHEMA)
    want_passport = answers(activity.passport_summary(whole), "user_id", "runs", "shapes", "masters", "complete")
    legs, rejected = activity.relay_legs(whole)
    lost = {r.user_id: r["count"] for r in rejected.groupBy("user_id").count().collect()}
    want_relay = sorted((r.user_id, r.shape, r.legs, r.top, lost.get(r.user_id, 0)) for r in legs.groupBy("user_id").agg(
        F.first("shape").alias("shape"), F.count("*").alias("legs"), F.max("course_key").alias("top")).collect())
    assert dict((r[0], r[1]) for r in want_relay)[9] == "whale" and max(r[1] for r in want_passport) == activity.PASSPORT_RUNS
    stream = batches(spark, rows, f"{tmp_path}/in", 4)
    out = jobs.drain(spark, jobs.passports(stream), "update")
    assert out.select("batch").distinct().count() >= 4
    assert answers(jobs.latest_per(out, "user_id"), "user_id", "runs", "shapes", "masters", "complete") == want_passport
    relays = jobs.drain(spark, jobs.relays(stream), "update")
    assert answers(jobs.latest_per(relays, "user_id"), "user_id", "shape", "legs", "top_course", "rejected") == want_relay
