"""The ways taken only by long paths, hot cells and busy clients give the same answers as the plain ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strideframe import fixtures as fx
from strideframe.catalog.paths import located, strip_spurs
from strideframe.operators import activity, cells, graph, paths, standing
from strideframe.operators.paths import Paths


def same(a, b, *cols):
    key = [F.round(F.col(c), 6).alias(c) if dict(a.dtypes)[c] == "double" else F.col(c) for c in cols]
    left, right = a.select(*key), b.select(*key)
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture
def tiny_chunks(monkeypatch):
    monkeypatch.setattr(paths, "CHUNK", 4)


def test_long_paths_match_short_ones(spark, sf, tiny_chunks):
    plain = located(spark, sf)
    short, long = plain.over(plain.df), Paths(plain.df, long=True)
    short.long = False
    same(paths.running_km(short).df, paths.running_km(long).df, "course_id", "seq", "km")
    a = short.over(short.df.withColumn("elev", F.coalesce("elev", F.lit(20.0))))
    b = long.over(long.df.withColumn("elev", F.coalesce("elev", F.lit(20.0))))
    same(paths.smoothed(a, "elev", "s").df, paths.smoothed(b, "elev", "s").df, "course_id", "seq", "s")
    same(short.ring_shifted(p=("lat", -1), n=("lat", 1)).df, long.ring_shifted(p=("lat", -1), n=("lat", 1)).df, "course_id", "seq", "p", "n")
    same(paths.marks_along(short, 0.35, 0.45), paths.marks_along(long, 0.35, 0.45), "course_id", "mark", "mark_lat", "mark_lon")
    same(paths.elevation_profile(short), paths.elevation_profile(long), "course_id", "seq", "elev")


def test_spurs_in_pieces(spark, sf):
    want = fx.course_path(spark, sf)
    walked = strip_spurs(spark, sf)
    same(want, walked, "course_id", "seq", "node_id")
    out = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 3, 4, 3, 2, 5, 6, 5, 7])], "course_id long, seq long, node_id long")
    got = [r.node_id for r in paths.strip_spurs(Paths(out), chunk=3).orderBy("seq").collect()]
    assert got == [1, 2, 5, 7]


def test_hot_cells_descend_to_the_same_neighbours(spark, monkeypatch):
    rnd = random.Random(7)
    pts = [(i, 37.5 + rnd.gauss(0, 0.0008), 127.0 + rnd.gauss(0, 0.0008), float(i)) for i in range(400)]
    pts += [(1000 + i, 37.5003, 127.0003, 0.0) for i in range(60)]  # one crowded coordinate
    points = spark.createDataFrame(pts, "point_id long, lat double, lon double, val double")
    queries = spark.createDataFrame([(37.5 + rnd.gauss(0, 0.001), 127.0 + rnd.gauss(0, 0.001)) for _ in range(60)], "lat double, lon double")
    links = cells.square_links(queries, 0.002, 1)
    plain = cells.nearest_points(queries, points, size=0.002, links=links, k=5)
    monkeypatch.setattr(cells, "HOT_WINDOW", 10)
    hot = cells.nearest_points(queries, points, size=0.002, links=links, k=5)
    same(plain, hot, "q_lat", "q_lon", "rank", "point_id", "d")

    def hav(a, b, c, d):
        s = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(s))

    for q in queries.collect()[:10]:
        want = [p[0] for p in sorted(pts, key=lambda p: (hav(q.lat, q.lon, p[1], p[2]), p[0]))[:5]]
        got = [r.point_id for r in hot.where((F.col("q_lat") == q.lat) & (F.col("q_lon") == q.lon)).orderBy("rank").collect()]
        assert got == want


def test_order_statistics(spark):
    rnd = random.Random(5)
    data = [(rnd.choice("abc"), rnd.choice([1.0, 1.0, rnd.expovariate(0.01)])) for _ in range(2000)]
    out = standing.value_at(spark.createDataFrame(data, "g string, v double"), "v", {"p50": (1, 2), "p99": (99, 100)}, by="g").collect()
    for r in out:
        vals = sorted(v for g, v in data if r.is_overall or g == r.g)
        assert (r.p50, r.p99, r.n) == (vals[len(vals) // 2], vals[len(vals) * 99 // 100], len(vals))


def test_rank_without_a_global_window(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"), "id")
    ranked = standing.with_rank(df, [F.col("v"), F.col("id")]).orderBy("rank0").collect()
    assert [r.rank0 for r in ranked] == list(range(1000))
    assert [(r.v, r.id) for r in ranked] == sorted((r.v, r.id) for r in ranked)


def test_components_on_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)]
    nodes = spark.createDataFrame([(i,) for i in {x for e in edges for x in e} | {999}], "node_id long")
    labels = {r.node_id: r.label for r in graph.components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {labels[i] for i in range(100, 161)} == {100} and {labels[i] for i in range(7, 40)} == {7} and labels[999] == 999
