"""Invariants of planned courses."""

import math

from pyspark.sql import functions as F

from strideframe import fixtures as fx
from strideframe.catalog import base as b
from strideframe.catalog import plans as cat_plans
from strideframe.catalog.nearby import facilities
from strideframe.functions import geo
from strideframe.operators import cells, presets
from strideframe.plans import loops, shape_search
from strideframe.session import cut


def test_loops_close_and_keep_their_length(spark, sf):
    requests = cut(cat_plans.loop_requests(spark, sf).where("request_id < 2").unionByName(
        spark.createDataFrame([(99, 37.71, 127.18, 2.0, False, False, None)], "request_id long, lat double, lon double, distance_km double, include_hills boolean, night_mode boolean, need_facilities array<string>")))
    edges = cut(b.scored_edges(spark, sf))
    nodes = fx.road_node(spark, sf).select("node_id", "lat", "lon", "elev")
    courses, walked = loops.plan_loops(requests, nodes, edges, facilities(spark, sf))
    rows = {r.request_id: r for r in courses.collect()}
    assert rows[99].reason == "outside the network"
    pairs = {(min(r.u, r.v), max(r.u, r.v)): r.length_m for r in edges.select("u", "v", "length_m").collect()}
    for rid in (0, 1):
        assert rows[rid].reason is None and rows[rid].error <= loops.REJECT
        path = [r.node_id for r in walked.where(F.col("request_id") == rid).orderBy("seq").collect()]
        assert path[0] == path[-1] and len(path) >= 3
        total = sum(pairs[min(a, c), max(a, c)] for a, c in zip(path, path[1:]))
        assert abs(total - rows[rid].length_m) < 1e-6


def _plane(points):
    """Node rows from metres around one origin."""
    lat0, lon0 = 37.5, 127.0
    k = 111_320.0 * math.cos(math.radians(lat0))
    return [(i, lat0 + y / 110_540.0, lon0 + x / k) for i, (x, y) in points.items()]


def test_small_loops_are_snipped(spark):
    pts = {0: (0, 0), 1: (200, 0), 2: (200, 100), 3: (100, 100), 4: (100, -100), 5: (100, -1500), 6: (1500, -1500)}
    nodes = cut(spark.createDataFrame(_plane(pts), "node_id long, lat double, lon double"))
    steps = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (0, 4)]
    edges = spark.createDataFrame([(u, v, math.dist(pts[u], pts[v]), "residential", "n", 0.5) for u, v in steps],
                                  "u long, v long, length_m double, highway string, name string, sidewalk_score double")
    walked = cut(spark.createDataFrame([(1, i, i) for i in range(7)], "cand_id long, seq long, node_id long"))
    cands = spark.createDataFrame([(1, 37.5, 127.0)], "cand_id long, lat double, lon double").withColumns(cells.area_box(F.lit(3000.0)))
    adj = shape_search.road_adjacency(edges, nodes)
    out = shape_search.snip_small_loops(walked, cut(cands), nodes, adj)
    assert [r.node_id for r in out.orderBy("seq").collect()] == [0, 4, 5, 6]


def test_snapping_follows_a_square(spark):
    """On a regular grid the joint snap of a square finds the four corner nodes."""
    pts = {i * 10 + j: (j * 100.0, i * 100.0) for i in range(10) for j in range(10)}
    nodes = cut(spark.createDataFrame(_plane(pts), "node_id long, lat double, lon double"))
    corners = [(110.0, 95.0), (590.0, 110.0), (605.0, 590.0), (95.0, 610.0)]
    anchors = spark.createDataFrame([(1, 1, k, x, y) for k, (x, y) in enumerate(corners)], "cand_id long, request_id long, a_seq long, x double, y double")
    cands = spark.createDataFrame([(1, 37.5, 127.0, 500.0)], "cand_id long, lat double, lon double, diameter_m double").withColumns(cells.area_box(F.lit(3000.0)))
    got = shape_search.snap_anchors(cut(cands), anchors, nodes).orderBy("i").collect()
    assert [r.node_id for r in got] == [11, 16, 66, 61]
    assert all(r.snap_m < 20 for r in got)


def test_corridor_stays_on_its_line(spark):
    """Two ways join the ends; the corridor takes the one along the line though it is dearer."""
    pts = {0: (0, 0), 1: (100, 0), 2: (200, 0), 3: (100, 150)}
    nodes = cut(spark.createDataFrame(_plane(pts), "node_id long, lat double, lon double"))
    rows = [(0, 1, 300.0), (1, 2, 300.0), (0, 3, 100.0), (3, 2, 100.0)]
    edges = spark.createDataFrame([(u, v, w, "residential", "n", 0.6) for u, v, w in rows], "u long, v long, length_m double, highway string, name string, sidewalk_score double")
    adj = shape_search.road_adjacency(edges, nodes)
    cands = cut(spark.createDataFrame([(1, 37.5, 127.0, 500.0, 0.09)], "cand_id long, lat double, lon double, diameter_m double, corridor double").withColumns(cells.area_box(F.lit(3000.0))))
    legs = spark.createDataFrame([(1, 0, 0, 2, 0.0, 0.0, 200.0, 0.0, 1)], "cand_id long, leg long, source long, target long, ax double, ay double, bx double, by double, n long")
    tight, _ = shape_search.corridor_routes(legs, cands, adj, nodes, 1.0)
    assert [r.node_id for r in tight.orderBy("seq").collect()] == [0, 1, 2]
    free, _ = shape_search.free_routes(legs, cands, adj)
    assert [r.node_id for r in free.orderBy("seq").collect()] == [0, 3, 2]


def test_plane_round_trip(spark):
    row = spark.range(1).select(geo.plane_lat(F.lit(100.0), F.lit(37.5)).alias("lat"), geo.plane_lon(F.lit(50.0), F.lit(37.5), F.lit(127.0)).alias("lon"))
    r = row.select(geo.plane_x(F.col("lon"), F.lit(37.5), F.lit(127.0)).alias("x"), geo.plane_y(F.col("lat"), F.lit(37.5)).alias("y")).first()
    assert abs(r.x - 50) < 1e-6 and abs(r.y - 100) < 1e-6


def test_decisions_follow_the_preset_and_the_request(spark):
    at = (37.45, 126.85)
    table = spark.createDataFrame([(*at, "dog", "spot", True, 9000.0, 0.8, 8.0), (*at, "cat", "spot", False, None, None, None)],
                                  "lat double, lon double, shape string, name string, available boolean, length_m double, similarity double, distance_km double")
    asked = [(1, "dog", 9.0, False, None), (2, "dog", 9.0, True, None), (3, "dog", 6.0, False, None), (4, "dog", 12.0, False, None),
             (5, "dog", 9.0, False, ["restroom"]), (6, "cat", 9.0, False, None), (7, "dog", 8.0, False, None)]
    requests = spark.createDataFrame([(i, *at, s, km, hills, False, need) for i, s, km, hills, need in asked],
                                     "request_id long, lat double, lon double, shape string, distance_km double, include_hills boolean, night_mode boolean, need_facilities array<string>")
    got = {r.request_id: r.decision for r in presets.distance_decision(requests, table).collect()}
    assert got == {1: "serve", 2: "generate", 3: "suggest", 4: "generate", 5: "generate", 6: "generate", 7: "generate"}
    moved = requests.where("request_id < 3").withColumn("lat", F.col("lat") + 0.01)
    assert {r.request_id: r.decision for r in presets.distance_decision(moved, table).collect()} == {1: "relocate", 2: "generate"}


def test_preset_build_keeps_the_distance_tried(spark, monkeypatch):
    def found(requests, nodes, edges):
        """A course for dogs only, a little longer than asked; the clearest is the 7 km one."""
        rows = requests.where("shape = 'dog'").select(
            "request_id", "shape", F.lit(True).alias("usable"), (F.col("distance_km") * 1010.0).alias("length_m"),
            F.when(F.col("distance_km") == 7, 0.95).otherwise(0.8).alias("sim"), F.col("request_id").alias("cand_id"))
        return rows, None

    monkeypatch.setattr(shape_search, "search", found)
    stations = spark.createDataFrame([(37.45, 126.85), (37.46, 126.86)], "lat double, lon double")
    done = spark.createDataFrame([(37.46, 126.86, "dog", True)], "lat double, lon double, shape string, available boolean")
    got = {(r.lat, r.shape): r for r in shape_search.build_presets(stations, done, None, None).collect()}
    assert len(got) == 7 and (37.46, "dog") not in got
    assert [k for k, r in got.items() if r.available] == [(37.45, "dog")]
    dog = got[37.45, "dog"]
    assert dog.distance_km == 7.0 and math.isclose(dog.length_m, 7070.0) and dog.similarity == 0.95


def test_nodes_far_away_are_found(spark):
    nodes = spark.createDataFrame([(1, 37.54, 127.0), (2, 37.50, 127.07), (3, 37.65, 127.0)], "node_id long, lat double, lon double")
    asked = spark.createDataFrame([(37.5, 127.0)], "lat double, lon double")
    assert [r.node_id for r in cells.nodes_within(asked, nodes, max_distance_m=10_000.0).orderBy("rank").collect()] == [1, 2]


def test_matches_of_presets(spark, monkeypatch):
    """Relocation and the nearest preset against plain Python; presets that cannot be the clearest in reach meet nobody."""
    import math
    import random

    rng = random.Random(11)
    shapes = ("cat", "dog")
    table = [(37.4 + rng.random() * 0.9, 126.6 + rng.random() * 0.9, rng.choice(shapes), f"p{i}", rng.random() < 0.8, 4000.0 + i,
              None if i % 97 == 96 else rng.randrange(70, 75) / 100, 4.0) for i in range(400)]
    table += [(*table[0][:4], True, 1.0, 0.74, 1.0), (37.5, 126.9, "dog", None, True, 1.0, 0.74, 1.0)]
    spots = [(37.2 + rng.random() * 1.2, 126.5 + rng.random() * 1.1, rng.choice((*shapes, None))) for _ in range(150)] + [(None, 126.9, "cat"), (45.0, 126.9, "cat")]
    spots += [row[:3] for row in table[:40]]
    t = spark.createDataFrame(table, "lat double, lon double, shape string, name string, available boolean, length_m double, similarity double, distance_km double")
    s = spark.createDataFrame(spots, "lat double, lon double, shape string")

    def metres(a, b):
        dx = math.radians(b[1] - a[1]) * math.cos(math.radians((a[0] + b[0]) / 2))
        return round(math.sqrt(dx * dx + math.radians(b[0] - a[0]) ** 2) * 6_371_000.0, 6)

    def first(spot, reach, order):
        if None in spot:
            return None
        near = [(metres(spot, p), p) for p in table if p[4] and p[2] == spot[2]]
        return min((order(d, p) for d, p in near if d <= reach), default=None)

    kept = {}
    clear = presets._clear_enough
    monkeypatch.setattr(presets, "_clear_enough", lambda *a: kept.setdefault("rows", clear(*a)))
    moved = presets.relocation(s, t)
    want = {x: first(x, 30_000.0, lambda d, p: (float("-inf") if p[6] is None else -p[6], d)) for x in spots if x[0] and x[2]}
    got = {(r.lat, r.lon, r.shape): r.distance_m for r in moved.collect() if r.lat and r.shape}
    assert got == {x: m and m[1] for x, m in want.items()} and sum(m is not None for m in want.values()) > 100
    assert None in got.values()
    cells = kept["rows"].select("shape", "ci", "cj").distinct().count()
    assert kept["rows"].count() < 60 * cells  # some 200 presets a shape
    near = {(r.lat, r.lon, r.shape): r.distance_m for r in presets.nearest(s, t).collect()}
    assert near == {x: m[0] for x in spots if x[0] and x[2] and (m := first(x, 2_000.0, lambda d, p: (d,)))} and len(near) >= 30
