"""Path measures that read and deal a path once, against the forms for long paths or plain ones."""

import random
import re

from pyspark.sql import functions as F

from strideframe.operators import nearby, paths, presets, shape_metrics
from strideframe.operators.paths import Paths
from strideframe.plans import loops
from strideframe.sources import exports


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def lines(spark, n=30, seed=4):
    """Lines on a coarse grid, so that sides touch, repeat and overlap; one of them with a row of no place."""
    rng = random.Random(seed)
    rows = [(c, s, rng.randrange(12) * 40.0, rng.randrange(12) * 40.0) for c in range(n) for s in range(rng.randrange(1, 40))]
    rows += [(n, 0, None, 1.0), *((n, s, s % 3 * 40.0, s % 2 * 40.0) for s in range(1, 7))]
    return spark.createDataFrame(rows, "course_id long, seq long, x double, y double")


def test_crossings_of_short_lines_as_of_long_ones(spark):
    df = lines(spark)
    short, long = (shape_metrics.self_crossings(Paths(df, long=long)) for long in (False, True))
    assert sorted(map(tuple, short.collect()), key=repr) == sorted(map(tuple, long.collect()), key=repr)
    assert "ci#" not in plan(short) and "ci#" in plan(long)


def test_crossings_of_lines_with_gaps(spark):
    """Positions are missing and repeated, so that the sides that follow others are fewer than the sides."""
    rng = random.Random(7)
    rows = [(c, s, rng.random() * 400, rng.random() * 400) for c in range(4) for s in range(20) if not 4 + c < s < 9]
    line = Paths(spark.createDataFrame(rows + rows[3:5], "course_id long, seq long, x double, y double"), long=False)
    sides = shape_metrics.with_next(line)
    follow = sides.ring_shifted(nx=("x2", 1), ny=("y2", 1)).df.collect()

    def left(p, q, s):
        return (s[1] - p[1]) * (q[0] - p[0]) > (q[1] - p[1]) * (s[0] - p[0])

    def cross(a, b, c, d):
        return left(a, c, d) != left(b, c, d) and left(a, b, c) != left(a, b, d)

    want = {}
    for c in range(4):
        own = sorted(((r.x, r.y), (r.x2, r.y2)) for r in sides.df.collect() if r.course_id == c and r.side > 0)
        met = sum(s < t and cross(*s, *t) for i, s in enumerate(own) for t in own[i + 1:])
        want[c] = met - sum(cross((r.x, r.y), (r.x2, r.y2), (r.x2, r.y2), (r.nx, r.ny)) for r in follow if r.course_id == c)
    assert len(follow) < sides.df.count() and dict(shape_metrics.self_crossings(line).collect()) == want


def located(spark):
    rng = random.Random(2)
    rows = [(c, s, rng.randrange(9), 37.5 + rng.random() / 50, 127 + rng.random() / 50, rng.choice([None, *map(float, range(20))]) if c % 2 else float(s % 5))
            for c in range(20) for s in range(rng.randrange(1, 12))]
    return spark.createDataFrame(rows, "course_id long, seq long, node_id long, lat double, lon double, elev double")


def test_facts_of_a_path_travel_with_one_row(spark):
    """Also where the first step is off the street table, and for paths wholly off it."""
    edges = spark.createDataFrame([(a, b, 50.0 + a, float(b % 4) if b % 3 else None) for a in range(9) for b in range(a + 1, 9) if (a + b) % 4],
                                  "u long, v long, length_m double, slope_pct double")
    df = located(spark).unionByName(spark.createDataFrame([(90, 0, 70, 1.0, 1.0, 1.0), (90, 1, 71, 1.0, 1.0, 1.0)], located(spark).schema))
    short, long = (paths.path_metrics(Paths(df, long=long), edges) for long in (False, True))
    near = [sorted((r.course_id, round(r.length_m, 6), round(r.ascent_m, 6)) for r in m.collect()) for m in (short, long)]
    assert near[0] == near[1] and 10 < len(near[0]) <= 20
    assert re.search(r"CASE WHEN _first#\d+ THEN climb", plan(short))


def test_route_documents_are_made_in_place(spark):
    df = located(spark)
    short, long = (exports.route_json(Paths(df, long=long)) for long in (False, True))
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect()))
    assert "Join" not in plan(short) and exchanges(short) < exchanges(long)


def test_end_kilometres_do_not_travel(spark):
    df = located(spark)
    spots = df.limit(40).select((F.col("course_id") * 50 + F.col("seq")).alias("facility_id"), F.lit("water").alias("type"), "lat", "lon")
    short, long = (nearby.facilities_along(Paths(df, long=long), spots, limit=100) for long in (False, True))
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect())) and short.count() >= 40


def test_streets_keep_further_columns(spark):
    nodes = spark.createDataFrame([(i, 37.5 + i / 1000, 127.0) for i in range(3)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, None, 5.0), (2, 1, None, 7.0)], "u long, v long, geometry array<struct<lat:double,lon:double>>, rfs double")
    walk = spark.createDataFrame([(1, s, s) for s in range(3)], "course_id long, seq long, node_id long")
    drawn = paths.street_polyline(Paths(walk, long=False), nodes, edges, "rfs").orderBy("seq", "part").collect()
    assert [(r.seq, r.rfs) for r in drawn] == [(0, 5.0), (0, 5.0), (1, 7.0)]


def test_cells_around_spots_are_not_broadcast(spark):
    spots = spark.createDataFrame([(37.5, 127.0, "cat")], "lat double, lon double, shape string")
    table = spark.createDataFrame([(37.51, 127.0, "cat", "a", True, 5000.0, 0.5, 5.0)],
                                  "lat double, lon double, shape string, name string, available boolean, length_m double, similarity double, distance_km double")
    size = presets.RELOCATE_M / presets.NARROW_M_PER_DEG / presets.FINER
    near = presets._clear_enough(spots, table, presets.RELOCATE_M, size)
    assert "Broadcast" not in plan(near) and near.count() > 0


def test_found_paths_of_loops_are_not_broadcast(spark, monkeypatch):
    nodes = spark.createDataFrame([(i * 10 + j, 37.5 + i * 0.0009, 127.0 + j * 0.0011, 1.0) for i in range(10) for j in range(10)], "node_id long, lat double, lon double, elev double")
    found = spark.createDataFrame([("a", 1, 0, 5)], "search_id string, target long, seq long, node_id long")
    monkeypatch.setattr(loops.graph, "routes", lambda *_: found)
    at = loops.cells.area_box(F.lit(2000.0))
    tried = spark.createDataFrame([(1, 55, 37.5045, 127.0055, 0.0, 100.0, False, False)],
                                  "loop_id long, start_node long, lat double, lon double, bearing double, radius double, night boolean, hills boolean")
    tried = tried.withColumns(at).withColumnsRenamed({"lat": "start_lat", "lon": "start_lon"})
    got = plan(loops.loop_round(tried, nodes, nodes, nodes))
    assert "Broadcast" not in got
