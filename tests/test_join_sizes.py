"""Joins of rows that come from short tables by explode, and joins that need not lay out every sample."""

import math
import random

from pyspark.sql import functions as F

from strideframe.operators import cells, nearby, paths, shape_metrics, spurs
from strideframe.operators.paths import Paths
from strideframe.plans import shape_search
from strideframe.session import cut


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def walks(spark, courses=40, n=12):
    """Paths of nodes 0..n-1, exploded from one row a course as the sample tables' are."""
    return spark.range(courses).select(F.col("id").alias("course_id"), F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("seq")).withColumn(
        "node_id", (F.col("course_id") + F.col("seq")) % 60)


def nodes(spark):
    return spark.createDataFrame([(i, 37.5 + 0.0007 * i, 127.0 + 0.0009 * (i % 7)) for i in range(60)], "node_id long, lat double, lon double")


def test_exploded_paths_are_not_broadcast(spark):
    walk = walks(spark)
    assert "Broadcast" not in plan(paths.locate(walk, nodes(spark)))
    edges = spark.createDataFrame([(i, (i + 1) % 60, 90.0) for i in range(60)], "u long, v long, length_m double")
    steps = paths.with_edges(paths.steps(Paths(walk, long=False)).df, edges, "length_m")
    assert "Broadcast" not in plan(steps)
    assert steps.count() == 40 * 11
    at = spurs.places(Paths(walk, long=False).shifted(before_id=("node_id", -1)).df, "course_id", "seq", 32768, False)
    up = spurs.heights(Paths(at, long=False), "course_id", "seq")
    assert "Broadcast" not in plan(up)
    assert {r.height - r.seq for r in up.collect()} == {0}


def test_facilities_meet_legs_not_samples(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for c in range(12):
        lat, lon = 37.5 + rng.random() * 0.01, 127.0 + rng.random() * 0.01
        for s in range(6):
            rows.append((c, s, lat, lon))
            far = 0.03 if c % 3 == 0 else 0.0008  # every third course has legs of kilometres
            lat, lon = lat + rng.uniform(-far, far), lon + rng.uniform(-far, far) * (s != 2)
    line = Paths(spark.createDataFrame(rows, "course_id long, seq long, lat double, lon double"), long=False)
    spots = []
    for c, s, lat, lon in rows:
        after = next(((y, x) for d, t, y, x in rows if (d, t) == (c, s + 1)), (lat, lon))
        for t in (0.0, 0.31, 0.77):
            spots.append((len(spots), nearby.FACILITY_TYPES[len(spots) % 4], lat + (after[0] - lat) * t + rng.uniform(-1.5e-4, 1.5e-4), lon + (after[1] - lon) * t))
    facilities = spark.createDataFrame(spots, "facility_id long, type string, lat double, lon double")
    samples = paths.densified(line, nearby.NEAR_COURSE_M).collect()

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(h))

    want = set()
    for c in range(12):
        for i, kind, lat, lon in spots:
            d, s, p, km = min((round(metres(r.lat, r.lon, lat, lon), 6), r.seq, r.part, r.km) for r in samples if r.course_id == c)
            if d <= nearby.NEAR_COURSE_M:
                want.add((c, i, kind, round(d)))

    def whole(*_):
        raise AssertionError("every sample of the line is laid out")

    monkeypatch.setattr(paths, "densified", whole)
    found = nearby.facilities_along(line, facilities, limit=10_000).collect()
    assert {(r.course_id, r.facility_id, r.type, r.dist_m) for r in found} == want and len(found) == len(want) > 40


def test_segments_are_not_repeated_around_their_cells(spark):
    """Fixes kilometres away, close by, of a course without a line and of no course; far more segments than fixes."""
    rng = random.Random(8)
    segs = []
    for c in range(30):
        lat, lon = 37.5 + rng.random() * 0.02, 127.0
        for _ in range(40):
            b = lat + rng.uniform(-4e-4, 4e-4), lon + rng.uniform(-4e-4, 4e-4)
            segs.append((c, lat, lon, *b))
            lat, lon = b
    segments = spark.createDataFrame(segs, "course_id long, a_lat double, a_lon double, b_lat double, b_lon double")
    asked = [(i, c, 37.5 + rng.random() * 0.02, 127.0 + (0.3 if i == 5 else rng.uniform(-0.003, 0.003))) for i, c in enumerate([1, 1, 2, 2, 3, 3, 99, None])]
    fixes = spark.createDataFrame(asked, "fix_id long, course_id long, lat double, lon double")
    plain = fixes.join(segments, "course_id").groupBy("fix_id").agg(F.min(F.round(nearby._off_m(), 4)).alias("off_m"))
    got = nearby.distance_to_route(fixes, segments)
    assert sorted((r.fix_id, round(r.off_m, 4)) for r in got.collect()) == sorted(map(tuple, plain.collect()))
    assert got.count() == 6


def test_path_values_without_a_second_reading(spark):
    rows = [(1, 0, 5.0), (1, 1, 7.0), (2, 1, 1.0), (3, 0, 2.0), (3, 0, 3.0), (None, 0, 4.0)]
    df = spark.createDataFrame(rows, "course_id long, seq long, x double")
    start = F.when(F.col("seq") == 0, F.struct(F.col("x").alias("x0")))
    one, two = (sorted((r.course_id, r.seq, r.x, r.start.x0) for r in paths.with_rows_of(Paths(df, long=long), start, "start").collect()) for long in (False, True))
    assert one == two == [(1, 0, 5.0, 5.0), (1, 1, 7.0, 5.0), (3, 0, 2.0, 2.0), (3, 0, 2.0, 3.0), (3, 0, 3.0, 2.0), (3, 0, 3.0, 3.0)]
    one, two = (sorted(map(tuple, paths.with_totals(Paths(df, long=long), lo=F.min("x")).select("course_id", "seq", "x", "lo").collect())) for long in (False, True))
    assert one == two and len(one) == 5
    assert plan(paths.with_rows_of(Paths(df, long=False), start, "start")).count("Join") == 0


def test_ring_with_missing_rows_has_one_order(spark):
    """The start stands at place n, where a path with gaps may have a row of its own; it comes first."""
    rows = [(1, s, float(s)) for s in (3, 2, 0, 1, 6, 5)]
    got = Paths(spark.createDataFrame(rows, "course_id long, seq long, x double"), long=False).ring_shifted(after=("x", 1)).df.collect()
    assert sorted((r.seq, r.after) for r in got)[:5] == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 5.0), (5, 0.0)]


def elevated(spark):
    """Closed rings of nodes with heights, a row of a ring without edge, and one without height."""
    walk = walks(spark, 6, 9).select("course_id", "seq", F.when(F.col("seq") == 8, F.col("course_id")).otherwise(F.col("node_id")).alias("node_id"))
    at = nodes(spark).withColumn("elev", F.when(F.col("node_id") != 12, F.col("node_id") * 7 % 5 * 1.0))
    return Paths(walk.join(F.broadcast(at), "node_id").repartition(3, "node_id"), long=False)


def exchanges(df, of):
    """How often the plan as it runs deals rows of the path that were placed by `of`."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in row and of in row and "Reused" not in row for row in text.splitlines())


def test_path_metrics_deal_the_path_once(spark):
    line = elevated(spark)
    edges = spark.createDataFrame([(i, (i + 1) % 60, 90.0 + i, float(i % 4) if i % 9 else None) for i in range(60) if i != 9], "u long, v long, length_m double, slope_pct double")
    out = paths.path_metrics(line, edges)
    assert exchanges(out, "hashpartitioning(course_id") == 2  # rows of a path, sums of its edges
    got = {r.course_id: (r.length_m, r.ascent_m) for r in out.collect()}
    height = {i: i * 7 % 5 * 1.0 for i in range(60) if i != 12}
    slope = {i: float(i % 4) if i % 9 else 0.0 for i in range(60) if i != 9}
    for c in range(6):
        ids = [c + s for s in range(8)] + [c]
        legs = [i for i in ids[:-2] if i in slope]
        known = [height.get(i) for i in ids]
        if None in known:
            want = sum((90.0 + i) * slope[i] / 100 * 0.5 for i in legs)
        else:
            smooth = [sum(w) / len(w) for w in (known[max(0, k - 2):k + 3] for k in range(9))]
            want = sum(max(0.0, b - a) for a, b in zip(smooth, smooth[1:]))
        assert abs(got[c][0] - sum(90.0 + i for i in legs)) < 1e-9 and abs(got[c][1] - want) < 1e-9


def test_corners_deal_a_line_once(spark):
    """Thin and crowded rings in one table: as many anchors as their budgets, the sharpest corners of crowded ones."""
    rows = [(c, s, math.cos(2 * math.pi * s / n) * (100 + 30 * (s % 3 == 0)), math.sin(2 * math.pi * s / n) * 100.0) for c, n in ((1, 6), (2, 40), (3, 12)) for s in range(n)]
    ring = Paths(spark.createDataFrame(rows, "course_id long, seq long, x double, y double"), long=False)
    ring = ring.over(ring.df.withColumn("budget", F.lit(12)))
    out = shape_metrics.keep_corners(ring, F.col("budget"))
    assert exchanges(out, "hashpartitioning(course_id") <= 2
    got = [(r.course_id, r.a_seq) for r in out.orderBy("course_id", "a_seq").collect()]
    assert got == [(c, i) for c in (1, 2, 3) for i in range(12)]
    points = {(r.course_id, round(r.x, 6), round(r.y, 6)) for r in out.collect()}
    assert {(c, round(x, 6), round(y, 6)) for c, s, x, y in rows if c != 2} <= points
    assert {p for p in points if p[0] == 2} <= {(c, round(x, 6), round(y, 6)) for c, s, x, y in rows}


def test_areas_and_candidates_are_not_broadcast(spark):
    areas = spark.createDataFrame([(i, 18740 + i, 18760 + i, 63480, 63500) for i in range(5)], "area_id long, i_lo long, i_hi long, j_lo long, j_hi long")
    inside = cells.subgraph_nodes(areas, nodes(spark))
    assert "Broadcast" not in plan(inside)
    got = {(r.area_id, r.node_id) for r in inside.collect()}
    at = [(i, math.floor((37.5 + 0.0007 * i) / cells.NODE_CELL), math.floor((127.0 + 0.0009 * (i % 7)) / cells.NODE_CELL)) for i in range(60)]
    assert got == {(a, i) for a in range(5) for i, ci, cj in at if 18740 + a <= ci <= 18760 + a and 63480 <= cj <= 63500}
    assert inside.count() == len(got) > 0
    asked = spark.createDataFrame([(1, 37.52, 127.002, "cat", 3.0)], "request_id long, lat double, lon double, shape string, distance_km double")
    facts, pts = shape_search.templates(asked)
    cands, anchors = (cut(t) for t in shape_search.place(facts, pts, shape_search.styles()))
    kept = plan(shape_search.screen_placements(cands, anchors, nodes(spark)))
    assert "slot" not in "".join(row for row in kept.splitlines() if "BroadcastExchange" in row)
    assert "ShuffledHashJoin [cand_id" in kept
