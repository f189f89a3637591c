"""Queries over ordered paths and silhouettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe import fixtures as fx
from strideframe.catalog import base as b
from strideframe.catalog.base import rounded
from strideframe.catalog.sqltext import (D, components, equi, hav, main_road_cost, mlon, r, rfs, seg_dist, seg_frac,
                                         signed_turn, steady, turn)
from strideframe.functions import geo, score
from strideframe.operators import paths as op
from strideframe.operators import shape_metrics as sm
from strideframe.operators.paths import Paths
from strideframe.session import cut
from strideframe.sources import shapes as cat

SHAPE_ORDER = ("cat", "dog", "rabbit", "whale")


def located(spark, sf) -> Paths:
    path = Paths(fx.course_path(spark, sf))  # its longest path is looked up without the nodes
    return path.over(op.locate(path.df, fx.road_node(spark, sf), "elev"))


def plane_line(spark, sf) -> Paths:
    """Course lines in metres around their first point."""
    p = located(spark, sf)
    at = p.over(p.df.select("course_id", "seq", "node_id", "lat", "lon"))
    start = F.when(F.col("seq") == 0, F.struct(F.col("lat").alias("lat0"), F.col("lon").alias("lon0")))
    df = op.with_rows_of(at, start, "start").select("*", "start.*").withColumns({
        "x": geo.plane_x(F.col("lon"), F.col("lat0"), F.col("lon0")), "y": geo.plane_y(F.col("lat"), F.col("lat0"))})
    return p.over(df.select("course_id", "seq", "node_id", "lat", "lon", "x", "y"))


def shape_of(course_id):
    names = F.array(*[F.lit(s) for s in SHAPE_ORDER])
    return F.get(names, (F.floor(course_id / 10) % 4).cast("int"))


def placed_shapes(line: Paths):
    """(anchors, sizes): a silhouette as long as the course, on the centre of its bounding box."""
    spark = line.df.sparkSession
    v = cat.vertices(spark)
    ring = sm.with_next(Paths(v, "shape", "seq", False)).df
    dims = ring.groupBy("shape").agg(
        F.sum("side").alias("perimeter"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    legs = sm.with_next(line).df
    box = legs.groupBy("course_id").agg(
        F.sum("side").alias("length_m"), ((F.min("x") + F.max("x")) / 2).alias("cx"), ((F.min("y") + F.max("y")) / 2).alias("cy"))
    sized = box.withColumn("shape", shape_of(F.col("course_id"))).join(F.broadcast(dims), "shape")  # four rows
    sizes = sized.withColumn("scale", F.col("length_m") / F.col("perimeter")).withColumn("diameter_m", F.col("span") * F.col("scale"))
    pts = sizes.join(F.broadcast(v.withColumnsRenamed({"seq": "a_seq", "x": "vx", "y": "vy"})), "shape")  # a few dozen rows
    anchors = pts.select("course_id", "a_seq", ((F.col("vx") - F.col("mx")) * F.col("scale") + F.col("cx")).alias("x"),
                         ((F.col("vy") - F.col("my")) * F.col("scale") + F.col("cy")).alias("y"))
    return anchors, sizes.select("course_id", "shape", "length_m", "diameter_m")


def traversed(spark, sf):
    return op.with_edges(op.steps(Paths(fx.course_path(spark, sf))).df, b.scored_edges(spark, sf), "length_m", "highway", "name",
                         *[f"{c}_score" for c in score.COMPONENTS if c != "slope"], "slope_pct")


def path_steps(spark, sf):
    return op.steps(Paths(fx.course_path(spark, sf))).df.where("next_id IS NOT NULL").select("course_id", "seq", "node_id", "next_id")


def running_distance(spark, sf):
    return rounded(op.running_km(located(spark, sf)).df, "km").select("course_id", "seq", "km")


def smoothed_elevation(spark, sf):
    p = located(spark, sf)
    filled = p.over(p.df.withColumn("elev", F.coalesce("elev", F.lit(20.0))))
    return rounded(op.smoothed(filled, "elev", "smooth").df, "smooth").select("course_id", "seq", "smooth")


def path_turns(spark, sf):
    return rounded(op.turns(located(spark, sf)).df.where("turn IS NOT NULL"), "turn", digits=4).select("course_id", "seq", "turn")


def ring_turns(spark, sf):
    t = sm.ring_turns(sm.open_ring(plane_line(spark, sf))).df
    signed = geo.signed_turn(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    return t.select("course_id", "seq", geo.half_even(F.col("turn"), 4).alias("turn"), geo.half_even(signed, 4).alias("signed_turn"))


def elevation_profile(spark, sf):
    return op.elevation_profile(located(spark, sf))


def km_markers(spark, sf):
    m = op.marks_along(located(spark, sf), 1.0, 1.0)
    return m.select("course_id", F.col("mark").alias("km"), geo.half_even(F.col("mark_lat")).alias("lat"), geo.half_even(F.col("mark_lon")).alias("lon"))


def direction_markers(spark, sf):
    m = op.marks_along(located(spark, sf), 0.35, 0.45)
    return m.select("course_id", "mark", geo.half_even(F.col("mark_lat")).alias("lat"), geo.half_even(F.col("mark_lon")).alias("lon"),
                    geo.half_even(F.col("angle"), 1).alias("angle"))


def densified_path(spark, sf):
    return rounded(op.densified(located(spark, sf)), "lat", "lon", "km")


def ring_resample(spark, sf):
    ring = sm.open_ring(plane_line(spark, sf))
    return rounded(sm.resample(ring, F.lit(sm.SAMPLES)), "x", "y", digits=4).select("course_id", "i", "x", "y")


def corner_prominence(spark, sf):
    t = sm.ring_turns(sm.open_ring(plane_line(spark, sf))).df.where("prominence IS NOT NULL")
    from pyspark.sql import Window

    p = geo.half_even(F.col("prominence"), 4)
    w = Window.partitionBy("course_id").orderBy(F.desc("prominence"), "seq")
    return t.withColumn("prominence", p).select("course_id", "seq", "prominence", F.row_number().over(w).alias("rank"))


def arc_positions(spark, sf):
    line = plane_line(spark, sf)
    anchors, _ = placed_shapes(line)
    return rounded(sm.arc_position(line.df.select("course_id", "seq", "x", "y"), anchors, "course_id"), "arc", digits=3).select("course_id", "seq", "arc")


def corner_anchors(spark, sf):
    ring = sm.open_ring(plane_line(spark, sf))
    ring = ring.over(ring.df.withColumn("budget", 8 + F.col("course_id") % 25))
    return rounded(sm.keep_corners(ring, F.col("budget")), "x", "y", digits=3).select("course_id", "a_seq", "x", "y")


def _geometry(spark, sf):
    """Edges with a bent three-point geometry on every third edge, half of them stored backwards."""
    e = b.ed.with_endpoints(b.edges(spark, sf), fx.road_node(spark, sf))
    key = F.col("u") + F.col("v")
    bend = F.array(F.struct(F.col("u_lat").alias("lat"), F.col("u_lon").alias("lon")),
                   F.struct((F.col("mid_lat") + 0.0001).alias("lat"), F.col("mid_lon").alias("lon")),
                   F.struct(F.col("v_lat").alias("lat"), F.col("v_lon").alias("lon")))
    return e.withColumn("geometry", F.when(key % 3 == 0, F.when(key % 2 == 1, F.reverse(bend)).otherwise(bend)))


def street_polyline(spark, sf):
    line = op.street_polyline(Paths(fx.course_path(spark, sf)), fx.road_node(spark, sf), _geometry(spark, sf))
    return rounded(line, "lat", "lon").select("course_id", "seq", "part", "lat", "lon")


def heat_segments(spark, sf):
    """Sub-segments of the drawn street with the score of their edge."""
    nodes = fx.road_node(spark, sf)
    geom = _geometry(spark, sf).select("u", "v", "geometry")
    scored = b.scored_edges(spark, sf).select("u", "v", geo.half_even(score.edge_rfs(), 2).alias("rfs"))
    # the scores of a street go along its geometry, so that the path meets the streets once
    ends = {"a": F.least("u", "v"), "b": F.greatest("u", "v")}
    scores = scored.groupBy(*[v.alias(c) for c, v in ends.items()]).agg(F.collect_list(F.struct("rfs")).alias("scores"))
    geom = geom.withColumns(ends).join(scores.hint("shuffle_hash"), ["a", "b"], "left")
    line = op.street_polyline(Paths(fx.course_path(spark, sf)), nodes, geom, "scores")
    # within an edge the parts are consecutive; an edge after the first starts at the previous edge's last vertex
    from pyspark.sql import Window

    w = Window.partitionBy("course_id").orderBy("seq", "part")
    pairs = line.withColumns({"a_lat": F.lag("lat").over(w), "a_lon": F.lag("lon").over(w)}).where("a_lat IS NOT NULL")
    pairs = pairs.where(F.col("course_id").isNotNull() & F.col("seq").isNotNull()).withColumn("s", F.explode("scores"))
    return rounded(pairs, "a_lat", "a_lon", "lat", "lon").select("course_id", "seq", "part", "a_lat", "a_lon", "lat", "lon", "s.rfs")


def strip_spurs(spark, sf):
    """Paths with spurs of one and two edges put in, then stripped again."""
    p = Paths(fx.course_path(spark, sf)).shifted(n1=("node_id", 1), n2=("node_id", 2))
    here = F.array("node_id")
    one = F.array("node_id", "n1", "node_id")
    two = F.array("node_id", "n1", "n2", "n1", "node_id")
    walk = F.when((F.col("seq") % 7 == 3) & F.col("n2").isNotNull(), two).when((F.col("seq") % 5 == 2) & F.col("n1").isNotNull(), one).otherwise(here)
    rows = p.df.withColumn("walk", walk)
    sized = p.over(rows.withColumn("size", F.size("walk").cast("double"))).running_sum(F.col("size"), "upto").df
    spurred = sized.select("course_id", F.posexplode("walk").alias("k", "node"), (F.col("upto") - F.col("size")).alias("base")).select(
        "course_id", (F.col("base") + F.col("k")).cast("long").alias("seq"), F.col("node").alias("node_id"))
    return op.strip_spurs(Paths(spurred)).select("course_id", F.col("seq").cast("long").alias("seq"), "node_id")


def rfs_summary(spark, sf):
    out = op.rfs_summary(traversed(spark, sf), False, False)
    means = [f"mean_{c}" for c in score.COMPONENTS]
    return (rounded(rounded(out, "park_ratio"), *means, digits=4)
            .withColumn("score", F.rint(100 * geo.half_even(F.col("score01"))).cast("int"))
            .withColumn("highlights", F.array_join("highlights", ","))
            .select("course_id", "score", "park_ratio", "highlights", *means))


def path_metrics(spark, sf):
    return rounded(op.path_metrics(located(spark, sf), b.scored_edges(spark, sf)), "length_m", "ascent_m")


def backtrack_fraction(spark, sf):
    """Each course run one and a half times, so that edges repeat."""
    p = fx.course_path(spark, sf)
    t = op.with_edges(op.steps(Paths(p)).df, b.edges(spark, sf), "length_m")
    again = t.where("seq % 2 = 0")
    return rounded(op.backtrack(t.unionByName(again)), "backtrack")


def alley_share(spark, sf):
    t = traversed(spark, sf)
    cost = F.greatest(F.lit(0.0), score.main_road_cost() - 1.0) * F.col("length_m")
    return t.groupBy("course_id").agg(geo.half_even(geo.steady_sum(cost) / F.greatest(geo.steady_sum(F.col("length_m")), F.lit(1.0))).alias("alley"))


def followability(spark, sf):
    lengths = traversed(spark, sf).groupBy("course_id").agg(F.sum("length_m").alias("length_m"))
    return rounded(op.followability(located(spark, sf), lengths), "penalty").select("course_id", "turns", "sharp", "uturns", "penalty")


def outline_stats(spark, sf):
    return rounded(sm.outline_stats(sm.open_ring(_starred(spark, sf))), "outline_fraction").select("course_id", "outline_fraction", "sharp_turns")


def _starred(spark, sf) -> Paths:
    """Course lines with every third inner point pulled in, so that corners are sharp and sides cross."""
    line = plane_line(spark, sf)
    box = op.with_totals(line.with_size("n"), x_lo=F.min("x"), x_hi=F.max("x"), y_lo=F.min("y"), y_hi=F.max("y"))
    sized = box.withColumns({c: (F.col(f"{k}_lo") + F.col(f"{k}_hi")) / 2 for c, k in (("cx", "x"), ("cy", "y"))}).drop("x_lo", "x_hi", "y_lo", "y_hi")
    pull = (F.col("seq") % 3 == 1) & (F.col("seq") < F.col("n") - 1) & (F.col("seq") > 0)

    def moved(c, m):
        return F.when(pull, F.col(m) * 1.7 - F.col(c) * 0.7).otherwise(F.col(c))

    return line.over(sized.withColumns({"x": moved("x", "cx"), "y": moved("y", "cy")}).drop("cx", "cy", "n"))


def zigzag_penalty(spark, sf):
    line = _starred(spark, sf)
    lengths = sm.with_next(line).df.groupBy("course_id").agg(F.sum("side").alias("length_m"))
    return rounded(sm.zigzag(line, lengths), "zigzag")


def aspect_penalty(spark, sf):
    line = plane_line(spark, sf)
    shape = shape_of(F.col("course_id"))
    lo = score.lookup(shape, {s: v["aspect_min"] for s, v in cat.STYLES.items()}, 0.75)
    hi = score.lookup(shape, {s: v["aspect_max"] for s, v in cat.STYLES.items()}, 2.5)
    return rounded(sm.aspect(line, lo, hi), "aspect")


def pose_penalty(spark, sf):
    return rounded(sm.pose(plane_line(spark, sf)), "pose", digits=3)


def self_crossings(spark, sf):
    return sm.self_crossings(_starred(spark, sf))


def outline_similarity(spark, sf):
    line = plane_line(spark, sf)
    line = line.over(cut(line.df))
    anchors, sizes = placed_shapes(line)
    s = sm.similarity(line, anchors, sizes)
    return rounded(s, "similarity", "worst_feature", "feature_coverage")


def ordered_similarity(spark, sf):
    line = plane_line(spark, sf)
    line = line.over(cut(line.df))
    anchors, sizes = placed_shapes(line)
    return rounded(sm.ordered_similarity(line, anchors, sizes), "ordered")


def placement_coverage(spark, sf):
    """Silhouettes of all courses against the network, in one plane around the grid's corner."""
    line = plane_line(spark, sf)
    anchors, _ = placed_shapes(line)
    nodes = fx.road_node(spark, sf)
    lat0, lon0 = F.lit(fx.LAT0), F.lit(fx.LON0)
    starts = located(spark, sf).df.where("seq = 0").select("course_id", geo.plane_x(F.col("lon"), lat0, lon0).alias("sx"), geo.plane_y(F.col("lat"), lat0).alias("sy"))
    shifted = anchors.join(starts, "course_id").select("course_id", F.lit(1).alias("area"), "a_seq",
                                                       (F.col("x") + F.col("sx")).alias("x"), (F.col("y") + F.col("sy")).alias("y"))
    occupied = nodes.select(F.lit(1).alias("area"), geo.plane_x(F.col("lon"), lat0, lon0).alias("x"), geo.plane_y(F.col("lat"), lat0).alias("y"))
    return rounded(sm.placement_coverage(shifted, occupied, "course_id", "area"), "coverage")


def course_labels(spark, sf):
    m = rounded(op.path_metrics(located(spark, sf), b.scored_edges(spark, sf)), "length_m", "ascent_m")
    km = F.col("length_m") / 1000.0
    per_km = F.when(km > 0, F.col("ascent_m") / km).otherwise(0.0)
    return m.select("course_id", F.rint(geo.half_even(km * 6.5 * 0.95)).cast("int").alias("min_low"),
                    F.rint(geo.half_even(km * 6.5 * 1.2)).cast("int").alias("min_high"), (F.col("ascent_m") < 8.0 * km).alias("is_flat"),
                    F.when(per_km < 8.0, "flat").when(per_km < 15.0, "gentle").otherwise("climbing").alias("grade"))


def usable_courses(spark, sf):
    """Closed, within 10 % of the target, little backtracking, no crossings."""
    line = _starred(spark, sf)
    ends = line.with_size("n").df.groupBy("course_id").agg(
        F.max(F.when(F.col("seq") == 0, F.col("node_id"))).alias("first"), F.max(F.when(F.col("seq") == F.col("n") - 1, F.col("node_id"))).alias("last"))
    t = op.with_edges(op.steps(Paths(fx.course_path(spark, sf))).df, b.edges(spark, sf), "length_m")
    length = t.groupBy("course_id").agg(F.sum("length_m").alias("length_m"))
    judged = (length.join(ends, "course_id").join(op.backtrack(t), "course_id").join(sm.self_crossings(line), "course_id"))
    target = 1000.0 + 100.0 * (F.col("course_id") % 13)
    usable = ((F.col("first") == F.col("last")) & (geo.half_even(F.abs(F.col("length_m") - target) / target) <= 0.10)
              & (geo.half_even(F.col("backtrack")) <= 0.20) & (F.col("crossings") == 0))
    return judged.select("course_id", usable.alias("usable"))


def viewport(spark, sf):
    """Course lines scaled into a 240 x 160 box (y downwards), thinned to about 300 points."""
    p = located(spark, sf).with_size("n")
    box = p.df.groupBy("course_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    df = p.df.join(box, "course_id").where(F.col("seq") % F.greatest(F.lit(1), F.floor(F.col("n") / 300)) == 0)
    lat_span = F.greatest(F.col("lat_hi") - F.col("lat_lo"), F.lit(1e-6))
    lon_span = F.greatest(F.col("lon_hi") - F.col("lon_lo"), F.lit(1e-6))
    scale = 300.0 / F.greatest(lat_span, lon_span * 0.79)
    return df.select(
        "course_id", "seq", geo.half_even(12 + (F.col("lon") - F.col("lon_lo")) / lon_span * 216, 1).alias("px"),
        geo.half_even(12 + (F.col("lat_hi") - F.col("lat")) / lat_span * 136, 1).alias("py"),
        geo.half_even(545 + (F.col("lon") - (F.col("lon_hi") + F.col("lon_lo")) / 2) * scale * 0.79, 1).alias("card_x"),
        geo.half_even(209 - (F.col("lat") - (F.col("lat_hi") + F.col("lat_lo")) / 2) * scale, 1).alias("card_y"))


def scalar_geometry(spark, sf):
    """Plane and great-circle distances, bearings and pose errors between consecutive path rows."""
    p = located(spark, sf).shifted(lat2=("lat", 1), lon2=("lon", 1)).df.where("lat2 IS NOT NULL")
    a = (F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    x, y = geo.plane_x(F.col("lon2"), F.col("lat"), F.col("lon")), geo.plane_y(F.col("lat2"), F.col("lat"))
    return p.select(
        "course_id", "seq", geo.half_even(geo.haversine(*a)).alias("great_circle"), geo.half_even(geo.equirectangular(*a)).alias("flat"),
        geo.half_even(x).alias("x"), geo.half_even(y).alias("y"), geo.half_even(geo.plane_lat(y, F.col("lat"))).alias("back_lat"),
        geo.half_even(geo.plane_lon(x, F.col("lat"), F.col("lon"))).alias("back_lon"), geo.half_even(geo.screen_bearing(*a), 4).alias("bearing"),
        geo.half_even(geo.pose_error((F.col("course_id") % 360).cast("double"))).alias("pose_error"))


QUERIES = {f.__name__: f for f in (
    path_steps, running_distance, smoothed_elevation, path_turns, ring_turns, elevation_profile, km_markers, direction_markers,
    densified_path, ring_resample, corner_prominence, arc_positions, corner_anchors, street_polyline, heat_segments, strip_spurs,
    rfs_summary, path_metrics, backtrack_fraction, alley_share, followability, outline_stats, zigzag_penalty, aspect_penalty,
    pose_penalty, self_crossings, outline_similarity, ordered_similarity, placement_coverage, course_labels, usable_courses,
    viewport, scalar_geometry)}

_W = "OVER (PARTITION BY course_id ORDER BY seq)"
_RUN = "OVER (PARTITION BY course_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
_LAST = "OVER (PARTITION BY course_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def ring_cte(src: str) -> str:
    return f"""SELECT *, COALESCE(LAG(x) {_W}, LAST_VALUE(x) {_LAST}) AS x0, COALESCE(LAG(y) {_W}, LAST_VALUE(y) {_LAST}) AS y0,
      COALESCE(LEAD(x) {_W}, FIRST_VALUE(x) {_LAST}) AS x2, COALESCE(LEAD(y) {_W}, FIRST_VALUE(y) {_LAST}) AS y2 FROM {src}"""


def _len(a, c):
    return f"sqrt({a} * {a} + {c} * {c})"


def resample_cte(ring: str, n: str, key: str = "course_id", order: str = "seq") -> str:
    run = f"OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT s.{key}, i.i, s.x + ((i.i * step - (ends - side)) / side) * (x2 - s.x) AS x, s.y + ((i.i * step - (ends - side)) / side) * (y2 - s.y) AS y, i.i * step AS arc
      FROM (SELECT *, per / {n} AS step, CASE WHEN {order} = 0 THEN 0 ELSE floor({r('(ends - side) / (per / ' + n + ')', 9)}) + 1 END AS lo, least(floor({r('ends / (per / ' + n + ')', 9)}), {n} - 1) AS hi
            FROM (SELECT *, SUM(side) {run} AS ends, SUM(side) OVER (PARTITION BY {key}) AS per FROM (SELECT *, {_len('(x2 - x)', '(y2 - y)')} AS side FROM {ring}))) s
      JOIN (SELECT range AS i FROM range(128)) i ON i.i BETWEEN s.lo AND s.hi AND s.side > 0"""


_shape_case = "CASE (CAST(floor(course_id / 10) AS BIGINT)) % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'rabbit' ELSE 'whale' END"
_vx = [f"(x - x0)", "(y - y0)", "(x2 - x)", "(y2 - y)"]
_rank_terms = ", ".join(
    f"{{'p': {r(f'm_{c} * {D(score.PROFILES['day'][c])}')}, 'o': {-i}, 'name': '{c}', 'mean': m_{c}}}" for i, c in enumerate(score.COMPONENTS))


def _cross(a, b_, c, d):
    def ccw(p, q, s):
        return f"(({s}y - {p}y) * ({q}x - {p}x) > ({q}y - {p}y) * ({s}x - {p}x))"

    return f"({ccw(a, c, d)} <> {ccw(b_, c, d)} AND {ccw(a, b_, c)} <> {ccw(a, b_, d)})"


def crossings_cte(src: str) -> str:
    sides = f"""(SELECT course_id, seq, x AS px, y AS py, COALESCE(LEAD(x) {_W}, FIRST_VALUE(x) {_LAST}) AS qx, COALESCE(LEAD(y) {_W}, FIRST_VALUE(y) {_LAST}) AS qy,
      COUNT(*) OVER (PARTITION BY course_id) AS n FROM {src})"""
    return f"""SELECT c.course_id, COALESCE(k.c, 0) AS crossings FROM (SELECT DISTINCT course_id FROM {src}) c LEFT JOIN (
      SELECT course_id, COUNT(*) AS c FROM (SELECT s.course_id, s.px AS ax, s.py AS ay, s.qx AS bx, s.qy AS by_, t.px AS cx, t.py AS cy, t.qx AS dx, t.qy AS dy
        FROM {sides} s JOIN {sides} t ON s.course_id = t.course_id AND t.seq > s.seq + 1 AND NOT (s.seq = 0 AND t.seq = t.n - 1) AND t.n >= 4)
      WHERE {_cross('a', 'b', 'c', 'd').replace('by ', 'by_ ').replace('by)', 'by_)')} GROUP BY 1) k ON k.course_id = c.course_id"""


PATH_SQL = {
    "path_at": "SELECT p.course_id, p.seq, p.node_id, n.lat, n.lon, n.elev FROM course_path p JOIN road_node n ON n.node_id = p.node_id",
    "path_step": f"SELECT * FROM (SELECT course_id, seq, node_id, LEAD(node_id) {_W} AS next_id FROM course_path) WHERE next_id IS NOT NULL",
    "path_km": f"""SELECT *, SUM(leg) {_RUN} AS km FROM (SELECT *, COALESCE({hav(f'LAG(lat) {_W}', f'LAG(lon) {_W}', 'lat', 'lon')} / 1000, 0) AS leg FROM path_at)""",
    "course_line": f"""SELECT p.course_id, p.seq, p.node_id, p.lat, p.lon, (p.lon - z.lon) * {mlon('z.lat')} AS x, (p.lat - z.lat) * {D(110540.0)} AS y,
      COUNT(*) OVER (PARTITION BY p.course_id) AS n FROM path_at p JOIN path_at z ON z.course_id = p.course_id AND z.seq = 0""",
    "course_ring": "SELECT * FROM course_line WHERE seq < n - 1",
    "ring_nb": ring_cte("course_ring"),
    "line_nb": ring_cte("course_line"),
    "star_line": """SELECT l.course_id, l.seq, l.node_id, l.n, CASE WHEN l.seq % 3 = 1 AND l.seq < l.n - 1 THEN c.cx * CAST(1.7 AS DOUBLE) - l.x * CAST(0.7 AS DOUBLE) ELSE l.x END AS x,
      CASE WHEN l.seq % 3 = 1 AND l.seq < l.n - 1 THEN c.cy * CAST(1.7 AS DOUBLE) - l.y * CAST(0.7 AS DOUBLE) ELSE l.y END AS y
      FROM course_line l JOIN (SELECT course_id, (MIN(x) + MAX(x)) / 2 AS cx, (MIN(y) + MAX(y)) / 2 AS cy FROM course_line GROUP BY 1) c ON c.course_id = l.course_id""",
    "star_ring": ring_cte("(SELECT * FROM star_line WHERE seq < n - 1)"),
    "edge_run": """SELECT s.course_id, s.seq, s.node_id, s.next_id, e.* FROM path_step s JOIN edge_scored e ON least(e.u, e.v) = least(s.node_id, s.next_id) AND greatest(e.u, e.v) = greatest(s.node_id, s.next_id)""",
    "edge_len": """SELECT s.course_id, s.seq, s.node_id, s.next_id, e.length_m FROM path_step s JOIN edge e ON least(e.u, e.v) = least(s.node_id, s.next_id) AND greatest(e.u, e.v) = greatest(s.node_id, s.next_id)""",
    "shape_vertex": cat.vertices_sql(),
    "shape_dim": f"""SELECT shape, SUM({_len('(x2 - x)', '(y2 - y)')}) AS perimeter, AVG(x) AS mx, AVG(y) AS my, greatest(MAX(x) - MIN(x), MAX(y) - MIN(y)) AS span
      FROM (SELECT *, COALESCE(LEAD(x) OVER (PARTITION BY shape ORDER BY seq), FIRST_VALUE(x) OVER (PARTITION BY shape ORDER BY seq)) AS x2,
        COALESCE(LEAD(y) OVER (PARTITION BY shape ORDER BY seq), FIRST_VALUE(y) OVER (PARTITION BY shape ORDER BY seq)) AS y2 FROM shape_vertex) GROUP BY shape""",
    "course_size": f"""SELECT c.*, c.length_m / d.perimeter AS scale, d.span * (c.length_m / d.perimeter) AS diameter_m, d.mx, d.my FROM (
        SELECT course_id, {_shape_case} AS shape, SUM({_len('(x2 - x)', '(y2 - y)')}) AS length_m, (MIN(x) + MAX(x)) / 2 AS cx, (MIN(y) + MAX(y)) / 2 AS cy FROM line_nb GROUP BY 1, 2) c
      JOIN shape_dim d ON d.shape = c.shape""",
    "anchor": """SELECT c.course_id, v.seq AS a_seq, (v.x - c.mx) * c.scale + c.cx AS x, (v.y - c.my) * c.scale + c.cy AS y FROM course_size c JOIN shape_vertex v ON v.shape = c.shape""",
    "anchor_side": f"""SELECT *, SUM(side) OVER (PARTITION BY course_id ORDER BY a_seq ROWS UNBOUNDED PRECEDING) - side AS starts FROM (
      SELECT *, {_len('(x2 - x)', '(y2 - y)')} AS side FROM (SELECT course_id, a_seq, x, y,
        COALESCE(LEAD(x) OVER (PARTITION BY course_id ORDER BY a_seq), FIRST_VALUE(x) OVER (PARTITION BY course_id ORDER BY a_seq)) AS x2,
        COALESCE(LEAD(y) OVER (PARTITION BY course_id ORDER BY a_seq), FIRST_VALUE(y) OVER (PARTITION BY course_id ORDER BY a_seq)) AS y2 FROM anchor))""",
    "run_metrics": f"""SELECT l.course_id, l.length_m, CASE WHEN u.known = u.n AND u.n >= 3 THEN u.climb ELSE l.by_slope END AS ascent_m FROM
      (SELECT course_id, SUM(length_m) AS length_m, SUM(length_m * greatest({D(0.0)}, COALESCE(slope_pct, 0)) / {D(100.0)} * {D(0.5)}) AS by_slope FROM edge_run GROUP BY 1) l
      JOIN (SELECT course_id, COUNT(*) AS n, COUNT(elev) AS known, SUM(greatest({D(0.0)}, s2 - s)) AS climb FROM (SELECT *, LEAD(s) {_W} AS s2 FROM
        (SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY course_id) < 5 THEN elev ELSE AVG(elev) OVER (PARTITION BY course_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS s FROM path_at)) GROUP BY 1) u
      ON u.course_id = l.course_id""",
    "leg_turn": f"""SELECT *, {turn('ix', 'iy', 'ox', 'oy')} AS turn_deg FROM (
      SELECT course_id, seq, -((LAG(lon) {_W} - lon) * {mlon('lat')}) AS ix, -((LAG(lat) {_W} - lat) * {D(110540.0)}) AS iy,
        (LEAD(lon) {_W} - lon) * {mlon('lat')} AS ox, (LEAD(lat) {_W} - lat) * {D(110540.0)} AS oy FROM path_at)""",
    "drawn": f"""SELECT course_id, seq, ROW_NUMBER() OVER (PARTITION BY course_id, seq ORDER BY k) - 1 AS part, lat, lon FROM (
      SELECT s.course_id, s.seq, 0 AS k, a.lat, a.lon FROM path_step s JOIN edge e ON least(e.u, e.v) = least(s.node_id, s.next_id) AND greatest(e.u, e.v) = greatest(s.node_id, s.next_id) JOIN road_node a ON a.node_id = s.node_id WHERE s.seq = 0
      UNION ALL SELECT s.course_id, s.seq, 1, (a.lat + c.lat) / 2 + {D(0.0001)}, (a.lon + c.lon) / 2 FROM path_step s JOIN edge e ON least(e.u, e.v) = least(s.node_id, s.next_id) AND greatest(e.u, e.v) = greatest(s.node_id, s.next_id)
        JOIN road_node a ON a.node_id = e.u JOIN road_node c ON c.node_id = e.v WHERE (e.u + e.v) % 3 = 0
      UNION ALL SELECT s.course_id, s.seq, 2, a.lat, a.lon FROM path_step s JOIN edge e ON least(e.u, e.v) = least(s.node_id, s.next_id) AND greatest(e.u, e.v) = greatest(s.node_id, s.next_id) JOIN road_node a ON a.node_id = s.next_id)""",
    "samples64": resample_cte("ring_nb", "64"),
    "crossing_count": crossings_cte("star_line"),
}


def sql(body: str, extra: dict | None = None) -> str:
    return b.sql(body, {**PATH_SQL, **(extra or {})})


def _marks(first: float, every: float) -> str:
    return f"""SELECT s.course_id, m.m AS mark, lat + (b_lat - lat) * t AS mlat, lon + (b_lon - lon) * t AS mlon, degrees(atan2(-((b_lat - lat) * {D(111320.0)}), (b_lon - lon) * {D(111320.0)})) AS angle
      FROM (SELECT *, LEAD(lat) {_W} AS b_lat, LEAD(lon) {_W} AS b_lon, LEAD(km) {_W} AS b_km FROM path_km) s
      JOIN (SELECT range + 1 AS m FROM range(200)) m ON {D(first)} + {D(every)} * (m.m - 1) > {r('km', 9)} + 1e-10 AND {D(first)} + {D(every)} * (m.m - 1) <= {r('b_km', 9)} + 1e-10 AND b_km > km,
      LATERAL (SELECT ({D(first)} + {D(every)} * (m.m - 1) - km) / (b_km - km) AS t) q"""


_comp = components(False)
_means = ", ".join(f"{steady(f'{v} * length_m')} / {steady('length_m')} AS m_{c}" for c, v in _comp.items())

ORACLES = {
    "path_steps": sql("SELECT course_id, seq, node_id, next_id FROM path_step"),
    "running_distance": sql(f"SELECT course_id, seq, {r('km')} AS km FROM path_km"),
    "smoothed_elevation": sql(f"""SELECT course_id, seq, {r('s')} AS smooth FROM (SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY course_id) < 5 THEN e ELSE AVG(e) OVER (PARTITION BY course_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS s
      FROM (SELECT *, COALESCE(elev, {D(20.0)}) AS e FROM path_at))"""),
    "path_turns": sql(f"SELECT course_id, seq, {r('turn_deg', 4)} AS turn FROM leg_turn WHERE turn_deg IS NOT NULL"),
    "ring_turns": sql(f"SELECT course_id, seq, {r(f'COALESCE({turn(*_vx)}, 0)', 4)} AS turn, {r(signed_turn(*_vx), 4)} AS signed_turn FROM ring_nb"),
    "elevation_profile": sql(f"""SELECT course_id, seq, {r('km', 3)} AS km, {r('CASE WHEN c < 5 THEN elev ELSE s END', 1)} AS elev FROM (
      SELECT *, COUNT(*) OVER (PARTITION BY course_id) AS c, AVG(elev) OVER (PARTITION BY course_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s
      FROM (SELECT *, COUNT(*) OVER (PARTITION BY course_id) AS n, COUNT(elev) OVER (PARTITION BY course_id) AS known FROM path_km) WHERE elev IS NOT NULL AND known >= greatest(3, n // 2))"""),
    "km_markers": sql(f"SELECT course_id, mark AS km, {r('mlat')} AS lat, {r('mlon')} AS lon FROM ({_marks(1.0, 1.0)})"),
    "direction_markers": sql(f"SELECT course_id, mark, {r('mlat')} AS lat, {r('mlon')} AS lon, {r('angle', 1)} AS angle FROM ({_marks(0.35, 0.45)})"),
    "densified_path": sql(f"""SELECT course_id, seq, CAST(part AS BIGINT) AS part, {r('CASE WHEN part = 0 THEN lat ELSE a_lat + (lat - a_lat) * t END')} AS lat, {r('CASE WHEN part = 0 THEN lon ELSE a_lon + (lon - a_lon) * t END')} AS lon,
        {r('CASE WHEN part = 0 THEN km ELSE a_km + (km - a_km) * t END')} AS km
      FROM (SELECT s.*, p.part, CASE WHEN p.part = 0 THEN {D(1.0)} ELSE CAST(p.part AS DOUBLE) / pieces END AS t FROM (
        SELECT *, CASE WHEN a_lat IS NULL THEN 0 ELSE greatest(1, ceil({r(hav('a_lat', 'a_lon', 'lat', 'lon') + ' / 10', 9)})) END AS pieces FROM (SELECT *, LAG(lat) {_W} AS a_lat, LAG(lon) {_W} AS a_lon, LAG(km) {_W} AS a_km FROM path_km)) s
      JOIN (SELECT range AS part FROM range(200)) p ON (s.pieces = 0 AND p.part = 0) OR (p.part BETWEEN 1 AND s.pieces))"""),
    "ring_resample": sql(f"SELECT course_id, i, {r('x', 4)} AS x, {r('y', 4)} AS y FROM samples64"),
    "corner_prominence": sql(f"""SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY prominence DESC, seq) AS INTEGER) AS rank FROM (
      SELECT course_id, seq, {r(f"(1 - {'least(greatest(((x - x0) * (x2 - x) + (y - y0) * (y2 - y)) / (m1 * m2), -1.0::DOUBLE), 1.0::DOUBLE)'}) * least(m1, m2)", 4)} AS prominence
      FROM (SELECT *, {_len('(x - x0)', '(y - y0)')} AS m1, {_len('(x2 - x)', '(y2 - y)')} AS m2 FROM ring_nb) WHERE m1 >= 1e-9 AND m2 >= 1e-9)"""),
    "arc_positions": sql(f"""SELECT course_id, seq, {r('arc', 3)} AS arc FROM (SELECT l.course_id, l.seq, a.starts + ({seg_frac('l.x', 'l.y', 'a.x', 'a.y', 'a.x2', 'a.y2')}) * a.side AS arc,
      ROW_NUMBER() OVER (PARTITION BY l.course_id, l.seq ORDER BY {r(seg_dist('l.x', 'l.y', 'a.x', 'a.y', 'a.x2', 'a.y2'))}, a.a_seq) AS rn FROM course_line l JOIN anchor_side a ON a.course_id = l.course_id) WHERE rn = 1"""),
    "corner_anchors": sql(f"""WITH rb AS (SELECT *, least(greatest(8 + course_id % 25, 8), 32) AS cap, COUNT(*) OVER (PARTITION BY course_id) AS vertices, {_len('(x2 - x)', '(y2 - y)')} AS side, {_len('(x - x0)', '(y - y0)')} AS m1 FROM ring_nb),
      pr AS (SELECT *, SUM(side) {_RUN} - side AS arc, {r("(1 - least(greatest(((x - x0) * (x2 - x) + (y - y0) * (y2 - y)) / (m1 * side), -1.0::DOUBLE), 1.0::DOUBLE)) * least(m1, side)")} AS prom FROM rb),
      kept AS (SELECT course_id, x, y, arc FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY prom DESC, seq) AS rk FROM pr) WHERE vertices <= cap OR rk <= cap),
      thin AS (SELECT * FROM rb WHERE vertices <= cap),
      fill AS (SELECT f.*, t.cap, t.vertices FROM ({resample_cte('thin', '(cap * 3)')}) f JOIN (SELECT DISTINCT course_id, cap, vertices FROM thin) t ON t.course_id = f.course_id),
      fresh AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY i) AS rk FROM fill f WHERE NOT EXISTS (SELECT 1 FROM thin c WHERE c.course_id = f.course_id AND {_len('(c.x - f.x)', '(c.y - f.y)')} <= 1e-6)),
      allp AS (SELECT course_id, x, y, arc FROM kept UNION ALL SELECT course_id, x, y, arc FROM fresh WHERE rk <= cap - vertices)
      SELECT course_id, ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY {r('arc')}, x, y) - 1 AS a_seq, {r('x', 3)} AS x, {r('y', 3)} AS y FROM allp"""),
    "street_polyline": sql(f"SELECT course_id, seq, CAST(part AS INTEGER) AS part, {r('lat')} AS lat, {r('lon')} AS lon FROM drawn"),
    "heat_segments": sql(f"""SELECT d.course_id, d.seq, CAST(d.part AS INTEGER) AS part, {r('a_lat')} AS a_lat, {r('a_lon')} AS a_lon, {r('d.lat')} AS lat, {r('d.lon')} AS lon, {r(rfs(), 2)} AS rfs
      FROM (SELECT *, LAG(lat) OVER (PARTITION BY course_id ORDER BY seq, part) AS a_lat, LAG(lon) OVER (PARTITION BY course_id ORDER BY seq, part) AS a_lon FROM drawn) d
      JOIN edge_run e ON e.course_id = d.course_id AND e.seq = d.seq WHERE a_lat IS NOT NULL"""),
    "strip_spurs": sql("SELECT course_id, seq, node_id FROM course_path"),
    "rfs_summary": sql(f"""SELECT course_id, CAST(round_even(100 * {r('score01')}, 0) AS INTEGER) AS score, {r('park_ratio')} AS park_ratio,
      array_to_string(CASE WHEN {r('park_ratio')} >= 0.3 THEN list_slice(list_concat(['green'], list_filter(strong, lambda x: x <> 'park')), 1, 3) ELSE strong END, ',') AS highlights,
      {', '.join(f"{r(f'm_{c}', 4)} AS mean_{c}" for c in score.COMPONENTS)}
      FROM (SELECT *, list_transform(list_filter(list_slice(list_reverse_sort([{_rank_terms}]), 1, 3), lambda s: s.mean >= 0.6), lambda s: s.name) AS strong FROM (
        SELECT course_id, {steady(rfs() + ' * length_m')} / {steady('length_m')} AS score01, {_means}, {steady('CASE WHEN park_score >= 0.8 THEN length_m ELSE 0 END')} / {steady('length_m')} AS park_ratio FROM edge_run GROUP BY 1))"""),
    "path_metrics": sql(f"SELECT course_id, {r('length_m')} AS length_m, {r('ascent_m')} AS ascent_m FROM run_metrics"),
    "backtrack_fraction": sql(f"""SELECT course_id, {r('SUM(l * (c - 1)) / SUM(l * c)')} AS backtrack FROM (SELECT course_id, least(node_id, next_id) AS a, greatest(node_id, next_id) AS b_, COUNT(*) AS c, MAX(length_m) AS l
      FROM (SELECT * FROM edge_len UNION ALL SELECT * FROM edge_len WHERE seq % 2 = 0) GROUP BY 1, 2, 3) GROUP BY 1"""),
    "alley_share": sql(f"SELECT course_id, {r(steady(f'greatest({D(0.0)}, {main_road_cost()} - {D(1.0)}) * length_m') + f" / greatest({steady('length_m')}, {D(1.0)})")} AS alley FROM edge_run GROUP BY 1"),
    "followability": sql(f"""SELECT l.course_id, COALESCE(t.turns, 0) AS turns, COALESCE(t.sharp, 0) AS sharp, COALESCE(t.uturns, 0) AS uturns,
      {r(f"({D(0.6)} * COALESCE(t.turns, 0) + {D(1.6)} * COALESCE(t.sharp, 0) + {D(4.0)} * COALESCE(t.uturns, 0)) / greatest(l.length_m / 1000, {D(0.1)})")} AS penalty
      FROM (SELECT course_id, SUM(length_m) AS length_m FROM edge_run GROUP BY 1) l LEFT JOIN (
        SELECT course_id, COUNT(*) FILTER ({r('turn_deg')} >= 35) AS turns, COUNT(*) FILTER ({r('turn_deg')} >= 70) AS sharp, COUNT(*) FILTER ({r('turn_deg')} >= 125) AS uturns
        FROM leg_turn WHERE {_len('ix', 'iy')} >= 8 AND {_len('ox', 'oy')} >= 8 GROUP BY 1) t ON t.course_id = l.course_id"""),
    "outline_stats": sql(f"""SELECT course_id, {r('CASE WHEN COUNT(*) < 3 THEN 1 WHEN SUM(side) > 0 THEN 1 - SUM(side * 0.5::DOUBLE * (s + s2)) / SUM(side) ELSE 1 END')} AS outline_fraction, CAST(SUM(s) AS BIGINT) AS sharp_turns FROM (
      SELECT *, COALESCE(LEAD(s) {_W}, FIRST_VALUE(s) {_LAST}) AS s2 FROM (SELECT *, {_len('(x2 - x)', '(y2 - y)')} AS side, CASE WHEN {r(f'COALESCE({turn(*_vx)}, 0)')} > 100 THEN 1 ELSE 0 END AS s FROM star_ring)) GROUP BY 1"""),
    "zigzag_penalty": sql(f"""WITH sl AS (SELECT *, x - LAG(x) {_W} AS ix, y - LAG(y) {_W} AS iy, LEAD(x) {_W} - x AS ox, LEAD(y) {_W} - y AS oy FROM star_line),
      cm AS (SELECT *, SUM(COALESCE({_len('ix', 'iy')}, 0)) {_RUN} AS cum, CASE WHEN {_len('ix', 'iy')} >= 8 AND {_len('ox', 'oy')} >= 8 THEN {r(signed_turn('ix', 'iy', 'ox', 'oy'))} END AS bend FROM sl),
      ev AS (SELECT *, LEAD(bend) {_W} AS bend2, LEAD(cum) {_W} AS cum2 FROM cm WHERE abs(bend) >= 30),
      al AS (SELECT course_id, COUNT(*) FILTER (bend * bend2 < 0 AND {r('cum2 - cum')} <= 180) AS alt FROM ev GROUP BY 1),
      sh AS (SELECT course_id, COUNT(*) FILTER (abs(bend) >= 25 AND abs(bend) < 65) AS shallow FROM cm GROUP BY 1),
      ln AS (SELECT course_id, SUM({_len('(xn - x)', '(yn - y)')}) AS length_m FROM (SELECT *, COALESCE(LEAD(x) {_W}, FIRST_VALUE(x) {_LAST}) AS xn, COALESCE(LEAD(y) {_W}, FIRST_VALUE(y) {_LAST}) AS yn FROM star_line) GROUP BY 1)
      SELECT ln.course_id, {r(f"{D(1.4)} * greatest(0, COALESCE(alt, 0) - 4) / greatest(length_m / 1000, {D(0.1)}) + {D(0.25)} * shallow / greatest(length_m / 1000, {D(0.1)})")} AS zigzag FROM ln JOIN sh USING (course_id) LEFT JOIN al USING (course_id)"""),
    "aspect_penalty": sql(f"""SELECT course_id, {r(f"CASE WHEN w <= 1e-6 OR h <= 1e-6 THEN 1 WHEN w / h < lo THEN least({D(1.0)}, (lo - w / h) / lo) WHEN w / h > hi THEN least({D(1.0)}, (w / h - hi) / hi) ELSE 0 END")} AS aspect FROM (
      SELECT course_id, MAX(x) - MIN(x) AS w, MAX(y) - MIN(y) AS h, CASE {_shape_case} {' '.join(f"WHEN '{s}' THEN {D(v['aspect_min'])}" for s, v in cat.STYLES.items())} END AS lo,
        CASE {_shape_case} {' '.join(f"WHEN '{s}' THEN {D(v['aspect_max'])}" for s, v in cat.STYLES.items())} END AS hi FROM course_line GROUP BY course_id)"""),
    "pose_penalty": sql(f"""WITH rp AS (SELECT *, CAST(least(48, greatest(12, n // 3)) AS BIGINT) AS m FROM ring_nb), smp AS ({resample_cte('rp', 'm')}),
      cv AS (SELECT course_id, VAR_POP(x) AS xx, VAR_POP(y) AS yy, COVAR_POP(x, y) AS xy FROM smp GROUP BY 1),
      an AS (SELECT course_id, {D(0.5)} * degrees(atan2(2 * {r('xy', 3)}, {r('xx - yy', 3)})) AS a FROM cv), ap AS (SELECT course_id, CASE WHEN a < 0 THEN a + 180 ELSE a END AS a FROM an)
      SELECT course_id, {r(f'least({D(1.0)}, least(abs(a), abs(a - 30), abs(a - 45), abs(a - 135), abs(a - 150), abs(a - 180)) / 35)', 3)} AS pose FROM ap"""),
    "self_crossings": sql("SELECT course_id, crossings FROM crossing_count"),
    "outline_similarity": sql(f"""WITH ar AS (SELECT course_id, AVG(d) AS dev_r FROM (SELECT l.course_id, l.seq, MIN({seg_dist('l.x', 'l.y', 'a.x', 'a.y', 'a.x2', 'a.y2')}) AS d FROM course_line l JOIN anchor_side a ON a.course_id = l.course_id GROUP BY 1, 2) GROUP BY 1),
      ft AS (SELECT a.course_id, a.a_seq, MIN({seg_dist('a.x', 'a.y', 'l.x', 'l.y', 'l.x2', 'l.y2')}) AS d FROM anchor a JOIN line_nb l ON l.course_id = a.course_id GROUP BY 1, 2),
      at_ AS (SELECT ft.course_id, AVG(d) AS dev_t, MAX(d) AS worst, MAX(c.diameter_m) AS dia, AVG(CASE WHEN {r('d')} <= {r(f'c.diameter_m * {D(0.08)}')} THEN {D(1.0)} ELSE {D(0.0)} END) AS cov FROM ft JOIN course_size c ON c.course_id = ft.course_id GROUP BY 1)
      SELECT ar.course_id, {r(f'greatest({D(0.0)}, 1 - ((dev_r + dev_t) / 2) / ({D(0.085)} * dia))')} AS similarity, {r('cov')} AS feature_coverage, {r(f'worst / greatest(dia, {D(1.0)})')} AS worst_feature FROM ar JOIN at_ ON at_.course_id = ar.course_id"""),
    "ordered_similarity": sql(f"""WITH ra AS (SELECT *, LEAD(x) OVER (PARTITION BY course_id ORDER BY a_seq) AS zz FROM anchor), ring_a AS (SELECT course_id, a_seq, x, y, x2, y2 FROM anchor_side),
      ts AS MATERIALIZED ({resample_cte('ring_a', '64', order='a_seq')}), rs AS MATERIALIZED (SELECT course_id, i, x, y FROM samples64),
      dirs AS (SELECT course_id, i, x, y, 0 AS d FROM rs UNION ALL SELECT course_id, 63 - i, x, y, 1 FROM rs),
      dev AS (SELECT t.course_id, r_.d, (r_.i - t.i + 64) % 64 AS shift, AVG({_len('(r_.x - t.x)', '(r_.y - t.y)')}) AS dv FROM ts t JOIN dirs r_ ON r_.course_id = t.course_id GROUP BY 1, 2, 3)
      SELECT dev.course_id, {r(f'greatest({D(0.0)}, 1 - MIN(dv) / ({D(0.38)} * greatest(MAX(c.diameter_m), {D(1.0)})))')} AS ordered FROM dev JOIN course_size c ON c.course_id = dev.course_id GROUP BY 1"""),
    "placement_coverage": sql(f"""WITH occ AS (SELECT DISTINCT CAST(floor((lon - {D(126.85)}) * {mlon(D(37.45))} / 130) AS BIGINT) + a.d AS ci, CAST(floor((lat - {D(37.45)}) * {D(110540.0)} / 130) AS BIGINT) + c.d AS cj
        FROM road_node, (SELECT range - 1 AS d FROM range(3)) a, (SELECT range - 1 AS d FROM range(3)) c),
      st AS (SELECT course_id, (lon - {D(126.85)}) * {mlon(D(37.45))} AS sx, (lat - {D(37.45)}) * {D(110540.0)} AS sy FROM path_at WHERE seq = 0)
      SELECT a.course_id, {r(f'AVG(CASE WHEN o.ci IS NULL THEN {D(0.0)} ELSE {D(1.0)} END)')} AS coverage FROM anchor a JOIN st ON st.course_id = a.course_id
      LEFT JOIN occ o ON o.ci = CAST(floor((a.x + sx) / 130) AS BIGINT) AND o.cj = CAST(floor((a.y + sy) / 130) AS BIGINT) GROUP BY 1"""),
    "course_labels": sql(f"""SELECT course_id, CAST(round_even({r(f'km * {D(6.5)} * {D(0.95)}')}, 0) AS INTEGER) AS min_low, CAST(round_even({r(f'km * {D(6.5)} * {D(1.2)}')}, 0) AS INTEGER) AS min_high, asc_m < 8 * km AS is_flat,
      CASE WHEN CASE WHEN km > 0 THEN asc_m / km ELSE 0 END < 8 THEN 'flat' WHEN CASE WHEN km > 0 THEN asc_m / km ELSE 0 END < 15 THEN 'gentle' ELSE 'climbing' END AS grade
      FROM (SELECT course_id, {r('length_m')} / 1000 AS km, {r('ascent_m')} AS asc_m FROM run_metrics)"""),
    "usable_courses": sql(f"""SELECT l.course_id, (f.first_ = f.last_ AND {r(f'abs(l.length_m - t) / t')} <= 0.10 AND {r('bt')} <= 0.20 AND c.crossings = 0) AS usable FROM
      (SELECT course_id, SUM(length_m) AS length_m, {D(1000.0)} + {D(100.0)} * (course_id % 13) AS t FROM edge_len GROUP BY course_id) l
      JOIN (SELECT course_id, SUM(l * (c - 1)) / SUM(l * c) AS bt FROM (SELECT course_id, least(node_id, next_id) AS a, greatest(node_id, next_id) AS b_, COUNT(*) AS c, MAX(length_m) AS l FROM edge_len GROUP BY 1, 2, 3) GROUP BY 1) k ON k.course_id = l.course_id
      JOIN (SELECT course_id, MAX(CASE WHEN seq = 0 THEN node_id END) AS first_, MAX(CASE WHEN seq = n - 1 THEN node_id END) AS last_ FROM course_line GROUP BY 1) f ON f.course_id = l.course_id
      JOIN crossing_count c ON c.course_id = l.course_id"""),
    "viewport": sql(f"""SELECT course_id, seq, {r('12 + (lon - lo_lon) / ls * 216', 1)} AS px, {r('12 + (hi_lat - lat) / la * 136', 1)} AS py,
      {r(f'545 + (lon - (hi_lon + lo_lon) / 2) * (300 / greatest(la, ls * {D(0.79)})) * {D(0.79)}', 1)} AS card_x, {r(f'209 - (lat - (hi_lat + lo_lat) / 2) * (300 / greatest(la, ls * {D(0.79)}))', 1)} AS card_y
      FROM (SELECT *, greatest(hi_lat - lo_lat, {D(1e-6)}) AS la, greatest(hi_lon - lo_lon, {D(1e-6)}) AS ls FROM (SELECT p.*, MIN(lat) OVER w AS lo_lat, MAX(lat) OVER w AS hi_lat, MIN(lon) OVER w AS lo_lon, MAX(lon) OVER w AS hi_lon, COUNT(*) OVER w AS n
        FROM path_at p WINDOW w AS (PARTITION BY course_id))) WHERE seq % greatest(1, n // 300) = 0"""),
    "scalar_geometry": sql(f"""SELECT course_id, seq, {r(hav('lat', 'lon', 'lat2', 'lon2'))} AS great_circle, {r(equi('lat', 'lon', 'lat2', 'lon2'))} AS flat,
      {r(f'(lon2 - lon) * {mlon("lat")}')} AS x, {r(f'(lat2 - lat) * {D(110540.0)}')} AS y, {r('lat2')} AS back_lat, {r('lon2')} AS back_lon,
      {r(f'degrees(atan2(-((lat2 - lat) * {D(111320.0)}), (lon2 - lon) * {D(111320.0)}))', 4)} AS bearing,
      {r('least((SELECT MIN(abs(((course_id % 360 - p + 540) % 360) - 180)) FROM (VALUES (0), (15), (345), (30), (330), (45), (315)) t(p)), 90) / 90')} AS pose_error
      FROM (SELECT *, LEAD(lat) {_W} AS lat2, LEAD(lon) {_W} AS lon2 FROM path_at) WHERE lat2 IS NOT NULL"""),
}
