"""Measures of a routed line against a silhouette, in plane metres.

Routed lines are Paths with x, y (closed: last row repeats the first). Anchors
are rows (key, a_seq, x, y) of at most MAX_ANCHORS points per key, so a key's
anchors may travel as one small array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators.paths import Paths, with_totals

# Fixed values.
MIN_ANCHORS, MAX_ANCHORS = 8, 32
SHARP_DEG = 100.0
SIMILARITY_FRACTION = 0.085
ORDERED_FRACTION = 0.38
FEATURE_FRACTION = 0.080
SAMPLES = 64
CROSS_CELL_M = 130.0
OCCUPANCY_CELL_M = 130.0

CHUNK_ROWS = 1024


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return geo.hypot(bx - ax, by - ay)


def with_next(ring: Paths) -> Paths:
    """Ring rows plus the next vertex (x2, y2) and the side length."""
    nxt = ring.ring_shifted(x2=("x", 1), y2=("y", 1))
    return nxt.over(nxt.df.withColumn("side", dist(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))))


def ring_turns(ring: Paths) -> Paths:
    """Ring rows plus neighbours, adjacent side lengths, the turn angle (0 where a side is empty) and prominence."""
    near = ring.ring_shifted(x0=("x", -1), y0=("y", -1), x2=("x", 1), y2=("y", 1))
    v = (F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    angle = geo.turn_angle(*v)
    m1, m2 = geo.hypot(v[0], v[1]), geo.hypot(v[2], v[3])
    cosine = geo.clamp((v[0] * v[2] + v[1] * v[3]) / (m1 * m2), -1.0, 1.0)
    return near.over(near.df.withColumns({
        "turn": F.coalesce(angle, F.lit(0.0)), "side": m2,
        "prominence": F.when(angle.isNotNull(), (1.0 - cosine) * F.least(m1, m2))}))


def outline_stats(ring: Paths) -> DataFrame:
    """(key, outline_fraction, sharp_turns): sharp corners take half of each adjoining side."""
    t = ring_turns(ring)
    sharp = F.when(geo.half_even(F.col("turn")) > SHARP_DEG, 1).otherwise(0)
    two = t.over(t.df.withColumn("sharp", sharp)).ring_shifted(sharp2=("sharp", 1)).df
    total = F.sum("side")
    lost = F.sum(F.col("side") * 0.5 * (F.col("sharp") + F.col("sharp2")))
    return two.groupBy(ring.key).agg(
        F.when(F.count("*") < 3, 1.0).when(total > 0, 1.0 - lost / total).otherwise(1.0).alias("outline_fraction"),
        F.sum("sharp").alias("sharp_turns"))


def zigzag(line: Paths, lengths: DataFrame) -> DataFrame:
    """(key, zigzag): alternating bends within 180 m beyond the fourth, and shallow bends, per km."""
    key = line.key
    legs = line.shifted(x0=("x", -1), y0=("y", -1), x2=("x", 1), y2=("y", 1))
    inx, iny = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    outx, outy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    cum = legs.running_sum(F.coalesce(geo.hypot(inx, iny), F.lit(0.0)), "cum")
    ok = (geo.hypot(inx, iny) >= 8) & (geo.hypot(outx, outy) >= 8)
    bent = cum.over(cum.df.withColumn("bend", F.when(ok, geo.half_even(geo.signed_turn(inx, iny, outx, outy)))))
    is_event = F.when(F.abs("bend") >= 30, 1.0).otherwise(0.0)
    ranked = bent.running_sum(is_event, "_e")
    shallow = ranked.df.groupBy(key).agg(F.count_if((F.abs("bend") >= 25) & (F.abs("bend") < 65)).alias("shallow"))
    events = Paths(ranked.df.where(F.abs("bend") >= 30).withColumn("_pos", (F.col("_e") - 1).cast("long")), key, "_pos", line.long)
    pairs = events.shifted(bend2=("bend", 1), cum2=("cum", 1)).df
    alternate = pairs.groupBy(key).agg(F.count_if(
        (F.col("bend") * F.col("bend2") < 0) & (geo.half_even(F.col("cum2") - F.col("cum")) <= 180)).alias("alternating"))
    km = F.greatest(F.col("length_m") / 1000.0, F.lit(0.1))
    over = F.greatest(F.lit(0), F.col("alternating") - 4)
    return (lengths.join(shallow, key).join(alternate, key, "left").fillna(0, ["alternating"])
            .select(key, (1.4 * over / km + 0.25 * F.col("shallow") / km).alias("zigzag")))


def aspect(line: Paths, low: Column, high: Column) -> DataFrame:
    """(key, aspect): how far width/height leaves [low, high], relative, at most 1. low, high: columns of the line."""
    box = line.df.groupBy(line.key).agg(
        (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.first(low).alias("lo"), F.first(high).alias("hi"))
    a = F.col("w") / F.col("h")
    off = (F.when((F.col("w") <= 1e-6) | (F.col("h") <= 1e-6), 1.0)
           .when(a < F.col("lo"), F.least(F.lit(1.0), (F.col("lo") - a) / F.col("lo")))
           .when(a > F.col("hi"), F.least(F.lit(1.0), (a - F.col("hi")) / F.col("hi"))).otherwise(0.0))
    return box.select(line.key, off.alias("aspect"))


def resample(ring: Paths, n: Column, *keep: str) -> DataFrame:
    """(key, *keep, i, x, y, arc): n points at equal arc steps from the first vertex. n: a column of the ring rows, as those to keep."""
    key = ring.key
    sides = with_next(ring)
    run = sides.running_sum(F.col("side"), "end")
    rows = with_totals(run, perimeter=F.sum("side")).withColumn("n", n.cast("long"))
    start = F.col("end") - F.col("side")
    step = F.col("perimeter") / F.col("n")
    lo = F.when(F.col(ring.seq) == 0, F.lit(0)).otherwise(F.floor(geo.half_even(start / step, 9)) + 1).cast("long")
    hi = F.least(F.floor(geo.half_even(F.col("end") / step, 9)), F.col("n") - 1).cast("long")
    spread = rows.where((F.col("side") > 0) & (hi >= lo)).withColumn("i", F.explode(F.sequence(lo, hi)))
    t = (F.col("i") * step - start) / F.col("side")
    return spread.select(key, *keep, "i", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"),
                         (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"), (F.col("i") * step).alias("arc"))


def open_ring(line: Paths) -> Paths:
    """A closed line without its repeated last row."""
    sized = line.with_size("_n")
    return line.over(sized.df.where(F.col(line.seq) < F.col("_n") - 1).drop("_n"))


def pose(line: Paths) -> DataFrame:
    """(key, pose): distance of the long axis from the readable angles, over 35 degrees, at most 1."""
    key = line.key
    sized = line.with_size("_len")
    n = F.least(F.lit(48), F.greatest(F.lit(12), F.floor(F.col("_len") / 3)))
    ring = line.over(sized.df.where(F.col(line.seq) < F.col("_len") - 1))
    pts = resample(ring, n)
    cov = pts.groupBy(key).agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    angle = F.pmod(0.5 * F.degrees(F.atan2(2.0 * geo.half_even(F.col("xy"), 3), geo.half_even(F.col("xx") - F.col("yy"), 3))), F.lit(180.0))
    targets = F.array(*[F.lit(float(t)) for t in (0, 30, 45, 135, 150, 180)])  # fixed values
    err = F.array_min(F.transform(targets, lambda t: F.abs(angle - t)))
    return cov.select(key, F.least(F.lit(1.0), err / 35.0).alias("pose"))


def _left(p: np.ndarray, q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """geo.left_of over rows of (x, y)."""
    return (s[..., 1] - p[..., 1]) * (q[..., 0] - p[..., 0]) > (q[..., 1] - p[..., 1]) * (s[..., 0] - p[..., 0])


def crossing_pairs(sides: np.ndarray, block: int = 32) -> int:
    """Pairs of different sides (x, y, x2, y2) that cross; equal sides count each. Only sides whose boxes reach a block's are compared with it."""
    if not len(sides):
        return 0
    sides, many = np.unique(sides, axis=0, return_counts=True)
    a, b = sides[:, :2], sides[:, 2:]
    low, high, met = np.minimum(a, b), np.maximum(a, b), 0
    for lo in range(0, len(sides), block):
        own = np.arange(lo, min(lo + block, len(sides)))
        near = lo + np.flatnonzero(((high[lo:] >= low[own].min(0)) & (low[lo:] <= high[own].max(0))).all(1))
        i, j = (x.ravel() for x in np.meshgrid(own, near, indexing="ij"))
        boxes = (i < j) & ((high[i] >= low[j]) & (high[j] >= low[i])).all(1)
        i, j = i[boxes], j[boxes]
        cross = (_left(a[i], a[j], b[j]) != _left(b[i], a[j], b[j])) & (_left(a[i], b[i], a[j]) != _left(a[i], b[i], b[j]))
        met += int((many[i] * many[j])[cross].sum())
    return met


def _crossed(key: str, kind: str):
    def run(batches):
        for batch in batches:
            met = np.array([crossing_pairs(s) for s in matrices(batch, "lines", "x", "y", "x2", "y2")], np.int64)
            touching, sides = (batch.column(c).to_numpy() for c in ("touching", "sides"))
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "crossings": pa.array(np.where(sides < 4, 0, met - touching), pa.int64())})

    return run, f"{key} {kind}, crossings long"


def self_crossings(line: Paths) -> DataFrame:
    """(key, crossings): pairs of non-adjacent sides of the ring that cross.

    A short line's sides are compared where its rows are, as one array. Those of
    long lines are folded to one row with a multiplicity where they are equal; they
    meet on plane cells, and a pair is judged only in the first cell both touch.
    Adjacent pairs are counted on their own and taken off.
    """
    key = line.key
    sides = with_next(line)
    follow = sides.ring_shifted(nx=("x2", 1), ny=("y2", 1)).df
    p = {k: (F.col(f"x{k}"), F.col(f"y{k}")) for k in ("a", "b", "c", "d")}
    adjacent = follow.groupBy(key).agg(F.count_if(geo.segments_cross(
        (F.col("x"), F.col("y")), (F.col("x2"), F.col("y2")), (F.col("x2"), F.col("y2")), (F.col("nx"), F.col("ny")))).alias("touching"),
        F.count("*").alias("sides"))
    if not line.long:
        # both are made where the line's rows are; where positions are missing, `follow` has fewer rows than `sides`
        whole = sides.df.where(F.col("side") > 0).groupBy(key).agg(F.collect_list(F.struct("x", "y", "x2", "y2")).alias("lines"))
        run, schema = _crossed(key, adjacent.schema[key].dataType.simpleString())
        return adjacent.join(whole.hint("merge"), key, "left").mapInArrow(run, schema)
    folded = sides.df.where(F.col("side") > 0).groupBy(key, "x", "y", "x2", "y2").agg(F.count("*").alias("m"))

    def ranges(axis: str) -> tuple[Column, Column]:
        return (F.floor(F.least(axis, f"{axis}2") / CROSS_CELL_M), F.floor(F.greatest(axis, f"{axis}2") / CROSS_CELL_M))

    (xl, xh), (yl, yh) = ranges("x"), ranges("y")
    placed = (folded.withColumns({"lo_i": xl, "lo_j": yl})
              .withColumn("ci", F.explode(F.sequence(xl, xh))).withColumn("cj", F.explode(F.sequence(yl, yh))))
    one = placed.select(key, "ci", "cj", F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("x2").alias("xb"), F.col("y2").alias("yb"),
                        F.col("m").alias("m1"), F.col("lo_i").alias("i1"), F.col("lo_j").alias("j1"))
    two = placed.select(key, "ci", "cj", F.col("x").alias("xc"), F.col("y").alias("yc"), F.col("x2").alias("xd"), F.col("y2").alias("yd"),
                        F.col("m").alias("m2"), F.col("lo_i").alias("i2"), F.col("lo_j").alias("j2"))
    first_common = (F.col("ci") == F.greatest("i1", "i2")) & (F.col("cj") == F.greatest("j1", "j2"))
    ordered = F.struct("xa", "ya", "xb", "yb") < F.struct("xc", "yc", "xd", "yd")
    boxes = ((F.greatest("xa", "xb") >= F.least("xc", "xd")) & (F.greatest("xc", "xd") >= F.least("xa", "xb"))
             & (F.greatest("ya", "yb") >= F.least("yc", "yd")) & (F.greatest("yc", "yd") >= F.least("ya", "yb")))
    met = (one.join(two, [key, "ci", "cj"]).where(first_common & ordered & boxes & geo.segments_cross(p["a"], p["b"], p["c"], p["d"]))
           .groupBy(key).agg(F.sum(F.col("m1") * F.col("m2")).alias("met")))
    count = F.when(F.col("sides") < 4, 0).otherwise(F.coalesce("met", F.lit(0)) - F.col("touching"))
    return adjacent.join(met, key, "left").select(key, count.cast("long").alias("crossings"))


def anchor_sides(anchors: DataFrame, key: str) -> DataFrame:
    """(key, sides): the closed outline of the key's anchors as one array of at most MAX_ANCHORS sides, with arc starts."""
    ring = anchors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a_seq", "x", "y"))).alias("ring"))
    turned = F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", 1, 1))
    sides = ring.withColumn("sides", F.zip_with("ring", turned, lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), dist(a["x"], a["y"], b["x"], b["y"]).alias("len"))))
    starts = F.transform("sides", lambda s, i: F.struct(
        s["ax"].alias("ax"), s["ay"].alias("ay"), s["bx"].alias("bx"), s["by"].alias("by"), s["len"].alias("len"),
        F.aggregate(F.slice("sides", F.lit(1), i), F.lit(0.0), lambda t, o: t + o["len"]).alias("start")))
    return sides.select(key, starts.alias("sides"))


def nearest_on_ring(px: Column, py: Column, sides: Column) -> Column:
    """Distance from a point to an outline given as an array of sides."""
    return F.array_min(F.transform(sides, lambda s: geo.segment_distance(px, py, s["ax"], s["ay"], s["bx"], s["by"])))


def _arcs(key: str, batches):
    for batch in batches:
        out = []
        for rows, sides in zip(matrices(batch, "rows", "x", "y"), matrices(batch, "sides", "ax", "ay", "bx", "by", "len", "start")):
            px, py = rows[:, :1], rows[:, 1:]
            ax, ay, bx, by, length, start = (sides[None, :, k] for k in range(6))
            dx, dy = bx - ax, by - ay
            len2 = dx * dx + dy * dy
            t = np.where(len2 == 0, 0.0, np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(len2 == 0, 1.0, len2), 0.0, 1.0))
            x, y = px - (ax + t * dx), py - (ay + t * dy)
            away = np.rint(np.sqrt(x * x + y * y) * 1e6) / 1e6  # a tie goes to the first side
            best = away.argmin(1)
            out.append((start + t * length)[np.arange(len(rows)), best])
        yield pa.RecordBatch.from_pydict({key: batch.column(key), "rows": batch.column("rows"), "arcs": pa.array(out, pa.list_(pa.float64()))})


def arc_position(points: DataFrame, anchors: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """points(key, seq, x, y, ...) plus arc: length along the key's outline of the nearest projection.

    The outline travels with a piece of the line, not with each of its points, and
    all distances of a piece are one array operation.
    """
    rest = [c for c in points.columns if c != key]
    pieces = points.groupBy(key, F.expr(f"{seq} DIV {CHUNK_ROWS}").alias("_c")).agg(F.collect_list(F.struct(*rest)).alias("rows"))
    joined = pieces.join(anchor_sides(anchors, key), key).select(key, "rows", "sides")
    kinds = {c: joined.schema[c].dataType.simpleString() for c in (key, "rows")}
    done = joined.mapInArrow(lambda batches: _arcs(key, batches), f"{key} {kinds[key]}, rows {kinds['rows']}, arcs array<double>")
    flat = done.select(key, F.explode(F.arrays_zip("rows", "arcs")).alias("p"))
    return flat.select(key, *[F.col(f"p.rows.{c}").alias(c) for c in rest],
                       F.when(F.col("p.rows.x").isNotNull() & F.col("p.rows.y").isNotNull(), F.col("p.arcs")).alias("arc"))


def _chunks(df: DataFrame, line: Paths, *cols: str) -> DataFrame:
    """(key, _c, rows): the line's rows in pieces of at most CHUNK_ROWS, so that a long line is never one row."""
    return df.groupBy(line.key, F.expr(f"{line.seq} DIV {CHUNK_ROWS}").alias("_c")).agg(F.collect_list(F.struct(*cols)).alias("rows"))


def matrices(batch: pa.RecordBatch, column: str, *fields: str) -> list[np.ndarray]:
    """One matrix (elements, fields) per row of a column of struct arrays."""
    values = batch.column(column)
    flat, ends = values.flatten(), values.offsets.to_numpy()
    table = np.stack([flat.field(f).to_numpy(zero_copy_only=False) for f in fields], axis=1) if len(flat) else np.zeros((0, len(fields)))
    return np.split(table, (ends - ends[0])[1:-1])


def distances(px: np.ndarray, py: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """(points, sides) distances; sides have the columns ax, ay, bx, by."""
    ax, ay, bx, by = (sides[None, :, k] for k in range(4))
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = np.clip(((px[:, None] - ax) * dx + (py[:, None] - ay) * dy) / np.where(len2 == 0, 1.0, len2), 0.0, 1.0)
    t = np.where(len2 == 0, 0.0, t)
    x, y = px[:, None] - (ax + t * dx), py[:, None] - (ay + t * dy)
    return np.sqrt(x * x + y * y)


def _deviations(key: str, kind: str):
    def run(batches):
        for batch in batches:
            out = {key: batch.column(key), "total": [], "n": [], "away": []}
            for rows, ring in zip(matrices(batch, "rows", "x", "y", "x2", "y2"), matrices(batch, "ring", "x", "y")):
                outline = np.hstack([ring, np.roll(ring, -1, axis=0)])
                out["total"].append(float(distances(rows[:, 0], rows[:, 1], outline).min(1).sum()))
                out["n"].append(len(rows))
                legs = rows[~np.isnan(rows[:, 2])]
                out["away"].append(distances(ring[:, 0], ring[:, 1], legs).min(1).tolist() if len(legs) else None)
            yield pa.RecordBatch.from_pydict({key: out[key], "total": pa.array(out["total"], pa.float64()), "n": pa.array(out["n"], pa.int64()),
                                              "away": pa.array(out["away"], pa.list_(pa.float64()))})

    return run, f"{key} {kind}, total double, n long, away array<double>"


def similarity(line: Paths, anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, similarity, feature_coverage, worst_feature). sizes: key, diameter_m.

    A piece of the line and the outline (at most MAX_ANCHORS points) are one row;
    all their distances are one array operation, and pieces are folded per line.
    """
    key = line.key
    legs = line.shifted(x2=("x", 1), y2=("y", 1)).df
    rings = anchors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a_seq", "x", "y"))).alias("ring"))
    run, schema = _deviations(key, anchors.schema[key].dataType.simpleString())
    parts = _chunks(legs, line, "x", "y", "x2", "y2").join(rings, key).select(key, "rows", "ring").mapInArrow(run, schema)
    pieces = F.filter(F.collect_list("away"), lambda a: a.isNotNull())
    away = F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))), F.get(pieces, F.lit(0)), lambda t, a: F.zip_with(t, a, lambda u, v: F.least(u, v)))
    whole = parts.groupBy(key).agg((F.sum("total") / F.sum("n")).alias("dev_r"), away.alias("away")).join(sizes.select(key, "diameter_m"), key)
    total = F.aggregate("away", F.lit(0.0), lambda t, a: t + a)
    near = F.filter("away", lambda a: geo.half_even(a) <= geo.half_even(F.col("diameter_m") * FEATURE_FRACTION))
    dev = (F.col("dev_r") + total / F.size("away")) / 2
    return whole.where("away IS NOT NULL").select(
        key, F.greatest(F.lit(0.0), 1.0 - dev / (SIMILARITY_FRACTION * F.col("diameter_m"))).alias("similarity"),
        (F.size(near) / F.size("away")).alias("feature_coverage"), (F.array_max("away") / F.greatest(F.col("diameter_m"), F.lit(1.0))).alias("worst_feature"))


def _sample_array(samples: DataFrame, key: str, out: str) -> DataFrame:
    """SAMPLES points per key as one array."""
    return samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias(out))


_SHIFTS = (np.arange(SAMPLES)[:, None] + np.arange(SAMPLES)[None, :]) % SAMPLES


def best_turn(r: np.ndarray, t: np.ndarray) -> float:
    """Least mean distance of two rings of SAMPLES points over every cyclic start and both directions."""
    means = []
    for samples in (r, r[::-1]):
        gap = samples[:, None, :] - t[None, :, :]
        apart = np.sqrt(gap[:, :, 0] * gap[:, :, 0] + gap[:, :, 1] * gap[:, :, 1])
        means.append(apart[_SHIFTS, np.arange(SAMPLES)[None, :]].mean(1).min())
    return float(min(means))


def _turned(key: str, kind: str):
    def run(batches):
        for batch in batches:
            best = [best_turn(r, t) for r, t in zip(matrices(batch, "r", "x", "y"), matrices(batch, "t", "x", "y"))]
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "best": pa.array(best, pa.float64())})

    return run, f"{key} {kind}, best double"


def ordered_similarity(line: Paths, anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, ordered): best mean distance of 64 samples over every cyclic start and both directions."""
    key = line.key
    route = _sample_array(resample(open_ring(line), F.lit(SAMPLES)), key, "r")
    ring = Paths(anchors.withColumnRenamed("a_seq", "seq"), key, "seq", False)
    shape = _sample_array(resample(ring, F.lit(SAMPLES)), key, "t")
    run, schema = _turned(key, anchors.schema[key].dataType.simpleString())
    whole = (F.size("r") == SAMPLES) & (F.size("t") == SAMPLES)  # a line without length has no samples
    best = route.join(shape, key).where(whole).mapInArrow(run, schema).join(sizes.select(key, "diameter_m"), key)
    score = F.greatest(F.lit(0.0), 1.0 - F.col("best") / (ORDERED_FRACTION * F.greatest(F.col("diameter_m"), F.lit(1.0))))
    return best.select(key, score.alias("ordered"))


def keep_corners(ring: Paths, budget: Column) -> DataFrame:
    """(key, a_seq, x, y): the ring's corners, filled up with evenly spaced points to the budget (8..32).

    Where a ring has more vertices than the budget the most prominent stay.
    budget: a column of the ring rows.
    """
    key, seq = ring.key, ring.seq
    cap = F.least(F.greatest(budget, F.lit(MIN_ANCHORS)), F.lit(MAX_ANCHORS)).cast("long")
    base = ring.with_size("vertices")
    base = base.over(base.df.withColumn("cap", cap))
    t = ring_turns(base)
    run = t.running_sum(F.col("side"), "end").df.withColumn("arc", F.col("end") - F.col("side"))
    few = F.col("vertices") <= F.col("cap")
    # corners without a prominence come last; the cap per key is at most MAX_ANCHORS
    rank = Window.partitionBy(key).orderBy(few, F.desc(geo.half_even(F.coalesce("prominence", F.lit(-1.0)))), seq)
    crowded = ~few & F.col("prominence").isNotNull()
    corner_cols = [key, "x", "y", "arc"]
    corners = run.withColumn("rank", F.row_number().over(rank)).where(few | (crowded & (F.col("rank") <= F.col("cap")))).select(*corner_cols)
    thin = base.over(base.df.where(few))
    # a thin ring's corners, its cap and its size go along with its points: nothing is read or dealt again
    own = thin.over(with_totals(thin, own=F.collect_list(F.struct("x", "y")), most=F.max("cap"), count=F.max("vertices")))
    fresh = (resample(own, F.col("cap") * 3, "own", "most", "count")
             .where(~F.exists("own", lambda c: dist(c["x"], c["y"], F.col("x"), F.col("y")) <= 1e-6))
             .withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("i")))
             .where(F.col("rank") <= F.col("most") - F.col("count")).select(*corner_cols))
    chosen = corners.unionByName(fresh)
    return chosen.withColumn("a_seq", F.row_number().over(Window.partitionBy(key).orderBy(geo.half_even(F.col("arc")), "x", "y")) - 1).select(
        key, F.col("a_seq").cast("long").alias("a_seq"), "x", "y", "arc")


def placement_coverage(anchors: DataFrame, occupied: DataFrame, key: str, area: str) -> DataFrame:
    """(key, coverage): share of anchors with a road in the 3x3 plane cells around them.

    anchors: key, area, a_seq, x, y. occupied: area, x, y of network nodes in the same plane.
    """
    def at(c):
        return F.floor(c / OCCUPANCY_CELL_M).cast("long")

    near = F.explode(F.expr("flatten(transform(array(-1L, 0L, 1L), a -> transform(array(-1L, 0L, 1L), b -> named_struct('di', a, 'dj', b))))"))
    cells = occupied.select(area, at(F.col("x")).alias("oi"), at(F.col("y")).alias("oj")).distinct()
    seen = (cells.select(area, "oi", "oj", near.alias("o"))
            .select(area, (F.col("oi") + F.col("o.di")).alias("ci"), (F.col("oj") + F.col("o.dj")).alias("cj")).distinct()
            .withColumn("road", F.lit(1.0)))
    keyed = anchors.withColumns({"ci": at(F.col("x")), "cj": at(F.col("y"))})
    return (keyed.join(seen, [area, "ci", "cj"], "left").groupBy(key)
            .agg(F.avg(F.coalesce("road", F.lit(0.0))).alias("coverage")))
