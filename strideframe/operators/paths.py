"""Analytics over ordered sequences: one row per (path, position).

A path is usually short, but nothing here relies on it. `Paths` looks once at
the longest path. Short paths use an ordinary window per path. Where a path is
longer than CHUNK rows, windows run per (path, chunk) with copies of the
neighbouring rows at the chunk borders, and running sums add chunk totals, so
no task ever has to hold a whole path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geo

CHUNK = 32_768


class Paths:
    """rows: key, seq (0..n-1 without gaps) and any payload columns."""

    def __init__(self, df: DataFrame, key: str = "course_id", seq: str = "seq", long: bool | None = None):
        self.df, self.key, self.seq, self.order = df, key, seq, (seq,)
        if long is None:
            top = df.agg(F.max(seq)).first()[0]
            long = top is not None and top >= CHUNK
        self.long = long

    def over(self, df: DataFrame) -> "Paths":
        """The same paths with other columns."""
        return Paths(df, self.key, self.seq, self.long)

    def shifted(self, **cols: tuple[str, int]) -> "Paths":
        """Adds out=(column, offset): the column's value `offset` rows later in the path, null beyond its ends."""
        before = max([0, *[-o for _, o in cols.values()]])
        after = max([0, *[o for _, o in cols.values()]])
        return self.windowed(before, after, lambda w: {
            out: (F.lead(c, o) if o >= 0 else F.lag(c, -o)).over(w) for out, (c, o) in cols.items()})

    def windowed(self, before: int, after: int, build) -> "Paths":
        """Adds build(window) columns; they may look `before` rows back and `after` rows ahead."""
        if not self.long:
            w = Window.partitionBy(self.key).orderBy(*self.order)
            return self.over(self.df.withColumns(build(w)))
        pos = F.col(self.seq)
        # a row serves its own chunk and the neighbouring chunks whose windows reach it
        lo, hi = F.floor((pos - after) / CHUNK), F.floor((pos + before) / CHUNK)
        spread = self.df.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
        w = Window.partitionBy(self.key, "_chunk").orderBy(*self.order)
        done = spread.withColumns(build(w)).where(F.col("_chunk") == F.floor(pos / CHUNK))
        return self.over(done.drop("_chunk"))

    def running_sum(self, value: Column, out: str) -> "Paths":
        """Adds the sum of `value` from the start of the path up to and including the row."""
        if not self.long:
            w = Window.partitionBy(self.key).orderBy(self.seq).rowsBetween(Window.unboundedPreceding, 0)
            return self.over(self.df.withColumn(out, F.sum(value).over(w)))
        # two levels of totals: chunks, and blocks of CHUNK chunks
        rows = self.df.withColumns({"_v": value, "_chunk": F.floor(F.col(self.seq) / CHUNK)})
        totals = (rows.groupBy(self.key, "_chunk").agg(F.sum("_v").alias("_total"))
                  .withColumn("_block", F.floor(F.col("_chunk") / CHUNK)))
        blocks = totals.groupBy(self.key, "_block").agg(F.sum("_total").alias("_btotal"))
        back = Window.unboundedPreceding
        blocks = blocks.withColumn("_bskip", F.coalesce(F.sum("_btotal").over(
            Window.partitionBy(self.key).orderBy("_block").rowsBetween(back, -1)), F.lit(0.0)))
        offsets = totals.withColumn("_cskip", F.coalesce(F.sum("_total").over(
            Window.partitionBy(self.key, "_block").orderBy("_chunk").rowsBetween(back, -1)), F.lit(0.0)))
        offsets = (offsets.join(blocks.drop("_btotal"), [self.key, "_block"])
                   .select(self.key, "_chunk", (F.col("_cskip") + F.col("_bskip")).alias("_skip")))
        w = Window.partitionBy(self.key, "_chunk").orderBy(self.seq).rowsBetween(back, 0)
        done = (rows.withColumn(out, F.sum("_v").over(w)).join(offsets, [self.key, "_chunk"])
                .withColumn(out, F.col(out) + F.col("_skip")))
        return self.over(done.drop("_v", "_chunk", "_skip"))

    def with_size(self, out: str = "n") -> "Paths":
        """Adds the number of rows of the path."""
        if not self.long:
            return self.over(self.df.withColumn(out, F.count("*").over(Window.partitionBy(self.key))))
        sizes = self.df.groupBy(self.key).agg(F.count("*").alias(out))
        return self.over(self.df.join(sizes, self.key))

    def ring_shifted(self, **cols: tuple[str, int]) -> "Paths":
        """As shifted, but the row after the last is the first and the other way round (offsets -1, 0, 1)."""
        sized = self.with_size("_n").df
        last = F.col("_n") - 1
        # the end rows also stand in for the positions just outside the ring
        places = F.array_compact(F.array(F.col(self.seq), F.when(F.col(self.seq) == 0, F.col("_n")),
                                         F.when(F.col(self.seq) == last, F.lit(-1).cast("long"))))
        spread = sized.withColumn("_own", F.col(self.seq)).withColumn(self.seq, F.explode(places))
        # positions start at -1 here; shift by one to keep chunk numbers non-negative
        spread = spread.withColumn(self.seq, F.col(self.seq) + 1)
        ring = Paths(spread, self.key, self.seq, self.long)
        ring.order = (self.seq, "_own")  # where rows are missing, an end row may stand in the place of another
        done = ring.shifted(**cols).df
        done = done.where((F.col(self.seq) >= 1) & (F.col(self.seq) <= F.col("_n")))
        return self.over(done.withColumn(self.seq, F.col("_own")).drop("_own", "_n"))


def locate(path: DataFrame, nodes: DataFrame, *cols: str) -> DataFrame:
    """path rows with lat, lon (and further node columns).

    Spark takes rows that were exploded from a short table for as few as that
    table has and would broadcast them, so the way of the join is named: both
    sides are dealt by node, and each task looks up its own share of the nodes.
    """
    return path.join(nodes.select("node_id", "lat", "lon", *cols).hint("shuffle_hash"), "node_id")


def with_rows_of(paths: Paths, value: Column, out: str) -> DataFrame:
    """Rows joined to the values of their path that are not null, without reading the path twice unless it is long."""
    rows = paths.df.where(F.col(paths.key).isNotNull())
    if paths.long:
        found = rows.select(paths.key, value.alias(out)).where(F.col(out).isNotNull())
        return rows.join(found, paths.key)
    whole = Window.partitionBy(paths.key)
    return rows.withColumn(out, F.collect_list(value).over(whole)).withColumn(out, F.explode(out))


def with_totals(paths: Paths, **totals: Column) -> DataFrame:
    """Rows plus aggregates over their path, without reading the path twice unless it is long."""
    rows = paths.df.where(F.col(paths.key).isNotNull())
    if paths.long:
        return rows.join(rows.groupBy(paths.key).agg(*[v.alias(c) for c, v in totals.items()]), paths.key)
    return rows.withColumns({c: v.over(Window.partitionBy(paths.key)) for c, v in totals.items()})


def steps(paths: Paths) -> Paths:
    """Adds the next node of every row; the last row of a path has none."""
    return paths.shifted(next_id=("node_id", 1))


def with_edges(step_rows: DataFrame, edges: DataFrame, *cols: str, how: str = "inner") -> DataFrame:
    """Traversed edges: rows with a next node joined to the undirected edge table (dealt by edge, as in `locate`)."""
    pair = edges.select(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"), *cols).hint("shuffle_hash")
    on = [F.least("node_id", "next_id") == F.col("_a"), F.greatest("node_id", "next_id") == F.col("_b")]
    return step_rows.where(F.col("next_id").isNotNull()).join(pair, on, how).drop("_a", "_b")


def running_km(paths: Paths, out: str = "km") -> Paths:
    """Adds the great-circle distance from the start of the path, in km (rows carry lat, lon)."""
    hop = paths.shifted(_plat=("lat", -1), _plon=("lon", -1))
    leg = F.coalesce(geo.haversine(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon")) / 1000.0, F.lit(0.0))
    done = hop.running_sum(leg, out)
    return done.over(done.df.drop("_plat", "_plon"))


def smoothed(paths: Paths, value: str, out: str) -> Paths:
    """Adds the centred mean of 5 rows, shorter at the ends; series under 5 rows stay as they are."""
    sized = paths.with_size("_len")
    mean = sized.windowed(2, 2, lambda w: {"_mean": F.avg(value).over(w.rowsBetween(-2, 2))})
    return mean.over(mean.df.withColumn(out, F.when(F.col("_len") < 5, F.col(value)).otherwise(F.col("_mean")))
                     .drop("_len", "_mean"))


def turns(paths: Paths) -> Paths:
    """Adds in/out leg vectors in metres around every inner row, and the turn angle."""
    near = paths.shifted(a_lat=("lat", -1), a_lon=("lon", -1), c_lat=("lat", 1), c_lon=("lon", 1))
    lat0, lon0 = F.col("lat"), F.col("lon")
    df = near.df.withColumns({
        "in_x": -geo.plane_x(F.col("a_lon"), lat0, lon0), "in_y": -geo.plane_y(F.col("a_lat"), lat0),
        "out_x": geo.plane_x(F.col("c_lon"), lat0, lon0), "out_y": geo.plane_y(F.col("c_lat"), lat0)})
    angle = geo.turn_angle(F.col("in_x"), F.col("in_y"), F.col("out_x"), F.col("out_y"))
    return near.over(df.withColumn("turn", angle).drop("a_lat", "a_lon", "c_lat", "c_lon"))


def followability(paths: Paths, lengths: DataFrame) -> DataFrame:
    """(course_id, penalty): turns, sharp turns and near U-turns per km. lengths: course_id, length_m."""
    key = paths.key
    t = turns(paths).df
    legs = (geo.hypot(F.col("in_x"), F.col("in_y")) >= 8) & (geo.hypot(F.col("out_x"), F.col("out_y")) >= 8)
    angle = geo.half_even(F.col("turn"))
    counts = t.where(legs).groupBy(key).agg(*[F.count_if(angle >= deg).alias(n) for n, deg in
                                              (("turns", 35), ("sharp", 70), ("uturns", 125))])
    km = F.greatest(F.col("length_m") / 1000.0, F.lit(0.1))
    penalty = (0.6 * F.col("turns") + 1.6 * F.col("sharp") + 4.0 * F.col("uturns")) / km
    return (lengths.join(counts, key, "left").fillna(0, ["turns", "sharp", "uturns"])
            .withColumn("penalty", F.when(F.col("length_m") > 0, penalty).otherwise(0.0)))


def elevation_profile(paths: Paths) -> DataFrame:
    """(course_id, seq, km, elev): smoothed elevation along the path, 1 dp.

    Rows without elevation are left out; a path with fewer known values than
    max(3, n // 2) has no profile.
    """
    key = paths.key
    km = running_km(paths.with_size("_n"))
    known = F.when(F.col("elev").isNotNull(), 1.0).otherwise(0.0)
    ranked = km.running_sum(known, "_rank")
    counts = ranked.df.groupBy(key).agg(F.count("elev").alias("_known"))
    kept = (ranked.df.where(F.col("elev").isNotNull()).join(counts, key)
            .where(F.col("_known") >= F.greatest(F.lit(3), F.floor(F.col("_n") / 2)))
            .withColumn("_pos", (F.col("_rank") - 1).cast("long")))
    smooth = smoothed(Paths(kept, key, "_pos", paths.long), "elev", "smooth").df
    return smooth.select(key, paths.seq, geo.half_even(F.col("km"), 3).alias("km"),
                         geo.half_even(F.col("smooth"), 1).alias("elev"))


def marks_along(paths: Paths, first: float, every: float) -> DataFrame:
    """Points at first, first + every, ... km along each path, interpolated on the segment they fall in."""
    key, seq = paths.key, paths.seq
    km = running_km(paths)
    near = km.shifted(b_lat=("lat", 1), b_lon=("lon", 1), b_km=("km", 1))
    a, b = geo.half_even(F.col("km"), 9), geo.half_even(F.col("b_km"), 9)
    # mark numbers m with a < first + every * (m - 1) <= b
    lo = F.floor(geo.half_even((a - first) / every, 9)) + 2
    hi = F.floor(geo.half_even((b - first) / every, 9)) + 1
    lo = F.greatest(lo, F.lit(1))
    rows = near.df.where(F.col("b_km").isNotNull() & (F.col("b_km") > F.col("km")) & (hi >= lo))
    rows = rows.withColumn("mark", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    t = (first + every * (F.col("mark") - 1) - F.col("km")) / (F.col("b_km") - F.col("km"))
    return rows.select(
        key, "mark", (F.col("lat") + (F.col("b_lat") - F.col("lat")) * t).alias("mark_lat"),
        (F.col("lon") + (F.col("b_lon") - F.col("lon")) * t).alias("mark_lon"),
        geo.screen_bearing(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")).alias("angle"), F.col(seq))


def legs(paths: Paths, step_m: float = 10.0) -> Paths:
    """Rows with the point before them (a_lat, a_lon, a_km), their km, and the number of pieces of at most step_m up to them; 0 at the start."""
    near = running_km(paths).shifted(a_lat=("lat", -1), a_lon=("lon", -1), a_km=("km", -1))
    leg = geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    pieces = F.greatest(F.lit(1), F.ceil(geo.half_even(leg / step_m, 9))).cast("long")
    return near.over(near.df.withColumn("pieces", F.when(F.col("a_lat").isNull(), F.lit(0).cast("long")).otherwise(pieces)))


def sample_at(part: Column) -> dict[str, Column]:
    """lat, lon and km of a part of a leg: part 0 is the path's first point, the others end the leg's pieces."""
    t = F.when(part == 0, F.lit(1.0)).otherwise(part / F.col("pieces"))
    return {c: F.when(part == 0, F.col(c)).otherwise(F.col(f"a_{c}") + (F.col(c) - F.col(f"a_{c}")) * t) for c in ("lat", "lon", "km")}


def densified(paths: Paths, step_m: float = 10.0) -> DataFrame:
    """(course_id, seq, part, lat, lon, km): samples at most step_m apart; part 0 is the path's first point."""
    rows = legs(paths, step_m).df
    rows = rows.withColumn("part", F.explode(F.when(F.col("pieces") == 0, F.array(F.lit(0).cast("long")))
                                             .otherwise(F.sequence(F.lit(1).cast("long"), F.col("pieces")))))
    return rows.select(paths.key, paths.seq, "part", *[v.alias(c) for c, v in sample_at(F.col("part")).items()])


def path_metrics(paths: Paths, edges: DataFrame) -> DataFrame:
    """(course_id, length_m, ascent_m).

    Ascent comes from smoothed node elevations when every row has one and there
    are at least three; otherwise from the edges' slopes, halved.
    """
    key = paths.key
    smooth = smoothed(paths, "elev", "_s").shifted(next_id=("node_id", 1), _s2=("_s", 1))
    facts = {"n": F.count("*"), "known": F.count("elev"), "climb": F.sum(F.greatest(F.lit(0.0), F.col("_s2") - F.col("_s")))}
    grade = F.greatest(F.lit(0.0), F.coalesce("slope_pct", F.lit(0.0)))
    sums = [F.sum("length_m").alias("length_m"), F.sum(F.col("length_m") * grade / 100.0 * 0.5).alias("by_slope")]
    # the path's own facts travel with its rows, so that the path is read and dealt once; of a short path, with its first row
    first = F.lit(True) if smooth.long else F.row_number().over(Window.partitionBy(key).orderBy(paths.seq)) == 1
    rows = with_totals(smooth, **facts).withColumn("_first", first).select(
        key, "node_id", "next_id", *[F.when(F.col("_first"), F.col(c)).alias(c) for c in facts])
    whole = (F.col("known") == F.col("n")) & (F.col("n") >= 3)
    # steps off the street table stay, as the facts may come with one
    found = with_edges(rows, edges.withColumn("_street", F.lit(1)), "length_m", "slope_pct", "_street", how="left")
    return (found.groupBy(key).agg(*sums, *[F.max(c).alias(c) for c in facts], F.max("_street").alias("_street")).where("_street = 1")
            .select(key, "length_m", F.when(whole, F.col("climb")).otherwise(F.col("by_slope")).alias("ascent_m")))


def backtrack(edge_rows: DataFrame, key: str = "course_id") -> DataFrame:
    """(course_id, backtrack): share of the length run on an edge already run. Rows: node_id, next_id, length_m."""
    per_edge = edge_rows.groupBy(key, F.least("node_id", "next_id").alias("a"), F.greatest("node_id", "next_id").alias("b")).agg(
        F.count("*").alias("c"), F.max("length_m").alias("l"))
    total = F.sum(F.col("l") * F.col("c"))
    return per_edge.groupBy(key).agg(F.when(total > 0, F.sum(F.col("l") * (F.col("c") - 1)) / total)
                                     .otherwise(0.0).alias("backtrack"))


def rfs_summary(edge_rows: DataFrame, night, hills, key: str = "course_id") -> DataFrame:
    """Length-weighted score, component means, park share and up to three highlights per path.

    night and hills are booleans or columns constant within a path.
    """
    from strideframe.functions import score

    length = F.col("length_m")
    parts = score.component_values(hills)
    if not isinstance(night, bool):
        edge_rows = edge_rows.withColumn("_night", night)
    total = geo.steady_sum(length)
    agg = edge_rows.groupBy(key).agg(
        total.alias("length_m"), (geo.steady_sum(score.edge_rfs(night, hills) * length) / total).alias("score01"),
        *[(geo.steady_sum(v * length) / total).alias(f"mean_{n}") for n, v in parts.items()],
        (geo.steady_sum(F.when(F.coalesce("park_score", F.lit(0.0)) >= 0.8, length).otherwise(0.0)) / total).alias("park_ratio"),
        *([] if isinstance(night, bool) else [F.max("_night").alias("_night")]))
    is_night = night if isinstance(night, bool) else F.col("_night")
    ranked = F.sort_array(F.array(*[
        F.struct(geo.half_even(F.col(f"mean_{n}") * score.component_weight(n, is_night)).alias("pull"),
                 F.lit(-i).alias("order"), F.lit(n).alias("name"), F.col(f"mean_{n}").alias("mean"))
        for i, n in enumerate(score.COMPONENTS)]), asc=False)
    strong = F.transform(F.filter(F.slice(ranked, 1, 3), lambda s: s.mean >= 0.6), lambda s: s["name"])
    green = geo.half_even(F.col("park_ratio")) >= 0.3
    without_park = F.filter(strong, lambda x: x != "park")
    marks = F.when(green, F.concat(F.array(F.lit("green")), without_park)).otherwise(strong)
    return agg.withColumn("highlights", F.slice(marks, 1, 3)).drop("_night")


def street_polyline(paths: Paths, nodes: DataFrame, edges: DataFrame, *keep: str) -> DataFrame:
    """(course_id, seq, part, lat, lon): the path drawn along edge geometries, shared vertices once.

    edges carry `geometry`, an array of (lat, lon) in either direction, or null. keep: further columns of the edges to keep.
    """
    key, seq = paths.key, paths.seq
    at = locate(paths.df.select(key, seq, "node_id"), nodes)
    step = paths.over(at).shifted(next_id=("node_id", 1), b_lat=("lat", 1), b_lon=("lon", 1)).df
    drawn = with_edges(step, edges, "geometry", *keep)

    def gap(p):
        return F.abs(p.lat - F.col("lat")) + F.abs(p.lon - F.col("lon"))

    g = F.col("geometry")
    oriented = F.when(gap(F.element_at(g, 1)) > gap(F.element_at(g, -1)), F.reverse(g)).otherwise(g)
    inner = F.when(g.isNull() | (F.size(g) < 3), F.slice(F.array(F.struct("lat", "lon")), 1, 0)).otherwise(
        F.slice(oriented, F.lit(2), F.size(g) - 2))
    here, there = F.array(F.struct("lat", "lon")), F.array(F.struct(F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")))
    pts = F.concat(F.when(F.col(seq) == 0, here).otherwise(F.slice(here, 1, 0)), inner, there)
    return drawn.select(key, seq, *keep, F.posexplode(pts).alias("part", "p")).select(key, seq, "part", "p.lat", "p.lon", *keep)


def strip_spurs(paths: Paths, chunk: int = CHUNK) -> DataFrame:
    """(course_id, seq, node_id): every path without immediate there-and-back spurs (a, b, a -> a), removed until none is left.

    Scans over pieces of `chunk` rows and one aggregation; no path is ever one row,
    and the work grows with the number of rows (see operators.spurs).
    """
    from strideframe.operators import spurs

    key, seq = paths.key, paths.seq
    several = paths.long or chunk != CHUNK
    steps = paths.over(paths.df.select(key, seq, "node_id")).shifted(before_id=("node_id", -1)).df
    at = paths.over(spurs.places(steps, key, seq, chunk, several))
    kept = spurs.kept_rows(spurs.heights(at, key, seq), key, seq, chunk, several)
    # positions are the number of kept rows before a row
    if not several:
        return kept.withColumn(seq, F.row_number().over(Window.partitionBy(key).orderBy(seq)) - 1)
    pieces = kept.withColumn("_c", F.expr(f"{seq} DIV {chunk}"))
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy(key, "_c").agg(F.count("*").alias("_n")).select(key, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    own = F.row_number().over(Window.partitionBy(key, "_c").orderBy(seq)) - 1
    return pieces.withColumn("_own", own).join(sizes, [key, "_c"]).select(key, (F.col("_own") + F.col("_skip")).alias(seq), "node_id")
