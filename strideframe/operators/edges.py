"""The scored street-edge table: collapse, elevation, density, width and green joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geo, score
from strideframe.operators import cells

DENSITY_CELL = 0.001
ELEVATION_CELL = 0.0005
GREEN_REACH_DEG = 0.0004
ELEVATION_LON_SCALE = 111_320.0 * 0.7934  # fixed value: cosine of the network's latitude


def collapse_parallel(edges: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Undirected simple edges: per node pair the shortest row, no self-loops, no empty lengths."""
    rest = [c for c in (tie or ["highway", "lit", "name", "u", "v"]) if c in edges.columns]
    payload = [c for c in edges.columns if c not in rest and c != "length_m"]
    best = F.min(F.struct("length_m", *rest, *payload)).alias("e")
    out = (edges.where((F.col("u") != F.col("v")) & (F.col("length_m") > 0))
           .groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(best)
           .select(*[F.col(f"e.{c}").alias(c) for c in edges.columns]))
    return out.withColumn("highway", F.coalesce("highway", F.lit("unclassified")))


def with_priors(edges: DataFrame) -> DataFrame:
    """Score columns known from the street class and lit tag alone."""
    return edges.withColumns({
        "sidewalk_score": score.sidewalk_prior(F.col("highway")),
        "crossing_score": score.crossing_prior(F.col("highway")),
        "lighting_score": score.lighting_prior(F.col("lit")),
        "cctv_score": F.lit(0.5), "park_score": F.lit(0.0), "slope_pct": F.lit(2.0), "rfs_coverage": F.lit(0.0),
    })


def with_endpoints(edges: DataFrame, nodes: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """u_lat, u_lon, v_lat, v_lon (and extra node columns) plus the midpoint of every edge."""
    cols = ["lat", "lon", *(extra or [])]

    def side(s: str) -> DataFrame:
        return nodes.select(F.col("node_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols])

    return (edges.join(side("u"), "u").join(side("v"), "v")
            .withColumns({"mid_lat": (F.col("u_lat") + F.col("v_lat")) / 2,
                          "mid_lon": (F.col("u_lon") + F.col("v_lon")) / 2}))


def node_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def cell_density(points: DataFrame, kinds: dict[str, str], size: float = DENSITY_CELL) -> DataFrame:
    """(ci, cj, one count per kind): points in the 3x3 cells around each cell, from cell totals only."""
    return cells.window_counts(cells.count_per_cell(points, size, by="kind", kinds=kinds), list(kinds))


def with_density(edges: DataFrame, points: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Edges with midpoints plus a count column per kind; one shuffle, on the midpoint's cell."""
    counts = cell_density(points, kinds)
    keyed = edges.withColumns({"ci": geo.cell(F.col("mid_lat"), DENSITY_CELL),
                               "cj": geo.cell(F.col("mid_lon"), DENSITY_CELL)})
    return keyed.join(counts, ["ci", "cj"], "left").drop("ci", "cj").fillna(0, list(kinds))


def _survey_d2(lat, lon, plat, plon):
    dy = (plat - lat) * geo.M_PER_DEG_LAT
    dx = (plon - lon) * ELEVATION_LON_SCALE
    return dy * dy + dx * dx


def surveyed_elevation(nodes: DataFrame, heights: DataFrame) -> DataFrame:
    """(lat, lon, surveyed): inverse-distance mean of the 8 nearest heights in the 3x3 cells.

    heights: point_id, lat, lon, val. A height closer than 2 m is taken as it is.
    """
    near = cells.nearest_points(nodes, heights, size=ELEVATION_CELL, k=8, metric=_survey_d2,
                                links=cells.square_links(nodes, ELEVATION_CELL, 1))
    return (near.groupBy(F.col("q_lat").alias("lat"), F.col("q_lon").alias("lon"))
            .agg(F.min("d").alias("d0"), F.max(F.when(F.col("rank") == 1, F.col("val"))).alias("h0"),
                 F.sum(F.when(F.col("d") > 0, F.col("val") / F.col("d"))).alias("hw"),
                 F.sum(F.when(F.col("d") > 0, 1.0 / F.col("d"))).alias("ww"))
            .select("lat", "lon", F.when(F.col("d0") < 4.0, F.col("h0")).otherwise(F.col("hw") / F.col("ww")).alias("surveyed")))


def raster_shape(raster: DataFrame) -> tuple[int, int]:
    """(rows, columns) of a raster given as cell rows."""
    top = raster.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return int(top["r"]) + 1, int(top["c"]) + 1


def raster_quads(raster: DataFrame, shape: tuple[int, int], tile: list[str] | None = None) -> DataFrame:
    """(r, c, nw, ne, sw, se): every raster cell with its right, lower and diagonal neighbour.

    Built once per raster, so that a sample needs a single join. The last row
    and column repeat themselves.
    """
    tile = tile or []
    slots = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(n).alias("slot"))
                      for dr, dc, n in ((0, 0, "nw"), (0, 1, "ne"), (1, 0, "sw"), (1, 1, "se"))])

    def owners(axis: str, step: str, last: int):
        # the cells that see this cell in this slot: one step back, and itself on the far edge
        back = F.col(axis) - F.col(step)
        return F.explode(F.when((F.col(step) == 1) & (F.col(axis) == last), F.array(back, F.col(axis))).otherwise(F.array(back)))

    spread = (raster.select(*tile, "r", "c", "elev", F.explode(slots).alias("s"))
              .select(*tile, "r", "c", "elev", "s.*")
              .withColumn("r0", owners("r", "dr", shape[0] - 1)).withColumn("c0", owners("c", "dc", shape[1] - 1))
              .where((F.col("r0") >= 0) & (F.col("c0") >= 0)))
    return spread.groupBy(*tile, F.col("r0").alias("r"), F.col("c0").alias("c")).agg(
        *[F.max(F.when(F.col("slot") == n, F.col("elev"))).alias(n) for n in ("nw", "ne", "sw", "se")])


def bilinear_sample(samples: DataFrame, raster: DataFrame, shape: tuple[int, int],
                    tile: list[str] | None = None) -> DataFrame:
    """samples with float positions rf, cf plus `elev`: bilinear, or the first known corner NW, NE, SW, SE."""
    tile = tile or []
    r0, c0 = F.floor("rf"), F.floor("cf")
    keyed = samples.withColumns({
        "r": F.least(F.greatest(r0, F.lit(0)), F.lit(shape[0] - 1)).cast("long"),
        "c": F.least(F.greatest(c0, F.lit(0)), F.lit(shape[1] - 1)).cast("long")})
    joined = keyed.join(raster_quads(raster, shape, tile), [*tile, "r", "c"], "left")
    fr, fc = F.col("rf") - r0, F.col("cf") - c0
    top = F.col("nw") * (1 - fc) + F.col("ne") * fc
    low = F.col("sw") * (1 - fc) + F.col("se") * fc
    value = F.coalesce(top * (1 - fr) + low * fr, "nw", "ne", "sw", "se")  # null unless all four are known
    return joined.withColumn("elev", value).drop("r", "c", "nw", "ne", "sw", "se")


def node_elevation(nodes: DataFrame, heights: DataFrame, raster_elev: DataFrame) -> DataFrame:
    """nodes plus elev_m and is_surveyed: the survey wins, the raster fills in.

    raster_elev: node_id, elev.
    """
    survey = surveyed_elevation(nodes, heights)
    at = nodes.join(survey.select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "surveyed"),
                    (F.col("lat") == F.col("s_lat")) & (F.col("lon") == F.col("s_lon")), "left").drop("s_lat", "s_lon")
    at = at.join(raster_elev.select("node_id", F.col("elev").alias("raster")), "node_id", "left")
    return at.withColumns({"elev_m": F.coalesce("surveyed", "raster"),
                           "is_surveyed": F.col("surveyed").isNotNull()}).drop("surveyed", "raster")


def widths_by_name(report: DataFrame) -> DataFrame:
    """Widest reported width per normalised route name."""
    return (report.where(F.col("route_name").isNotNull() & F.col("width_m").isNotNull())
            .groupBy(score.route_name_key(F.col("route_name")).alias("name_key")).agg(F.max("width_m").alias("width_m"))
            .where(F.col("name_key") != ""))


def with_width(edges: DataFrame, widths: DataFrame) -> DataFrame:
    """Edges plus width_m of their route name, null where unknown. Catalyst broadcasts widths when small."""
    keyed = edges.withColumn("name_key", score.route_name_key(F.coalesce("name", F.lit(""))))
    return keyed.join(widths, "name_key", "left").drop("name_key")


def green_hits(mids: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct (mid_lat, mid_lon) near a polygon whose bounding box contains the point.

    vertices: poly_id, seq, lat, lon of closed rings. Candidates come from an
    equi join on cells of the bounding box. The ring test then joins only the
    ring segments in the point's latitude row: crossings of those decide
    inside/outside, their distance decides near/far, so no ring is ever gathered.
    """
    row = DENSITY_CELL
    boxes = vertices.groupBy("poly_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"),
                                            F.min("lon").alias("w"), F.max("lon").alias("e"))
    box_cells = (boxes.select("*", F.explode(F.sequence(geo.cell(F.col("s"), row), geo.cell(F.col("n"), row))).alias("ci"))
                 .select("*", F.explode(F.sequence(geo.cell(F.col("w"), row), geo.cell(F.col("e"), row))).alias("cj")))
    spots = mids.select("mid_lat", "mid_lon").distinct().withColumns(
        {"ci": geo.cell(F.col("mid_lat"), row), "cj": geo.cell(F.col("mid_lon"), row)})
    inside_box = (spots.join(box_cells, ["ci", "cj"])
                  .where(F.col("mid_lat").between(F.col("s"), F.col("n")) & F.col("mid_lon").between(F.col("w"), F.col("e")))
                  .select("poly_id", "ci", "mid_lat", "mid_lon"))
    nxt = vertices.select("poly_id", (F.col("seq") - 1).alias("seq"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    segs = vertices.select("poly_id", "seq", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).join(nxt, ["poly_id", "seq"])
    low, high = F.least("lat1", "lat2") - GREEN_REACH_DEG, F.greatest("lat1", "lat2") + GREEN_REACH_DEG
    seg_rows = segs.withColumn("ci", F.explode(F.sequence(geo.cell(low, row), geo.cell(high, row))))
    y, x = F.col("mid_lat"), F.col("mid_lon")
    spans = (F.col("lat1") > y) != (F.col("lat2") > y)
    at_x = F.col("lon1") + (y - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) * (F.col("lon2") - F.col("lon1"))
    away = geo.segment_distance(x, y, F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    judged = (inside_box.join(seg_rows, ["poly_id", "ci"], "left")
              .groupBy("mid_lat", "mid_lon", "poly_id")
              .agg((F.count_if(spans & (at_x > x)) % 2 == 1).alias("inside"), F.min(away).alias("away")))
    return judged.where(F.col("inside") | (F.col("away") < GREEN_REACH_DEG)).select("mid_lat", "mid_lon").distinct()


def with_green(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with midpoints plus is_green."""
    hits = green_hits(edges, vertices).select(F.col("mid_lat").alias("g_lat"), F.col("mid_lon").alias("g_lon"))
    return (edges.join(hits, (F.col("mid_lat") == F.col("g_lat")) & (F.col("mid_lon") == F.col("g_lon")), "left")
            .withColumn("is_green", F.col("g_lat").isNotNull()).drop("g_lat", "g_lon"))


POINT_KINDS = {"n_signal": "pedestrian_signal", "n_light": "streetlight", "n_cctv": "cctv"}


def enrich(edges: DataFrame, nodes: DataFrame, points: DataFrame, widths: DataFrame, green: DataFrame | None = None,
           *, has: dict[str, bool] | None = None) -> DataFrame:
    """Collapsed edges with priors -> fully scored edges.

    nodes carry elev_m and is_surveyed. `has` says which point layers were
    supplied; a missing layer (or green=None) leaves its prior as it is.
    """
    has = {"signal": True, "light": True, "cctv": True, **(has or {})}
    full = with_endpoints(edges, nodes, ["elev_m", "is_surveyed"])
    full = with_width(with_density(full, points, POINT_KINDS), widths)
    if green is not None:
        full = with_green(full, green)
    both = F.col("u_is_surveyed") & F.col("v_is_surveyed")
    grade = score.slope_pct(F.col("u_elev_m"), F.col("v_elev_m"), both, F.col("length_m"))
    has_width = F.col("width_m").isNotNull()
    cover = (F.lit(0.4)
             + F.when(grade.isNull(), 0.0).when(both, 0.35).otherwise(0.25)
             + F.lit(0.1 if has["signal"] else 0.0)
             + F.when(has_width, 0.15).otherwise(0.0)
             + F.lit(0.15 if green is not None else 0.0)
             + F.lit(0.2 if has["cctv"] else 0.0)
             + F.lit(0.15 if has["light"] else 0.0))
    out = {
        "slope_known": grade.isNotNull(), "slope_surveyed": grade.isNotNull() & both,
        "slope_pct": F.coalesce(grade, F.col("slope_pct")),
        "sidewalk_score": F.when(has_width, score.width_score(F.col("width_m"))).otherwise(F.col("sidewalk_score")),
        "rfs_coverage": geo.half_even(F.least(F.lit(1.0), cover), 2),
    }
    if has["signal"]:
        out["crossing_score"] = score.crossing_blend(F.col("crossing_score"), score.density(F.col("n_signal"), 3))
    if has["light"]:
        out["lighting_score"] = score.lighting_blend(F.col("lighting_score"), score.density(F.col("n_light"), 2))
    if has["cctv"]:
        out["cctv_score"] = score.cctv_blend(score.density(F.col("n_cctv"), 3))
    if green is not None:
        out["park_score"] = F.when(F.col("is_green"), 1.0).otherwise(0.0)
    return full.withColumns(out).drop("u_elev_m", "v_elev_m", "u_is_surveyed", "v_is_surveyed", "is_green")
