"""Point-to-point spatial joins.

A range condition would plan a nested-loop join, so every spatial join here is
an equi join on grid cells. Two things keep hot cells harmless:

* densities only ever join pre-aggregated cell counts;
* nearest-neighbour joins first reduce points that share a coordinate, and send
  the queries whose window holds more than HOT_WINDOW points down a second way:
  the window is refined into smaller and smaller boxes and boxes that cannot
  hold one of the k nearest points are dropped before any point is touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.session import any_row, cut

HOT_WINDOW = 4096
REFINE = (16, 16)

Metric = Callable[[Column, Column, Column, Column], Column]


def square(reach: int) -> Column:
    """Array of (di, dj) offsets of the (2*reach+1)^2 window."""
    return F.expr(f"flatten(transform(sequence(-{reach}L, {reach}L), a -> "
                  f"transform(sequence(-{reach}L, {reach}L), b -> named_struct('di', a, 'dj', b))))")


def count_per_cell(points: DataFrame, size: float, *, by: str | None = None,
                   kinds: dict[str, str] | None = None) -> DataFrame:
    """Rows per cell; with `by`/`kinds` one count column per kind value."""
    keyed = points.select(geo.cell(F.col("lat"), size).alias("ci"), geo.cell(F.col("lon"), size).alias("cj"),
                          *([by] if by else []))
    if not kinds:
        return keyed.groupBy("ci", "cj").agg(F.count("*").alias("n"))
    return (keyed.where(F.col(by).isin(*kinds.values())).groupBy("ci", "cj")
            .agg(*[F.count_if(F.col(by) == v).alias(k) for k, v in kinds.items()]))


def window_counts(counts: DataFrame, names: list[str], reach: int = 1) -> DataFrame:
    """Sum of the count columns over the window around every cell that sees a point."""
    spread = counts.select("*", F.explode(square(reach)).alias("o"))
    return (spread.groupBy((F.col("ci") + F.col("o.di")).alias("ci"), (F.col("cj") + F.col("o.dj")).alias("cj"))
            .agg(*[F.sum(n).alias(n) for n in names]))


def square_links(queries: DataFrame, size: float, reach: int) -> DataFrame:
    """(qi, qj) -> (ci, cj): the cells each query cell may look into."""
    cells = queries.select(geo.cell(F.col("lat"), size).alias("qi"), geo.cell(F.col("lon"), size).alias("qj")).distinct()
    return (cells.select("qi", "qj", F.explode(square(reach)).alias("o"))
            .select("qi", "qj", (F.col("qi") + F.col("o.di")).alias("ci"), (F.col("qj") + F.col("o.dj")).alias("cj")))


def _top_k(pairs: DataFrame, k: int) -> DataFrame:
    if k == 1:
        best = pairs.groupBy("q_lat", "q_lon").agg(F.min(F.struct("d", "point_id", "p_lat", "p_lon", "val")).alias("b"))
        return best.select("q_lat", "q_lon", "b.*", F.lit(1).alias("rank"))
    w = Window.partitionBy("q_lat", "q_lon").orderBy("d", "point_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _box_bounds(metric: Metric) -> tuple[Column, Column]:
    """Least and greatest distance from the query to a box, with a little slack for curved metrics."""
    lat, lon = F.col("q_lat"), F.col("q_lon")
    near = metric(lat, lon, F.least(F.greatest(lat, F.col("lat_lo")), F.col("lat_hi")),
                  F.least(F.greatest(lon, F.col("lon_lo")), F.col("lon_hi")))
    far_lat = F.when(F.abs(F.col("lat_lo") - lat) > F.abs(F.col("lat_hi") - lat), F.col("lat_lo")).otherwise(F.col("lat_hi"))
    far_lon = F.when(F.abs(F.col("lon_lo") - lon) > F.abs(F.col("lon_hi") - lon), F.col("lon_lo")).otherwise(F.col("lon_hi"))
    return near * 0.999, metric(lat, lon, far_lat, far_lon) * 1.001


def _descend(pairs: DataFrame, pts: DataFrame, size: float, k: int, metric: Metric) -> DataFrame:
    """Refine (query, cell) pairs box by box; keeps every box that may hold a k-nearest point."""
    near, far = _box_bounds(metric)
    per_query = Window.partitionBy("q_lat", "q_lon").orderBy("far")
    for factor in REFINE:
        size = size / factor
        pts = pts.withColumns({"fi": geo.cell(F.col("p_lat"), size), "fj": geo.cell(F.col("p_lon"), size)})
        boxes = pts.groupBy("ci", "cj", "fi", "fj").agg(
            F.count("*").alias("n"), F.min("p_lat").alias("lat_lo"), F.max("p_lat").alias("lat_hi"),
            F.min("p_lon").alias("lon_lo"), F.max("p_lon").alias("lon_hi"))
        live = pairs.join(boxes, ["ci", "cj"]).withColumns({"near": near, "far": far})
        # the k nearest points lie within the far side of the boxes that together hold k points
        bound = F.min(F.when(F.col("seen") >= k, F.col("far"))).over(Window.partitionBy("q_lat", "q_lon"))
        live = live.withColumn("seen", F.sum("n").over(per_query)).withColumn("bound", bound)
        pairs = (live.where(F.col("bound").isNull() | (F.col("near") <= F.col("bound")))
                 .select("q_lat", "q_lon", F.col("fi").alias("ci"), F.col("fj").alias("cj")))
        pts = pts.withColumns({"ci": F.col("fi"), "cj": F.col("fj")})
    return pairs.join(pts, ["ci", "cj"])


def nearest_points(queries: DataFrame, points: DataFrame, *, size: float, links: DataFrame,
                   k: int = 1, metric: Metric = geo.haversine, within: float | None = None,
                   digits: int | None = None) -> DataFrame:
    """The k nearest points of every distinct query coordinate, among the linked cells.

    queries: lat, lon. points: point_id, lat, lon, val. Ties go to the smaller point_id.
    Returns q_lat, q_lon, rank, d, point_id, p_lat, p_lon, val.
    """
    same_spot = Window.partitionBy("p_lat", "p_lon").orderBy("point_id")
    pts = points.select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "val")
    # k of the points that share a coordinate are enough
    pts = (pts.withColumn("dup", F.row_number().over(same_spot)).where(F.col("dup") <= k).drop("dup")
           .withColumns({"ci": geo.cell(F.col("p_lat"), size), "cj": geo.cell(F.col("p_lon"), size)}))
    spots = (queries.select(F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")).distinct()
             .withColumns({"qi": geo.cell(F.col("q_lat"), size), "qj": geo.cell(F.col("q_lon"), size)}))
    d = metric(F.col("q_lat"), F.col("q_lon"), F.col("p_lat"), F.col("p_lon"))
    if digits is not None:
        d = geo.half_even(d, digits)

    def measured(pairs: DataFrame) -> DataFrame:
        out = pairs.withColumn("d", d).select("q_lat", "q_lon", "d", "point_id", "p_lat", "p_lon", "val")
        return out if within is None else out.where(F.col("d") <= within)

    per_cell = pts.groupBy("ci", "cj").agg(F.count("*").alias("n"))
    load = links.join(per_cell, ["ci", "cj"]).groupBy("qi", "qj").agg(F.sum("n").alias("n"))
    hot = load.where(F.col("n") > HOT_WINDOW).select("qi", "qj")
    if not any_row(hot):
        return _top_k(measured(spots.join(links, ["qi", "qj"]).join(pts, ["ci", "cj"])), k)
    cool = spots.join(hot, ["qi", "qj"], "left_anti").join(links, ["qi", "qj"]).join(pts, ["ci", "cj"])
    warm = (spots.join(hot, ["qi", "qj"], "left_semi").join(links, ["qi", "qj"])
            .select("q_lat", "q_lon", "ci", "cj"))
    return _top_k(measured(cool.select(*_PAIR)).unionByName(
        measured(_descend(warm, pts, size, k, metric).select(*_PAIR))), k)


_PAIR = ("q_lat", "q_lon", "point_id", "p_lat", "p_lon", "val")


#: Widths, in cells, of the blocks through which ring_links comes down to single cells.
BLOCKS = (16, 4, 1)


def _gap(lo: Column, hi: Column, at: str) -> Column:
    return F.greatest(lo - F.col(at), F.col(at) - hi, F.lit(0))


def ring_links(queries: DataFrame, points: DataFrame, size: float, max_ring: int = 15) -> DataFrame:
    """(qi, qj) -> (ci, cj): the occupied cells of the ring rule, out to one ring past the first occupied one, at most max_ring.

    Works on distinct cells only. A query cell begins with the occupied blocks of 16
    x 16 cells around it and comes down to blocks of 4 x 4 and to cells. On each
    level the nearest block whose far side is known bounds the first hit, and blocks
    beyond one ring more are left behind, so empty land costs no rows.
    """
    occupied = cut(points.select(geo.cell(F.col("lat"), size).alias("ci"), geo.cell(F.col("lon"), size).alias("cj")).distinct())
    first = BLOCKS[0]
    reach = -(-max_ring // first)
    at = queries.select(geo.cell(F.col("lat"), size).alias("qi"), geo.cell(F.col("lon"), size).alias("qj")).distinct()
    live = at.select("qi", "qj", F.explode(square(reach)).alias("o")).select(
        "qi", "qj", (F.floor(F.col("qi") / first) + F.col("o.di")).alias("bi"), (F.floor(F.col("qj") / first) + F.col("o.dj")).alias("bj"))
    per_query = Window.partitionBy("qi", "qj")
    for k, width in enumerate(BLOCKS):
        names = ["bi", "bj"] + (["pi", "pj"] if k else [])
        own = [F.floor(F.col("ci") / width).alias("bi"), F.floor(F.col("cj") / width).alias("bj")]
        parent = [F.floor(F.col("ci") / BLOCKS[k - 1]).alias("pi"), F.floor(F.col("cj") / BLOCKS[k - 1]).alias("pj")] if k else []
        blocks = occupied.select(*own, *parent).distinct()
        if k:
            live = live.select("qi", "qj", F.col("bi").alias("pi"), F.col("bj").alias("pj")).join(blocks, ["pi", "pj"])
        else:
            live = live.join(blocks, names)
        lo = {c: F.col(f"b{c}") * width for c in "ij"}
        hi = {c: lo[c] + width - 1 for c in "ij"}
        near = F.greatest(*[_gap(lo[c], hi[c], f"q{c}") for c in "ij"])
        # an occupied cell of the block lies no farther than the block's far side
        far = F.greatest(*[F.greatest(F.abs(F.col(f"q{c}") - lo[c]), F.abs(F.col(f"q{c}") - hi[c])) for c in "ij"])
        live = live.withColumns({"near": near, "hit": F.min(far).over(per_query)})
        live = live.where(F.col("near") <= F.least(F.col("hit") + 1, F.lit(max_ring))).select("qi", "qj", "bi", "bj")
    return live.withColumnsRenamed({"bi": "ci", "bj": "cj"})


NODE_CELL = 0.002


def _as_points(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("point_id"), "lat", "lon", F.lit(None).cast("double").alias("val"))


def _plane_distance(lat, lon, plat, plon):
    return F.sqrt(geo.plane_d2(lat, lon, plat, plon))


def nearest_node(queries: DataFrame, nodes: DataFrame, max_ring: int = 15) -> DataFrame:
    """queries plus node_id and snap_m of the nearest node by the ring rule; null where none is in reach."""
    pts = _as_points(nodes)
    links = cut(ring_links(queries, pts, NODE_CELL, max_ring))
    best = nearest_points(queries, pts, size=NODE_CELL, links=links, metric=_plane_distance, digits=6)
    hit = best.select("q_lat", "q_lon", F.col("point_id").alias("node_id"), F.col("d").alias("snap_m"))
    return (queries.join(hit, (queries.lat == hit.q_lat) & (queries.lon == hit.q_lon), "left")
            .drop("q_lat", "q_lon"))


def reach_links(queries: DataFrame, size: float, max_distance_m: float) -> DataFrame:
    """(qi, qj) -> (ci, cj): the cells within max_distance_m of a query cell, at whatever latitude it lies."""
    spots = queries.select(geo.cell(F.col("lat"), size).alias("qi"), geo.cell(F.col("lon"), size).alias("qj")).distinct()
    tall = int(max_distance_m / (size * geo.M_PER_DEG_LAT)) + 1
    # degrees of longitude are shortest on the side away from the equator
    edge = F.least(F.greatest(F.abs(F.col("qi")), F.abs(F.col("qi") + 1)) * size + max_distance_m / geo.M_PER_DEG_LAT, F.lit(89.0))
    wide = (F.floor(F.lit(max_distance_m) / (geo.m_per_deg_lon(edge) * size)) + 1).cast("long")
    return (spots.withColumn("wide", wide).select("qi", "qj", "wide", F.explode(F.expr(f"sequence(-{tall}L, {tall}L)")).alias("di"))
            .select("qi", "qj", "di", F.explode(F.expr("sequence(-wide, wide)")).alias("dj"))
            .select("qi", "qj", (F.col("qi") + F.col("di")).alias("ci"), (F.col("qj") + F.col("dj")).alias("cj")))


def nodes_within(queries: DataFrame, nodes: DataFrame, *, limit: int = 6, max_distance_m: float = 800.0) -> DataFrame:
    """The `limit` nearest nodes within max_distance_m of every query, ranked."""
    pts = _as_points(nodes)
    links = cut(reach_links(queries, NODE_CELL, max_distance_m))
    best = nearest_points(queries, pts, size=NODE_CELL, links=links, k=limit, metric=_plane_distance,
                          within=max_distance_m, digits=6)
    hit = best.select("q_lat", "q_lon", F.col("point_id").alias("node_id"), F.col("d").alias("snap_m"), "rank")
    return queries.join(hit, (queries.lat == hit.q_lat) & (queries.lon == hit.q_lon)).drop("q_lat", "q_lon")


def area_box(radius_m: Column) -> dict[str, Column]:
    """Node-cell range covered by a square of radius_m around (lat, lon)."""
    dlat = radius_m / geo.M_PER_DEG_LAT
    dlon = radius_m / geo.m_per_deg_lon(F.col("lat"))
    return {
        "i_lo": geo.cell(F.col("lat") - dlat, NODE_CELL), "i_hi": geo.cell(F.col("lat") + dlat, NODE_CELL),
        "j_lo": geo.cell(F.col("lon") - dlon, NODE_CELL), "j_hi": geo.cell(F.col("lon") + dlon, NODE_CELL),
    }


def in_area(lat: Column, lon: Column) -> Column:
    return (geo.cell(lat, NODE_CELL).between(F.col("i_lo"), F.col("i_hi"))
            & geo.cell(lon, NODE_CELL).between(F.col("j_lo"), F.col("j_hi")))


def subgraph_nodes(areas: DataFrame, nodes: DataFrame) -> DataFrame:
    """(area_id, node_id) for areas(area_id, i_lo, i_hi, j_lo, j_hi): nodes whose cell meets the area.

    Cells are exploded from the areas, so the way of the join is named, as in paths.locate.
    """
    cells = (areas.select("area_id", F.explode(F.expr("sequence(i_lo, i_hi)")).alias("ci"), "j_lo", "j_hi")
             .select("area_id", "ci", F.explode(F.expr("sequence(j_lo, j_hi)")).alias("cj")))
    keyed = nodes.select("node_id", geo.cell(F.col("lat"), NODE_CELL).alias("ci"), geo.cell(F.col("lon"), NODE_CELL).alias("cj"))
    return cells.join(keyed.hint("shuffle_hash"), ["ci", "cj"]).select("area_id", "node_id")


def subgraph_edges(areas: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(area_id, u, v, ...) edges with both ends among the area's nodes."""
    inside = subgraph_nodes(areas, nodes)
    return (edges.join(inside.withColumnRenamed("node_id", "u"), "u")
            .join(inside.withColumnRenamed("node_id", "v"), ["area_id", "v"], "left_semi"))
