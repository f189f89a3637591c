"""Derived tables the queries share, on the Spark side and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe import fixtures as fx
from strideframe.catalog.sqltext import D, cell, density, lookup, plane_d2, r, rfs, seg_dist  # noqa: F401
from strideframe.functions import geo, score
from strideframe.operators import edges as ed

RF = "((lat - CAST(37.45 AS DOUBLE)) / CAST(0.0007237 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE))"
CF = "((lon - CAST(126.85 AS DOUBLE)) / CAST(0.0009063 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE))"


def edges(spark, sf) -> DataFrame:
    return ed.with_priors(ed.collapse_parallel(fx.road_edge_raw(spark, sf)))


def heights(spark, sf) -> DataFrame:
    return (fx.point_feature(spark, sf).where("kind = 'spot_height'")
            .select("point_id", "lat", "lon", F.col("value").alias("val")))


def raster_samples(spark, sf) -> DataFrame:
    return fx.road_node(spark, sf).select("node_id", "lat", "lon", F.expr(RF).alias("rf"), F.expr(CF).alias("cf"))


def raster_elevation(spark, sf) -> DataFrame:
    raster = fx.raster_cell(spark, sf)
    return ed.bilinear_sample(raster_samples(spark, sf), raster, ed.raster_shape(raster))


def located_nodes(spark, sf) -> DataFrame:
    """node_id, lat, lon, elev_m, is_surveyed."""
    nodes = fx.road_node(spark, sf).select("node_id", "lat", "lon")
    return ed.node_elevation(nodes, heights(spark, sf), raster_elevation(spark, sf))


def scored_edges(spark, sf) -> DataFrame:
    return ed.enrich(edges(spark, sf), located_nodes(spark, sf), fx.point_feature(spark, sf),
                     ed.widths_by_name(fx.width_report(spark, sf)), fx.green_polygon_vertex(spark, sf))


def window_sum_sql(kind: str) -> str:
    size = ed.DENSITY_CELL
    return f"""SELECT ci + a.d AS ci, cj + b.d AS cj, CAST(SUM(n) AS BIGINT) AS n FROM
      (SELECT {cell('lat', size)} AS ci, {cell('lon', size)} AS cj, COUNT(*) AS n FROM point_feature
       WHERE kind = '{kind}' GROUP BY 1, 2), (SELECT range - 1 AS d FROM range(3)) a, (SELECT range - 1 AS d FROM range(3)) b
      GROUP BY 1, 2"""


SQL: dict[str, str] = {
    **fx.VIEW_SQL,
    "edge": f"""SELECT u, v, length_m, COALESCE(highway, 'unclassified') AS highway, lit, name,
        {lookup('highway', score.SIDEWALK_PRIOR, 0.5)} AS sidewalk_score, {lookup('highway', score.CROSSING_PRIOR, 0.5)} AS crossing_score,
        {lookup('lit', score.LIT_PRIOR, 0.5)} AS lighting_score, {D(0.5)} AS cctv_score, {D(0.0)} AS park_score, {D(2.0)} AS slope_pct
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY least(u, v), greatest(u, v)
                   ORDER BY length_m, highway NULLS FIRST, lit NULLS FIRST, name NULLS FIRST, u, v) AS rn
            FROM road_edge_raw WHERE u <> v AND length_m > 0) WHERE rn = 1""",
    "edge_mid": """SELECT e.*, a.lat AS u_lat, a.lon AS u_lon, b.lat AS v_lat, b.lon AS v_lon,
        (a.lat + b.lat) / 2 AS mid_lat, (a.lon + b.lon) / 2 AS mid_lon
      FROM edge e JOIN road_node a ON a.node_id = e.u JOIN road_node b ON b.node_id = e.v""",
    "signal_window": window_sum_sql("pedestrian_signal"),
    "light_window": window_sum_sql("streetlight"),
    "cctv_window": window_sum_sql("cctv"),
    "edge_counts": f"""SELECT e.*, COALESCE(s.n, 0) AS n_signal, COALESCE(l.n, 0) AS n_light, COALESCE(c.n, 0) AS n_cctv
      FROM edge_mid e
      LEFT JOIN signal_window s ON s.ci = {cell('mid_lat', 0.001)} AND s.cj = {cell('mid_lon', 0.001)}
      LEFT JOIN light_window l ON l.ci = {cell('mid_lat', 0.001)} AND l.cj = {cell('mid_lon', 0.001)}
      LEFT JOIN cctv_window c ON c.ci = {cell('mid_lat', 0.001)} AND c.cj = {cell('mid_lon', 0.001)}""",
    "height_near": f"""SELECT node_id, d2, value, ROW_NUMBER() OVER (PARTITION BY node_id ORDER BY d2, point_id) AS rn FROM (
        SELECT n.node_id, p.point_id, p.value,
          ((p.lat - n.lat) * {D(110540.0)}) * ((p.lat - n.lat) * {D(110540.0)})
          + ((p.lon - n.lon) * {D(ed.ELEVATION_LON_SCALE)}) * ((p.lon - n.lon) * {D(ed.ELEVATION_LON_SCALE)}) AS d2
        FROM road_node n JOIN point_feature p ON p.kind = 'spot_height'
         AND {cell('p.lat', 0.0005)} BETWEEN {cell('n.lat', 0.0005)} - 1 AND {cell('n.lat', 0.0005)} + 1
         AND {cell('p.lon', 0.0005)} BETWEEN {cell('n.lon', 0.0005)} - 1 AND {cell('n.lon', 0.0005)} + 1)""",
    "survey_elev": f"""SELECT node_id, CASE WHEN MIN(d2) < 4.0 THEN MAX(CASE WHEN rn = 1 THEN value END)
        ELSE SUM(CASE WHEN d2 > 0 THEN value / d2 END) / SUM(CASE WHEN d2 > 0 THEN {D(1.0)} / d2 END) END AS surveyed
      FROM height_near WHERE rn <= 8 GROUP BY node_id""",
    "raster_dim": "SELECT MAX(r) AS r_max, MAX(c) AS c_max FROM raster_cell",
    "raster_elev": f"""SELECT s.node_id, COALESCE(
          (nw.elev * (1 - (cf - floor(cf))) + ne.elev * (cf - floor(cf))) * (1 - (rf - floor(rf)))
          + (sw.elev * (1 - (cf - floor(cf))) + se.elev * (cf - floor(cf))) * (rf - floor(rf)),
          nw.elev, ne.elev, sw.elev, se.elev) AS elev
      FROM (SELECT node_id, {RF} AS rf, {CF} AS cf, r_max, c_max FROM road_node, raster_dim) s
      LEFT JOIN raster_cell nw ON nw.r = least(CAST(floor(rf) AS BIGINT), r_max) AND nw.c = least(CAST(floor(cf) AS BIGINT), c_max)
      LEFT JOIN raster_cell ne ON ne.r = least(CAST(floor(rf) AS BIGINT), r_max) AND ne.c = least(CAST(floor(cf) AS BIGINT) + 1, c_max)
      LEFT JOIN raster_cell sw ON sw.r = least(CAST(floor(rf) AS BIGINT) + 1, r_max) AND sw.c = least(CAST(floor(cf) AS BIGINT), c_max)
      LEFT JOIN raster_cell se ON se.r = least(CAST(floor(rf) AS BIGINT) + 1, r_max) AND se.c = least(CAST(floor(cf) AS BIGINT) + 1, c_max)""",
    "node_elev": """SELECT n.node_id, n.lat, n.lon, COALESCE(s.surveyed, q.elev) AS elev_m, s.surveyed IS NOT NULL AS is_surveyed
      FROM road_node n LEFT JOIN survey_elev s ON s.node_id = n.node_id LEFT JOIN raster_elev q ON q.node_id = n.node_id""",
    "name_width": """SELECT regexp_replace(route_name, '\\s+', '', 'g') AS name_key, MAX(width_m) AS width_m
      FROM width_report WHERE route_name IS NOT NULL AND width_m IS NOT NULL GROUP BY 1 HAVING name_key <> ''""",
    "poly_box": """SELECT poly_id, MIN(lat) AS s, MAX(lat) AS n, MIN(lon) AS w, MAX(lon) AS e FROM green_polygon_vertex GROUP BY 1""",
    "poly_seg": """SELECT a.poly_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
      FROM green_polygon_vertex a JOIN green_polygon_vertex b ON b.poly_id = a.poly_id AND b.seq = a.seq + 1""",
    "green_hit": f"""SELECT DISTINCT u, v FROM (
        SELECT e.u, e.v, b.poly_id,
          SUM(CASE WHEN (lat1 > mid_lat) <> (lat2 > mid_lat) AND lon1 + (mid_lat - lat1) / (lat2 - lat1) * (lon2 - lon1) > mid_lon THEN 1 ELSE 0 END) AS crossings,
          MIN({seg_dist('mid_lon', 'mid_lat', 'lon1', 'lat1', 'lon2', 'lat2')}) AS away
        FROM edge_mid e JOIN poly_box b ON mid_lat BETWEEN b.s AND b.n AND mid_lon BETWEEN b.w AND b.e
        JOIN poly_seg g ON g.poly_id = b.poly_id GROUP BY 1, 2, 3) WHERE crossings % 2 = 1 OR away < 0.0004""",
    "edge_joined": f"""SELECT e.*, a.elev_m AS e1, b.elev_m AS e2, a.is_surveyed AND b.is_surveyed AS both_surveyed, w.width_m,
        g.u IS NOT NULL AS is_green,
        CASE WHEN a.elev_m IS NOT NULL AND b.elev_m IS NOT NULL THEN
          {r(f"least({D(15.0)}, greatest({D(0.0)}, abs(b.elev_m - a.elev_m) - CASE WHEN a.is_surveyed AND b.is_surveyed THEN {D(0.3)} ELSE {D(1.5)} END) / length_m * {D(100.0)})", 2)} END AS grade
      FROM edge_counts e JOIN node_elev a ON a.node_id = e.u JOIN node_elev b ON b.node_id = e.v
      LEFT JOIN name_width w ON w.name_key = regexp_replace(COALESCE(e.name, ''), '\\s+', '', 'g')
      LEFT JOIN green_hit g ON g.u = e.u AND g.v = e.v""",
    "edge_scored": f"""SELECT u, v, length_m, highway, lit, name, u_lat, u_lon, v_lat, v_lon, mid_lat, mid_lon, n_signal, n_light, n_cctv, width_m,
        grade IS NOT NULL AS slope_known, grade IS NOT NULL AND both_surveyed AS slope_surveyed,
        COALESCE(grade, slope_pct) AS slope_pct,
        CASE WHEN width_m IS NULL THEN sidewalk_score WHEN width_m >= 2 THEN {D(1.0)} WHEN width_m <= 1 THEN {D(0.3)}
             ELSE {D(0.3)} + {D(0.7)} * (width_m - {D(1.0)}) END AS sidewalk_score,
        {r(f"{D(0.5)} * crossing_score + {D(0.5)} * ({D(1.0)} - {D(0.7)} * {density('n_signal', 3)})", 2)} AS crossing_score,
        {r(f"{D(0.4)} * lighting_score + {D(0.6)} * ({D(0.2)} + {D(0.8)} * {density('n_light', 2)})", 2)} AS lighting_score,
        {r(f"{D(0.3)} + {D(0.7)} * {density('n_cctv', 3)}", 2)} AS cctv_score,
        CASE WHEN is_green THEN {D(1.0)} ELSE {D(0.0)} END AS park_score,
        {r(f"least({D(1.0)}, {D(0.4)} + CASE WHEN grade IS NULL THEN {D(0.0)} WHEN both_surveyed THEN {D(0.35)} ELSE {D(0.25)} END + {D(0.1)} + CASE WHEN width_m IS NULL THEN {D(0.0)} ELSE {D(0.15)} END + {D(0.15)} + {D(0.2)} + {D(0.15)})", 2)} AS rfs_coverage
      FROM edge_joined""",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    return fx.with_ctes({**SQL, **(extra or {})}, body)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: geo.half_even(F.col(c), digits) for c in cols})
