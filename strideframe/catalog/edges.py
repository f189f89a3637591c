"""Queries of the edge-scoring family."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe import fixtures as fx
from strideframe.catalog import base as b
from strideframe.catalog.base import rounded, sql
from strideframe.catalog.sqltext import D, cell, followable, main_road_cost, r, rfs, weight
from strideframe.functions import geo, score
from strideframe.operators import cells, standing
from strideframe.operators import edges as ed
from strideframe.session import cut

SCORE_COLS = ("sidewalk_score", "crossing_score", "lighting_score", "cctv_score", "park_score", "slope_pct", "rfs_coverage")


def top_scored_edges(spark, sf):
    """Flagship: raw edges and points -> scored edges -> the 20 friendliest."""
    e = b.scored_edges(spark, sf).withColumn("rfs", geo.half_even(score.edge_rfs()))
    return rounded(e, "length_m").select("u", "v", "length_m", "highway", "rfs").orderBy(F.desc("rfs"), "u", "v").limit(20)


def edge_collapse(spark, sf):
    return rounded(b.edges(spark, sf), "length_m").select("u", "v", "length_m", "highway", "lit", "name", "sidewalk_score",
                                                           "crossing_score", "lighting_score", "cctv_score", "park_score", "slope_pct")


def edge_midpoints(spark, sf):
    full = ed.with_endpoints(b.edges(spark, sf), fx.road_node(spark, sf))
    return rounded(full, "mid_lat", "mid_lon").select("u", "v", "mid_lat", "mid_lon")


def point_cells(spark, sf):
    pts = fx.point_feature(spark, sf)
    keyed = pts.select("kind", geo.cell(F.col("lat"), 0.001).alias("ci"), geo.cell(F.col("lon"), 0.001).alias("cj"))
    return keyed.groupBy("kind", "ci", "cj").agg(F.count("*").alias("n"))


def edge_density(spark, sf):
    full = ed.with_endpoints(b.edges(spark, sf), fx.road_node(spark, sf))
    out = ed.with_density(full, fx.point_feature(spark, sf), ed.POINT_KINDS)
    return out.select("u", "v", geo.half_even(score.density(F.col("n_signal"), 3)).alias("signal_density"),
                      geo.half_even(score.density(F.col("n_light"), 2)).alias("light_density"),
                      geo.half_even(score.density(F.col("n_cctv"), 3)).alias("cctv_density"))


def elevation_survey(spark, sf):
    out = ed.surveyed_elevation(fx.road_node(spark, sf), b.heights(spark, sf))
    return rounded(out, "lat", "lon", "surveyed")


def elevation_raster(spark, sf):
    return rounded(b.raster_elevation(spark, sf), "elev").select("node_id", "elev")


def elevation_priority(spark, sf):
    return b.located_nodes(spark, sf).select("node_id", geo.half_even(F.col("elev_m"), 1).alias("elev"), "is_surveyed")


def widths_by_name(spark, sf):
    w = ed.widths_by_name(fx.width_report(spark, sf))
    return w.select("name_key", geo.half_even(F.col("width_m")).alias("width_m"),
                    geo.half_even(score.width_score(F.col("width_m"))).alias("width_score"))


def edge_width(spark, sf):
    w = ed.with_width(b.edges(spark, sf), ed.widths_by_name(fx.width_report(spark, sf)))
    return rounded(w, "width_m").select("u", "v", "name", "width_m")


def edge_green(spark, sf):
    full = ed.with_endpoints(b.edges(spark, sf), fx.road_node(spark, sf))
    return ed.with_green(full, fx.green_polygon_vertex(spark, sf)).where("is_green").select("u", "v")


def edge_enriched(spark, sf):
    return rounded(b.scored_edges(spark, sf), *SCORE_COLS).select("u", "v", *SCORE_COLS)


def edge_rfs_profiles(spark, sf):
    e = b.scored_edges(spark, sf)
    hills = F.col("slope_pct")
    return e.select("u", "v", *[geo.half_even(score.edge_rfs(t == "n", h == "h")).alias(f"rfs_{t}{h}") for t in "dn" for h in "fh"],
                    geo.half_even(score.slope_score(hills, False)).alias("slope_flat"),
                    geo.half_even(score.slope_score(hills, True)).alias("slope_hills"))


def routing_weights(spark, sf):
    e = score.with_routing_weights(b.scored_edges(spark, sf))
    names = [f"w_{t}{h}" for t in "dn" for h in "fh"]
    return rounded(e, *names).select("u", "v", *names)


def route_costs(spark, sf):
    e = score.with_routing_weights(b.scored_edges(spark, sf))
    return e.select("u", "v", geo.half_even(score.followable_weight(F.col("w_df"))).alias("follow_weight"),
                    geo.half_even(score.main_road_cost()).alias("main_road_cost"),
                    geo.half_even(F.col("length_m") * score.main_road_cost()).alias("road_weight"))


def score_bands(spark, sf):
    s = geo.half_even(score.edge_rfs())
    band = F.when(s >= 0.62, "green").when(s >= 0.48, "amber").otherwise("red")
    return b.scored_edges(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def citywide_standing(spark, sf):
    # scored once: the count, the sample and the standing all read it
    e = cut(b.scored_edges(spark, sf).select("u", "v", geo.half_even(score.edge_rfs()).alias("rfs")))
    sample = standing.systematic_sample(e, [F.col("u"), F.col("v")]).select("rfs")
    return standing.standing(e, sample).select("u", "v", "top_percent")


def citywide_sample(spark, sf):
    e = b.scored_edges(spark, sf).select("u", "v", geo.half_even(score.edge_rfs()).alias("rfs"))
    ranked = standing.with_rank(e, [F.col("rfs"), F.col("u"), F.col("v")])
    return ranked.withColumnRenamed("rank0", "position")


def sanity_report(spark, sf):
    """Mean score near each polygon centre against 0.9 x the 80th percentile of all edges."""
    from strideframe.plans.build import sanity_report as report

    e = b.scored_edges(spark, sf).withColumn("rfs", geo.half_even(score.edge_rfs()))
    spots = fx.green_polygon_vertex(spark, sf).where("seq = 0").select(F.col("poly_id").alias("spot_id"), "lat", "lon")
    return rounded(report(e, spots), "mean_rfs", "q80")


def facility_counts(spark, sf):
    f = fx.point_feature(spark, sf).where("kind = 'facility'")
    kind = F.when(F.col("point_id") % 10 == 0, F.lit(None)).otherwise(F.col("facility_type"))
    return f.groupBy(F.coalesce(kind, F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def build_counters(spark, sf):
    from strideframe.plans.build import enrichment_counts

    return enrichment_counts(b.scored_edges(spark, sf))


def node_degree(spark, sf):
    return ed.node_degree(b.edges(spark, sf))


def demo_facilities(spark, sf):
    from strideframe.sources.synthetic import facility_pick

    return rounded(facility_pick(fx.road_node(spark, sf)), "lat", "lon").select("node_id", "type", "lat", "lon")


QUERIES = {f.__name__: f for f in (
    top_scored_edges, edge_collapse, edge_midpoints, point_cells, edge_density, elevation_survey, elevation_raster,
    elevation_priority, widths_by_name, edge_width, edge_green, edge_enriched, edge_rfs_profiles, routing_weights,
    route_costs, score_bands, citywide_standing, citywide_sample, sanity_report, facility_counts, build_counters,
    node_degree, demo_facilities)}

def _h(*parts: str) -> str:
    text = " || '|' || ".join(p if p.startswith("'") else f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(sha256({text}), 1, 8)) AS BIGINT) / {D(4294967296.0)})"


_MEAN = "COALESCE(SUM(CAST(round_even(sc.rfs * 1000000, 0) AS BIGINT)) / (COUNT(sc.rfs) * CAST(1000000 AS DOUBLE)), 0)"
_RIVER = "((i + ni) / 2 BETWEEN 8 AND 14)"
_HILL = "((i + ni) / 2 > 42 AND (j + nj) / 2 > 42)"
_four = ", ".join(f"{r(weight(t == 'n', h == 'h'))} AS w_{t}{h}" for t in "dn" for h in "fh")
_rfs4 = ", ".join(f"{r(rfs(t == 'n', h == 'h'))} AS rfs_{t}{h}" for t in "dn" for h in "fh")
_w_df = weight(False, False)
from strideframe.catalog.sqltext import density, slope_score as _ss  # noqa: E402

ORACLES = {
    "top_scored_edges": sql(f"SELECT u, v, {r('length_m')} AS length_m, highway, {r(rfs())} AS rfs FROM edge_scored ORDER BY rfs DESC, u, v LIMIT 20"),
    "edge_collapse": sql(f"SELECT u, v, {r('length_m')} AS length_m, highway, lit, name, sidewalk_score, crossing_score, lighting_score, cctv_score, park_score, slope_pct FROM edge"),
    "edge_midpoints": sql(f"SELECT u, v, {r('mid_lat')} AS mid_lat, {r('mid_lon')} AS mid_lon FROM edge_mid"),
    "point_cells": sql(f"SELECT kind, {cell('lat', 0.001)} AS ci, {cell('lon', 0.001)} AS cj, COUNT(*) AS n FROM point_feature GROUP BY 1, 2, 3"),
    "edge_density": sql(f"SELECT u, v, {r(density('n_signal', 3))} AS signal_density, {r(density('n_light', 2))} AS light_density, {r(density('n_cctv', 3))} AS cctv_density FROM edge_counts"),
    "elevation_survey": sql(f"SELECT {r('n.lat')} AS lat, {r('n.lon')} AS lon, {r('surveyed')} AS surveyed FROM survey_elev JOIN road_node n USING (node_id)"),
    "elevation_raster": sql(f"SELECT node_id, {r('elev')} AS elev FROM raster_elev"),
    "elevation_priority": sql(f"SELECT node_id, {r('elev_m', 1)} AS elev, is_surveyed FROM node_elev"),
    "widths_by_name": sql(f"""SELECT name_key, {r('width_m')} AS width_m, {r(f"CASE WHEN width_m >= 2 THEN {D(1.0)} WHEN width_m <= 1 THEN {D(0.3)} ELSE {D(0.3)} + {D(0.7)} * (width_m - {D(1.0)}) END")} AS width_score FROM name_width"""),
    "edge_width": sql(f"SELECT u, v, name, {r('width_m')} AS width_m FROM edge LEFT JOIN name_width ON name_key = regexp_replace(COALESCE(name, ''), '\\s+', '', 'g')"),
    "edge_green": sql("SELECT u, v FROM green_hit"),
    "edge_enriched": sql("SELECT u, v, " + ", ".join(f"{r(c)} AS {c}" for c in SCORE_COLS) + " FROM edge_scored"),
    "edge_rfs_profiles": sql(f"SELECT u, v, {_rfs4}, {r(_ss('slope_pct', False))} AS slope_flat, {r(_ss('slope_pct', True))} AS slope_hills FROM edge_scored"),
    "routing_weights": sql(f"SELECT u, v, {_four} FROM edge_scored"),
    "route_costs": sql(f"SELECT u, v, {r(followable(_w_df))} AS follow_weight, {r(main_road_cost())} AS main_road_cost, {r(f'length_m * {main_road_cost()}')} AS road_weight FROM edge_scored"),
    "score_bands": sql(f"SELECT CASE WHEN s >= 0.62 THEN 'green' WHEN s >= 0.48 THEN 'amber' ELSE 'red' END AS band, COUNT(*) AS n FROM (SELECT {r(rfs())} AS s FROM edge_scored) GROUP BY 1"),
    "citywide_standing": sql(f"""WITH sc AS MATERIALIZED (SELECT u, v, {r(rfs())} AS rfs FROM edge_scored), pos AS (SELECT *, ROW_NUMBER() OVER (ORDER BY u, v) - 1 AS p FROM sc),
      smp AS (SELECT rfs FROM pos WHERE p % greatest(1, (SELECT COUNT(*) FROM sc) // 20000) = 0)
      SELECT u, v, CAST(greatest(1, round_even(100 * (1 - (SELECT COUNT(*) FROM smp WHERE smp.rfs < sc.rfs) / (SELECT COUNT(*) FROM smp)), 0)) AS INTEGER) AS top_percent FROM sc"""),
    "citywide_sample": sql(f"WITH sc AS (SELECT u, v, {r(rfs())} AS rfs FROM edge_scored) SELECT u, v, rfs, ROW_NUMBER() OVER (ORDER BY rfs, u, v) - 1 AS position FROM sc"),
    "sanity_report": sql(f"""WITH sc AS MATERIALIZED (SELECT *, {r(rfs())} AS rfs FROM edge_scored),
      q AS (SELECT rfs AS q80 FROM (SELECT rfs, ROW_NUMBER() OVER (ORDER BY rfs) - 1 AS p, COUNT(*) OVER () AS n FROM sc) WHERE p = n * 4 // 5)
      SELECT spot_id, CAST(COUNT(sc.u) AS BIGINT) AS n_edges, {r(_MEAN)} AS mean_rfs, {r('MAX(q80)')} AS q80,
        CASE WHEN {r(_MEAN)} >= {r(f'MAX(q80) * {D(0.9)}')} THEN 'PASS' ELSE 'CHECK' END AS verdict
      FROM (SELECT poly_id AS spot_id, lat, lon FROM green_polygon_vertex WHERE seq = 0) s CROSS JOIN q
      LEFT JOIN sc ON abs(sc.u_lat - s.lat) < 0.009 AND abs(sc.u_lon - s.lon) < 0.011 GROUP BY spot_id"""),
    "facility_counts": sql("SELECT COALESCE(CASE WHEN point_id % 10 = 0 THEN NULL ELSE facility_type END, 'unknown') AS type, COUNT(*) AS n FROM point_feature WHERE kind = 'facility' GROUP BY 1"),
    "build_counters": sql("""SELECT COUNT(*) AS edges, CAST(SUM(CAST(slope_known AS INT)) AS BIGINT) AS slope_edges, CAST(SUM(CAST(slope_surveyed AS INT)) AS BIGINT) AS slope_surveyed_edges,
      CAST(COUNT(width_m) AS BIGINT) AS width_edges, CAST(SUM(CASE WHEN park_score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS park_edges FROM edge_scored"""),
    "node_degree": sql("SELECT node_id, COUNT(*) AS degree FROM (SELECT u AS node_id FROM edge UNION ALL SELECT v FROM edge) GROUP BY 1"),
    "demo_facilities": sql(f"""SELECT node_id, CASE CAST(floor(h * 1000000) AS BIGINT) % 4 WHEN 0 THEN 'convenience_store' WHEN 1 THEN 'restroom' WHEN 2 THEN 'water' ELSE 'park' END AS type,
        {r('lat')} AS lat, {r('lon')} AS lon FROM (SELECT *, {_h("'poi'", 'node_id')} AS h FROM road_node) WHERE h >= 0.985"""),
}
