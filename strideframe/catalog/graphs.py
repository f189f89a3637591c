"""Queries over the network as a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe import fixtures as fx
from strideframe.catalog import base as b
from strideframe.catalog.base import rounded
from strideframe.catalog.sqltext import D, cell, followable, mlon, r, weight
from strideframe.functions import score
from strideframe.operators import cells, graph
from strideframe.plans import loops
from strideframe.session import cut


def components(spark, sf):
    return graph.components(fx.road_node(spark, sf), b.edges(spark, sf).select("u", "v"))


def largest_component(spark, sf):
    return graph.largest_component(components(spark, sf)).select("node_id")


PROFILES = {"w_df": (False, False), "w_dh": (False, True), "w_nf": (True, False), "w_nh": (True, True)}


def by_profile(search, arcs):
    """The routing weight of the search's profile, made followable."""
    yield arcs[loops.profile_column(search)]


def follow_weights():
    return {f"f_{n[2:]}": score.followable_weight(score.routing_weight(*p)) for n, p in PROFILES.items()}


def searches(spark, sf):
    """One search per green centre within about 500 m, with mixed profiles."""
    n, _ = fx.grid(spark, sf)
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("search_id"), (F.col("s_suppkey") * 131 % n).alias("source"))
    at = fx.road_node(spark, sf).select(F.col("node_id").alias("source"), "lat", "lon")
    return s.join(at, "source").withColumns(cells.area_box(F.lit(500.0))).withColumns(
        {"night": F.col("search_id") % 2 == 0, "hills": F.col("search_id") % 3 == 0})


def _solved(spark, sf):
    s = cut(searches(spark, sf))
    adj = graph.adjacency(b.scored_edges(spark, sf), fx.road_node(spark, sf), follow_weights())
    return s, graph.shortest_paths(s, adj, by_profile, loops.PROFILE_COLUMNS)


def shortest_paths(spark, sf):
    _, tree = _solved(spark, sf)
    return rounded(tree, "d", digits=4).select("search_id", "node", "d")


def shortest_trees(spark, sf):
    _, tree = _solved(spark, sf)
    return tree.where("parent IS NOT NULL").select("search_id", "node", "parent")


def recovered_paths(spark, sf):
    """The path of every search to its highest reached node."""
    _, tree = _solved(spark, sf)
    targets = tree.groupBy("search_id").agg(F.max("node").alias("target")).withColumn("leg_id", F.lit(0))
    return graph.recover_paths(tree, targets).select("search_id", "seq", "node_id")


QUERIES = {f.__name__: f for f in (components, largest_component, shortest_paths, shortest_trees, recovered_paths)}

GRAPH_SQL = {
    "cut_edge": "SELECT u AS a, v AS b FROM edge UNION ALL SELECT v, u FROM edge",
    "weighted": f"SELECT u, v, {', '.join(f'{followable(weight(*p))} AS f_{n[2:]}' for n, p in PROFILES.items())} FROM edge_scored",
    "arc": f"""SELECT a.node, a.far, a.f_df, a.f_dh, a.f_nf, a.f_nh, {cell('n.lat', 0.002)} AS ci, {cell('n.lon', 0.002)} AS cj FROM (SELECT u AS node, v AS far, * FROM weighted UNION ALL SELECT v, u, * FROM weighted) a JOIN road_node n ON n.node_id = a.far""",
    "searching": f"""SELECT s_suppkey AS search_id, n.node_id AS source, s_suppkey % 2 = 0 AS night, s_suppkey % 3 = 0 AS hills, {cell(f'(lat - {D(500.0)} / {D(110540.0)})', 0.002)} AS i_lo, {cell(f'(lat + {D(500.0)} / {D(110540.0)})', 0.002)} AS i_hi,
      {cell(f"(lon - {D(500.0)} / {mlon('lat')})", 0.002)} AS j_lo, {cell(f"(lon + {D(500.0)} / {mlon('lat')})", 0.002)} AS j_hi FROM supplier CROSS JOIN grid_dim g JOIN road_node n ON n.node_id = s_suppkey * 131 % g.n""",
}
_SP = """WITH RECURSIVE arcs AS MATERIALIZED (SELECT * FROM arc), se AS MATERIALIZED (SELECT * FROM searching),
  sp(s, n, d) USING KEY (s, n) AS (SELECT search_id, source, CAST(0 AS DOUBLE) FROM se
    UNION SELECT c.s, c.far, MIN(c.nd) FROM (SELECT sp.s, a.far, sp.d + CASE WHEN se.night AND se.hills THEN a.f_nh WHEN se.night THEN a.f_nf WHEN se.hills THEN a.f_dh ELSE a.f_df END AS nd
      FROM sp JOIN se ON se.search_id = sp.s JOIN arcs a ON a.node = sp.n AND a.ci BETWEEN se.i_lo AND se.i_hi AND a.cj BETWEEN se.j_lo AND se.j_hi) c
    LEFT JOIN recurring.sp x ON x.s = c.s AND x.n = c.far WHERE x.d IS NULL OR c.nd < x.d GROUP BY 1, 2),
  tr AS (SELECT s, n, MIN(p) AS parent FROM (SELECT v.s, v.n, a.node AS p FROM sp v JOIN se ON se.search_id = v.s JOIN arcs a ON a.far = v.n JOIN sp u ON u.s = v.s AND u.n = a.node
    WHERE v.n <> se.source AND u.d + CASE WHEN se.night AND se.hills THEN a.f_nh WHEN se.night THEN a.f_nf WHEN se.hills THEN a.f_dh ELSE a.f_df END = v.d) GROUP BY 1, 2)"""
_CC = """WITH RECURSIVE cc(n, label) USING KEY (n) AS (SELECT node_id, node_id FROM road_node
    UNION SELECT e.b, MIN(cc.label) FROM cc JOIN cut_edge e ON e.a = cc.n JOIN recurring.cc x ON x.n = e.b WHERE cc.label < x.label GROUP BY e.b)"""


def sql(body: str) -> str:
    return b.sql(body, GRAPH_SQL)


ORACLES = {
    "components": sql(_CC + " SELECT n AS node_id, label FROM cc"),
    "largest_component": sql(_CC + " SELECT n AS node_id FROM cc WHERE label = (SELECT label FROM cc GROUP BY label ORDER BY COUNT(*) DESC, label LIMIT 1)"),
    "shortest_paths": sql(_SP + f" SELECT s AS search_id, n AS node, {r('d', 4)} AS d FROM sp"),
    "shortest_trees": sql(_SP + " SELECT s AS search_id, n AS node, parent FROM tr"),
    "recovered_paths": sql(_SP + """, bk(s, n, back) AS (SELECT s, MAX(n), CAST(0 AS BIGINT) FROM sp GROUP BY s UNION ALL SELECT bk.s, tr.parent, bk.back + 1 FROM bk JOIN tr ON tr.s = bk.s AND tr.n = bk.n)
      SELECT s AS search_id, MAX(back) OVER (PARTITION BY s) - back AS seq, n AS node_id FROM bk"""),
}
