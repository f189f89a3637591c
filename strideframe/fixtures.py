"""Geo views over the sample tables.

The sample tables hold no coordinates, so a deterministic street grid, point
layers, paths and request tables are derived from them. `view(name)` builds the
Spark side; `VIEW_SQL` holds the same definitions as SQL text for DuckDB, which
`with_views` prepends to a query as CTEs.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAT0, LON0 = 37.45, 126.85
STEP_LAT, STEP_LON = 0.0007237, 0.0009063


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=32)
def _customers(sf_dir: str) -> int:
    return table(SparkSession.active(), sf_dir, "customer").count()


def grid(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(number of nodes, width of the grid); a count answered from Parquet footers."""
    n = _customers(sf_dir)
    return n, math.ceil(math.sqrt(n))


def road_node(spark, sf_dir):
    _, w = grid(spark, sf_dir)
    return spark.sql(f"""
        SELECT node_id, i, j, {LAT0}D + CAST(i AS DOUBLE) * {STEP_LAT}D AS lat,
               {LON0}D + CAST(j AS DOUBLE) * {STEP_LON}D AS lon,
               CASE WHEN node_id % 17 = 0 THEN NULL ELSE 20D + c_acctbal / 200D END AS elev
        FROM (SELECT c_custkey AS node_id, c_custkey DIV {w} AS i, c_custkey % {w} AS j, c_acctbal
              FROM {{customer}})""", customer=table(spark, sf_dir, "customer"))


def road_edge_raw(spark, sf_dir):
    n, w = grid(spark, sf_dir)
    return spark.sql(f"""
        SELECT u, v, 80D + l_quantity AS length_m,
               CASE (u * 7 + v) % 6 WHEN 0 THEN 'footway' WHEN 1 THEN 'residential' WHEN 2 THEN 'primary'
                    WHEN 3 THEN 'service' WHEN 4 THEN 'steps' ELSE 'cycleway' END AS highway,
               CASE (u + 3 * v) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS lit,
               p_name AS name
        FROM (SELECT l_orderkey % {n} AS u, l_quantity, l_partkey,
                     l_orderkey % {n} + CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE {w} END AS v
              FROM {{lineitem}})
        JOIN {{part}} ON p_partkey = l_partkey
        WHERE v < {n} AND NOT (v = u + 1 AND u % {w} = {w} - 1)""",
                     lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def point_feature(spark, sf_dir):
    _, w = grid(spark, sf_dir)
    return spark.sql(f"""
        SELECT event_id AS point_id,
               CASE event_type WHEN 'view' THEN 'streetlight' WHEN 'click' THEN 'pedestrian_signal'
                    WHEN 'error' THEN 'cctv' WHEN 'signup' THEN 'spot_height' ELSE 'facility' END AS kind,
               {LAT0}D + (CAST((event_id * 7919) % 100003 AS DOUBLE) / 100003D * 3.5D - 1.25D)
                       * CAST({w} AS DOUBLE) * {STEP_LAT}D AS lat,
               {LON0}D + (CAST((event_id * 104729) % 99991 AS DOUBLE) / 99991D * 3.5D - 1.25D)
                       * CAST({w} AS DOUBLE) * {STEP_LON}D AS lon,
               value,
               CASE user_id % 4 WHEN 0 THEN 'convenience_store' WHEN 1 THEN 'restroom'
                    WHEN 2 THEN 'water' ELSE 'park' END AS facility_type
        FROM {{events}}""", events=table(spark, sf_dir, "events"))


def course_path(spark, sf_dir):
    _, w = grid(spark, sf_dir)
    return spark.sql(f"""
        SELECT course_id, seq,
               (CASE WHEN seq < a THEN i0 + seq WHEN seq < a + b THEN i0 + a
                     WHEN seq < 2 * a + b THEN i0 + 2 * a + b - seq ELSE i0 END) * {w}
             + (CASE WHEN seq < a THEN j0 WHEN seq < a + b THEN j0 + seq - a
                     WHEN seq < 2 * a + b THEN j0 + b ELSE j0 + 2 * a + 2 * b - seq END) AS node_id
        FROM (SELECT *, explode(sequence(0L, 2 * a + 2 * b)) AS seq
              FROM (SELECT o_orderkey AS course_id, 2 + o_orderkey % 4 AS a, 2 + o_custkey % 5 AS b,
                           (o_custkey * 13 + o_orderkey) % ({w} - 7) AS i0,
                           (o_custkey * 29 + o_orderkey) % ({w} - 7) AS j0
                    FROM {{orders}}))""",
                     orders=table(spark, sf_dir, "orders"))


def gps_fix(spark, sf_dir):
    return spark.sql(f"""
        SELECT /*+ MERGE(p) */ event_id AS fix_id, user_id, ts, user_id * 10 AS course_id,
               n.lat + (CAST(event_id % 41 AS DOUBLE) - 20D) * 0.00006D AS lat, n.lon AS lon,
               value AS accuracy_m
        FROM {{events}} JOIN {{path}} p ON p.course_id = user_id * 10 AND p.seq = event_id % 9
        JOIN {{node}} n ON n.node_id = p.node_id""", events=table(spark, sf_dir, "events"),
                     path=course_path(spark, sf_dir), node=road_node(spark, sf_dir))


def completion(spark, sf_dir):
    return spark.sql("""
        SELECT event_id AS completion_id, user_id, ts, event_id % 12 AS course_key,
               CASE event_id % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'rabbit' ELSE 'whale' END AS shape,
               concat('place_', CAST((event_id % 12 - event_id % 4) DIV 4 AS STRING)) AS place
        FROM {events} WHERE event_type IN ('purchase', 'signup')""",
                     events=table(spark, sf_dir, "events"))


def course_request(spark, sf_dir):
    return spark.sql("""
        SELECT o_orderkey AS request_id, n.lat AS lat, n.lon AS lon,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 AS DOUBLE) END AS distance_km,
               CASE WHEN o_orderkey % 10 = 0 THEN CAST(20 + o_orderkey % 40 AS DOUBLE) END AS duration_min,
               o_orderpriority LIKE '1%' AS include_hills, o_orderstatus = 'F' AS night_mode
        FROM {orders} JOIN {node} n ON n.node_id = o_custkey""",
                     orders=table(spark, sf_dir, "orders"), node=road_node(spark, sf_dir))


def width_report(spark, sf_dir):
    return spark.sql("""
        SELECT concat(substr(p_name, 1, 3), ' ', substr(p_name, 4)) AS route_name,
               CAST(p_size AS DOUBLE) / 20D AS width_m FROM {part}""",
                     part=table(spark, sf_dir, "part"))


def green_polygon_vertex(spark, sf_dir):
    n, _ = grid(spark, sf_dir)
    return spark.sql(f"""
        SELECT s_suppkey AS poly_id, k AS seq,
               c.lat + CASE k % 4 WHEN 0 THEN -0.001D WHEN 1 THEN -0.0006D WHEN 2 THEN 0.001D ELSE 0.0004D END AS lat,
               c.lon + CASE k % 4 WHEN 0 THEN -0.0008D WHEN 1 THEN 0.0012D WHEN 2 THEN 0.0005D ELSE -0.001D END AS lon
        FROM (SELECT s_suppkey, explode(sequence(0L, 4L)) AS k FROM {{supplier}})
        JOIN {{node}} c ON c.node_id = (s_suppkey * 131) % {n}""",
                     supplier=table(spark, sf_dir, "supplier"), node=road_node(spark, sf_dir))


def raster_cell(spark, sf_dir):
    return spark.sql("""
        SELECT p_partkey DIV 40 AS r, p_partkey % 40 AS c,
               CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE CAST(10 + p_size AS DOUBLE) END AS elev
        FROM {part}""", part=table(spark, sf_dir, "part"))


def request_log(spark, sf_dir):
    return spark.sql("""
        SELECT l_orderkey AS request_id,
               CASE l_returnflag WHEN 'A' THEN 'course' WHEN 'N' THEN 'art' ELSE 'facility' END AS tool,
               l_suppkey AS client_id, l_shipdate AS ts, l_extendedprice / 100D AS latency_ms
        FROM {lineitem}""", lineitem=table(spark, sf_dir, "lineitem"))


# SQL text of the same views for DuckDB; order matters, later ones may use earlier ones.
VIEW_SQL: dict[str, str] = {
    "k": "SELECT range AS id FROM range(64)",
    "grid_dim": "SELECT COUNT(*) AS n, CAST(CEIL(SQRT(COUNT(*))) AS BIGINT) AS w FROM customer",
    "road_node": """SELECT c_custkey AS node_id, CAST((c_custkey - c_custkey % g.w) / g.w AS BIGINT) AS i, c_custkey % g.w AS j,
  CAST(37.45 AS DOUBLE) + CAST((c_custkey - c_custkey % g.w) / g.w AS DOUBLE) * CAST(0.0007237 AS DOUBLE) AS lat,
  CAST(126.85 AS DOUBLE) + CAST(c_custkey % g.w AS DOUBLE) * CAST(0.0009063 AS DOUBLE) AS lon,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(20 AS DOUBLE) + c_acctbal / CAST(200 AS DOUBLE) END AS elev
FROM customer CROSS JOIN grid_dim g""",
    "road_edge_raw": """SELECT u, v, CAST(80 AS DOUBLE) + l_quantity AS length_m,
  CASE (u * 7 + v) % 6 WHEN 0 THEN 'footway' WHEN 1 THEN 'residential' WHEN 2 THEN 'primary' WHEN 3 THEN 'service' WHEN 4 THEN 'steps' ELSE 'cycleway' END AS highway,
  CASE (u + 3 * v) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULL END AS lit, p_name AS name
FROM (SELECT l_orderkey % g.n AS u, l_orderkey % g.n + CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE g.w END AS v, l_quantity, l_partkey, g.n AS n, g.w AS w FROM lineitem CROSS JOIN grid_dim g) r
JOIN part ON p_partkey = l_partkey
WHERE v < n AND NOT (v = u + 1 AND u % w = w - 1)""",
    "point_feature": """SELECT event_id AS point_id,
  CASE event_type WHEN 'view' THEN 'streetlight' WHEN 'click' THEN 'pedestrian_signal' WHEN 'error' THEN 'cctv' WHEN 'signup' THEN 'spot_height' ELSE 'facility' END AS kind,
  CAST(37.45 AS DOUBLE) + (CAST((event_id * 7919) % 100003 AS DOUBLE) / CAST(100003 AS DOUBLE) * CAST(3.5 AS DOUBLE) - CAST(1.25 AS DOUBLE)) * CAST(g.w AS DOUBLE) * CAST(0.0007237 AS DOUBLE) AS lat,
  CAST(126.85 AS DOUBLE) + (CAST((event_id * 104729) % 99991 AS DOUBLE) / CAST(99991 AS DOUBLE) * CAST(3.5 AS DOUBLE) - CAST(1.25 AS DOUBLE)) * CAST(g.w AS DOUBLE) * CAST(0.0009063 AS DOUBLE) AS lon,
  value, CASE user_id % 4 WHEN 0 THEN 'convenience_store' WHEN 1 THEN 'restroom' WHEN 2 THEN 'water' ELSE 'park' END AS facility_type
FROM events CROSS JOIN grid_dim g""",
    "course_path": """SELECT o.course_id, CAST(k.id AS BIGINT) AS seq,
  (CASE WHEN k.id < a THEN i0 + k.id WHEN k.id < a + b THEN i0 + a WHEN k.id < 2 * a + b THEN i0 + 2 * a + b - k.id ELSE i0 END) * w
  + (CASE WHEN k.id < a THEN j0 WHEN k.id < a + b THEN j0 + k.id - a WHEN k.id < 2 * a + b THEN j0 + b ELSE j0 + 2 * a + 2 * b - k.id END) AS node_id
FROM (SELECT o_orderkey AS course_id, 2 + o_orderkey % 4 AS a, 2 + o_custkey % 5 AS b, (o_custkey * 13 + o_orderkey) % (g.w - 7) AS i0, (o_custkey * 29 + o_orderkey) % (g.w - 7) AS j0, g.w AS w FROM orders CROSS JOIN grid_dim g) o
JOIN k ON k.id <= 2 * a + 2 * b""",
    "gps_fix": """SELECT event_id AS fix_id, user_id, ts, user_id * 10 AS course_id, n.lat + (CAST(event_id % 41 AS DOUBLE) - CAST(20 AS DOUBLE)) * CAST(0.00006 AS DOUBLE) AS lat, n.lon AS lon, value AS accuracy_m
FROM events JOIN course_path p ON p.course_id = user_id * 10 AND p.seq = event_id % 9 JOIN road_node n ON n.node_id = p.node_id""",
    "completion": """SELECT event_id AS completion_id, user_id, ts, event_id % 12 AS course_key, CASE event_id % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'rabbit' ELSE 'whale' END AS shape, CONCAT('place_', CAST(CAST((event_id % 12 - event_id % 4) / 4 AS BIGINT) AS VARCHAR(20))) AS place
FROM events WHERE event_type IN ('purchase', 'signup')""",
    "course_request": """SELECT o_orderkey AS request_id, n.lat AS lat, n.lon AS lon, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 AS DOUBLE) END AS distance_km, CASE WHEN o_orderkey % 10 = 0 THEN CAST(20 + o_orderkey % 40 AS DOUBLE) END AS duration_min, o_orderpriority LIKE '1%' AS include_hills, o_orderstatus = 'F' AS night_mode
FROM orders JOIN road_node n ON n.node_id = o_custkey""",
    "width_report": """SELECT CONCAT(SUBSTR(p_name, 1, 3), ' ', SUBSTR(p_name, 4)) AS route_name, CAST(p_size AS DOUBLE) / CAST(20 AS DOUBLE) AS width_m FROM part""",
    "green_polygon_vertex": """SELECT s_suppkey AS poly_id, CAST(k.id AS BIGINT) AS seq, c.lat + CASE k.id % 4 WHEN 0 THEN CAST(-0.001 AS DOUBLE) WHEN 1 THEN CAST(-0.0006 AS DOUBLE) WHEN 2 THEN CAST(0.001 AS DOUBLE) ELSE CAST(0.0004 AS DOUBLE) END AS lat, c.lon + CASE k.id % 4 WHEN 0 THEN CAST(-0.0008 AS DOUBLE) WHEN 1 THEN CAST(0.0012 AS DOUBLE) WHEN 2 THEN CAST(0.0005 AS DOUBLE) ELSE CAST(-0.001 AS DOUBLE) END AS lon
FROM supplier CROSS JOIN grid_dim g JOIN road_node c ON c.node_id = (s_suppkey * 131) % g.n JOIN k ON k.id <= 4""",
    "raster_cell": """SELECT CAST((p_partkey - p_partkey % 40) / 40 AS BIGINT) AS r, p_partkey % 40 AS c, CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE CAST(10 + p_size AS DOUBLE) END AS elev FROM part""",
    "request_log": """SELECT l_orderkey AS request_id, CASE l_returnflag WHEN 'A' THEN 'course' WHEN 'N' THEN 'art' ELSE 'facility' END AS tool, l_suppkey AS client_id, l_shipdate AS ts, l_extendedprice / CAST(100 AS DOUBLE) AS latency_ms FROM lineitem""",
}


def with_ctes(ctes: dict[str, str], body: str, recursive: bool = False) -> str:
    """body with every CTE it (transitively) names put in front, in dictionary order."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_][a-z_0-9]*", text))
        for name in ctes:
            if name in words and name not in needed:
                needed.add(name)
                visit(ctes[name])

    visit(body)
    head = [f"{name} AS ({ctes[name]})" for name in ctes if name in needed]
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        recursive, stripped = True, stripped[len("WITH RECURSIVE"):].lstrip()
        head_tail = ", "
    elif stripped.upper().startswith("WITH "):
        stripped = stripped[5:].lstrip()
        head_tail = ", "
    else:
        head_tail = "\n"
    if not head:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(head) + head_tail + stripped
