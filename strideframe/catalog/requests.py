"""Queries over places, presets, requests, exports and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe import fixtures as fx
from strideframe.catalog import base as b
from strideframe.catalog.base import rounded
from strideframe.catalog.paths import PATH_SQL, _W, located
from strideframe.catalog.sqltext import D, equi, hav, r
from strideframe.functions import geo, text
from strideframe.operators import activity, paths, presets
from strideframe.sources import exports
from strideframe.sources import shapes as cat

# Our own small gazetteer, in lookup order.
GAZETTEER = [("시청", 37.4512, 126.8531), ("한강공원", 37.4601, 126.8702), ("서울숲", 37.4644, 126.8774), ("강남", 37.4479, 126.8676),
             ("여의도", 37.4719, 126.8645), ("호수공원", 37.4551, 126.8590)]
GAZ_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {D(a)}, {D(o)})" for i, (n, a, o) in enumerate(GAZETTEER)) + ") t(pos, name, lat, lon)"

STATION = """SELECT s_suppkey AS station_seq, CAST(s_suppkey % 8 + 1 AS {str}) AS line,
  CASE s_suppkey % 4 WHEN 0 THEN concat('역삼', CAST(s_suppkey % 37 AS {str}), '(남부)') WHEN 1 THEN concat('신설', CAST(s_suppkey % 37 AS {str}), '역')
       WHEN 2 THEN concat('잠실', CAST(s_suppkey % 37 AS {str})) ELSE '서울' END AS official_name,
  n.lat AS lat, n.lon AS lon,
  concat('서울특별시 중구 세종대로 지하', CAST(s_suppkey AS {str}), '(정동)') AS road_address,
  concat('서울특별시 중구 정동 ', CAST(s_suppkey AS {str}), '-5 시청역(', CAST(s_suppkey % 8 + 1 AS {str}), '호선)') AS lot_address"""
ADDRESS = """SELECT c_custkey AS query_id, CASE c_custkey % 9 WHEN 0 THEN concat(' 테헤란로 8길  ', CAST(c_custkey % 90 AS {str}))
  WHEN 1 THEN concat('신설동 76-', CAST(c_custkey % 50 AS {str})) WHEN 2 THEN concat('서울 중구 세종대로 ', CAST(c_custkey % 200 AS {str}))
  WHEN 3 THEN concat('서울시 종로구 관철동 ', CAST(c_custkey % 30 AS {str}), '-14') WHEN 4 THEN concat('잠실', CAST(c_custkey % 37 AS {str}))
  WHEN 5 THEN '한강공원' WHEN 6 THEN concat('강남 맛집', CAST(c_custkey % 5 AS {str})) WHEN 7 THEN concat('송파구 올림픽로 ', CAST(c_custkey % 300 AS {str}), '번지')
  ELSE concat('5호선 신설', CAST(c_custkey % 37 AS {str}), '역') END AS location"""
PRESET = """SELECT lat, lon, shape, name, (station_seq + pos) % 3 <> 0 AS available,
  CASE WHEN (station_seq + pos) % 3 <> 0 THEN CAST(3000 + (station_seq * 37 + pos * 11) % 60 * 100 AS DOUBLE) END AS length_m,
  CASE WHEN (station_seq + pos) % 3 <> 0 THEN CAST(3 + floor((station_seq * 37 + pos * 11) % 60 / 10) AS DOUBLE) END AS distance_km,
  CASE WHEN (station_seq + pos) % 3 <> 0 THEN CAST(70 + (station_seq * 13 + pos * 7) % 30 AS DOUBLE) / CAST(100 AS DOUBLE) END AS similarity"""


def stations(spark, sf):
    n, _ = fx.grid(spark, sf)
    return spark.sql(STATION.format(str="STRING") + f" FROM {{supplier}} JOIN {{node}} n ON n.node_id = (s_suppkey * 131) % {n}",
                     supplier=fx.table(spark, sf, "supplier"), node=fx.road_node(spark, sf))


def address_queries(spark, sf):
    return spark.sql(ADDRESS.format(str="STRING") + " FROM {customer}", customer=fx.table(spark, sf, "customer"))


def preset_table(spark, sf):
    """Stations x shapes with results for six of seven stations."""
    unique = presets.unique_by_place(stations(spark, sf)).where("station_seq % 7 <> 0")
    unique = unique.select("station_seq", geo.half_even(F.col("lat"), 5).alias("lat"), geo.half_even(F.col("lon"), 5).alias("lon"),
                           text.station_name(F.col("official_name")).alias("name"))
    rows = presets.per_shape(unique, cat.SHAPES).withColumnRenamed("position", "pos")
    return spark.sql(PRESET + " FROM {rows}", rows=rows)


def shape_requests(spark, sf):
    """Course requests with a shape, start rounded to the preset grid."""
    q = fx.course_request(spark, sf)
    shape = F.get(F.array(*map(F.lit, cat.SHAPES)), (F.col("request_id") % 5).cast("int"))  # every fifth has none
    need = F.when(F.col("request_id") % 11 == 0, F.array(F.lit("restroom")))
    return q.select("request_id", geo.half_even(F.col("lat"), 5).alias("lat"), geo.half_even(F.col("lon"), 5).alias("lon"),
                    F.coalesce("distance_km", F.lit(5.0)).alias("distance_km"), "include_hills", "night_mode",
                    F.when(F.col("request_id") % 5 < 4, shape).alias("shape"), need.alias("need_facilities"))


def station_unique(spark, sf):
    return rounded(presets.unique_by_place(stations(spark, sf)), "lat", "lon").select("lat", "lon", "station_seq", "line", "official_name")


def station_lookup(spark, sf):
    return rounded(presets.alias_lookup(stations(spark, sf)), "lat", "lon")


def address_variants(spark, sf):
    q = address_queries(spark, sf)
    return q.select("query_id", F.posexplode(text.address_variants(F.col("location"))).alias("position", "variant"))


def address_shape(spark, sf):
    q = address_queries(spark, sf)
    return q.select("query_id", text.looks_like_address(F.col("location")).alias("is_address"), text.query_key(F.col("location")).alias("query_key"))


def place_labels(spark, sf):
    p = fx.table(spark, sf, "part")
    raw = F.concat("p_name", F.lit(" [*"), "p_brand", F.lit("*]\t(#1) "), F.repeat("p_type", 8), F.lit(" + `x` | {y}! - 1.5 <z>_\\"))
    return p.select("p_partkey", text.label(raw).alias("label"))


def location_cascade(spark, sf):
    q = address_queries(spark, sf)
    n = fx.road_node(spark, sf).select(F.col("node_id").alias("query_id"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    has = F.col("query_id") % 10 == 0
    full = q.join(n, "query_id").select(
        "query_id", F.when(F.col("query_id") % 20 != 0, F.when(F.col("query_id") % 13 != 0, F.col("location"))).alias("location"),
        F.when(has, F.when(F.col("query_id") % 30 == 0, F.col("nlat") + 1).otherwise(F.col("nlat"))).alias("lat"), F.when(has, F.col("nlon")).alias("lon"))
    return rounded(presets.resolve_locations(full, GAZETTEER, stations(spark, sf)), "lat", "lon")


def request_defaults(spark, sf):
    from strideframe.plans.requests import with_defaults

    return with_defaults(fx.course_request(spark, sf)).select("request_id", "distance_km", "note")


def canonical_requests(spark, sf):
    q = shape_requests(spark, sf)
    need = F.when(F.col("request_id") % 3 == 0, F.array(F.lit("water"), F.lit("cafe"), F.lit("park"), F.lit("water"))).otherwise(F.col("need_facilities"))
    canon = text.canonical_facilities(need)
    ident = text.course_identity(F.col("lat"), F.col("lon"), F.lit(None), F.col("distance_km"), F.col("include_hills"), F.col("night_mode"), F.col("shape"), canon)
    return q.select("request_id", geo.half_even(F.col("distance_km"), 2).alias("distance_km"), F.array_join(canon, ",").alias("facilities"), ident.alias("course_ref"))


def request_keys(spark, sf):
    q = shape_requests(spark, sf).where("shape IS NOT NULL")
    token = F.when(F.col("request_id") % 9 == 0, F.concat("shape", F.lit("-99k"))).otherwise(text.shape_token(F.col("shape"), F.col("distance_km")))
    s, km = text.parse_shape_token(token)
    return q.select("request_id", text.preset_key(F.col("lat"), F.col("lon"), F.col("shape")).alias("preset_key"), token.alias("token"), s.alias("token_shape"), km.alias("token_km"))


def request_patches(spark, sf):
    from strideframe.plans.requests import refine

    base = shape_requests(spark, sf).select("request_id", "distance_km", "include_hills", "night_mode", "shape")
    rid = F.col("request_id")
    patch = base.select("request_id", F.when(rid % 2 == 0, 8.0).alias("distance_km"), F.when(rid % 3 == 0, ~F.col("include_hills")).alias("include_hills"),
                        F.lit(None).cast("boolean").alias("night_mode"), F.when(rid % 7 == 0, "none").when(rid % 7 == 1, "whale").alias("shape"))
    return refine(base, patch)


def preset_lookup(spark, sf):
    return presets.lookup(shape_requests(spark, sf), preset_table(spark, sf)).select("request_id", "outcome", "preset_name", "length_m")


def _spots(spark, sf):
    p = fx.point_feature(spark, sf).where("kind = 'facility'")
    return p.select("point_id", "lat", "lon", F.get(F.array(*map(F.lit, cat.SHAPES)), (F.col("point_id") % 4).cast("int")).alias("shape"))


def presets_nearby(spark, sf):
    near = presets.nearby(_spots(spark, sf), preset_table(spark, sf))
    facts = presets.move_facts(F.col("distance_m"))
    return rounded(near.withColumns(facts), "lat", "lon", "p_lat", "p_lon").select("lat", "lon", "shape", "p_lat", "p_lon", "distance_m", "move_m", "walk_min", "is_exact")


def preset_nearest(spark, sf):
    s = _spots(spark, sf)
    hit = presets.nearest(s, preset_table(spark, sf))
    return s.join(hit, ["lat", "lon", "shape"]).select("point_id", "preset_name", "distance_m")


def preset_relocation(spark, sf):
    s = _spots(spark, sf)
    return s.join(presets.relocation(s, preset_table(spark, sf)), ["lat", "lon", "shape"]).select("point_id", "similarity", "distance_m")


def preset_survey(spark, sf):
    q = shape_requests(spark, sf)
    places = q.select(F.col("request_id").alias("place_id"), "lat", "lon", F.when(F.col("request_id") % 2 == 0, F.col("distance_km")).alias("wanted_km"))
    return presets.survey(places, preset_table(spark, sf), cat.SURVEY_SHAPES).select("place_id", "shape", "source", "length_m", "distance_m", "featured")


def distance_decision(spark, sf):
    q = shape_requests(spark, sf).where("shape IS NOT NULL")
    return presets.distance_decision(q, preset_table(spark, sf)).select("request_id", "decision")


def remaining_jobs(spark, sf):
    st = presets.unique_by_place(stations(spark, sf)).select(geo.half_even(F.col("lat"), 5).alias("lat"), geo.half_even(F.col("lon"), 5).alias("lon"))
    done = preset_table(spark, sf)
    jobs = presets.remaining_work(st, cat.SHAPES, done).withColumn("retry", F.lit(False))
    return jobs.unionByName(presets.remaining_work(st, cat.SHAPES, done, True).withColumn("retry", F.lit(True)))


def preset_inventory(spark, sf):
    return presets.inventory(preset_table(spark, sf))


def shape_usage(spark, sf):
    """The shape catalogue with the requests that name each shape."""
    used = shape_requests(spark, sf).groupBy("shape").agg(F.count("*").alias("requests"))
    return cat.catalogue(spark).join(used, "shape", "left").fillna(0, ["requests"]).select("position", "shape", "min_km", "requests")


def distance_probes(spark, sf):
    from strideframe.plans.requests import probe_order

    q = shape_requests(spark, sf).where("shape IS NOT NULL")
    start = F.greatest(F.col("distance_km"), F.lit(3.0))
    return q.select("request_id", F.posexplode(probe_order(start, F.col("shape"))).alias("position", "km"))


def tolerant_best(spark, sf):
    """Candidates in probe order folded with the 0.015 tolerance rule."""
    from strideframe.plans.requests import tolerant_pick

    p = preset_table(spark, sf).where("available").select("name", "lat", "lon", F.struct(
        F.floor(geo.half_even(F.col("length_m") / 100.0)).cast("long").alias("ord"), F.col("similarity").alias("sim"), (F.col("length_m") / 1000.0).alias("km"), F.col("shape").alias("tag")).alias("c"))
    best = p.groupBy("lat", "lon").agg(tolerant_pick(F.array_sort(F.collect_list("c"))).alias("b"))  # one candidate per shape of the catalogue
    return best.select("lat", "lon", "b.sim", "b.km", "b.tag")


def alternative_shapes(spark, sf):
    from strideframe.plans.requests import alternatives

    p = preset_table(spark, sf).where("available")
    asked = shape_requests(spark, sf).where("shape IS NOT NULL").select("request_id", "lat", "lon", "shape", "distance_km")
    return alternatives(asked, p)


def gpx_export(spark, sf):
    line = located(spark, sf)
    names = line.df.groupBy("course_id").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("Loop <"), F.col("course_id").cast("string"), F.lit("> & 'co'")))
    return exports.gpx_lines(line, names)


def route_json(spark, sf):
    return exports.route_json(located(spark, sf))


def atlas_export(spark, sf):
    return exports.atlas_rows(preset_table(spark, sf))


def build_manifest(spark, sf):
    from strideframe.plans.build import enrichment_counts

    return exports.manifest(enrichment_counts(b.scored_edges(spark, sf)), {"green": "polygons", "cctv": "points"}, "2026-01-01", False)


def map_clusters(spark, sf):
    st = presets.unique_by_place(stations(spark, sf)).withColumn("courses", F.col("station_seq") % 4 + 1)
    return rounded(activity.map_clusters(st), "lat", "lon", digits=4)


def passport(spark, sf):
    return activity.passport_summary(fx.completion(spark, sf))


def passport_runs(spark, sf):
    return activity.latest_runs(fx.completion(spark, sf), 5).select("user_id", "course_key", "completion_id", "back")


def relay(spark, sf):
    legs, rejected = activity.relay_legs(fx.completion(spark, sf))
    n = rejected.groupBy("user_id").agg(F.count("*").alias("rejected"))
    return legs.groupBy("user_id").agg(F.first("shape").alias("shape"), F.count("*").alias("legs"), F.max("course_key").alias("top_course")).join(
        n, "user_id", "left").fillna(0, ["rejected"])


def undone_courses(spark, sf):
    """Users' courses of the catalogue they have not completed."""
    c = fx.completion(spark, sf)
    users = c.select("user_id").distinct().withColumn("course_key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return users.join(c.select("user_id", "course_key").distinct(), ["user_id", "course_key"], "left_anti")


def facility_merge(spark, sf):
    f = fx.point_feature(spark, sf)
    one = f.where("kind = 'facility'").select(F.col("point_id").alias("facility_id"), F.col("facility_type").alias("type"), F.lit("a").alias("name"), "lat", "lon")
    two = one.select((F.col("facility_id") + 1000000).alias("facility_id"), "type", F.lit("b").alias("name"), (F.col("lat") + 0.0000001).alias("lat"),
                     F.when(F.col("facility_id") % 3 == 0, F.col("lon") + 0.01).when(F.col("facility_id") % 3 == 1, F.col("lon")).alias("lon"))
    return rounded(activity.merge_facilities(one, two), "lat", "lon", digits=5)


def weekly_recommendation(spark, sf):
    n, w = fx.grid(spark, sf)
    c = activity.latest_runs(fx.completion(spark, sf))
    users = spark.sql(f"SELECT user_id, node.lat, node.lon FROM (SELECT DISTINCT user_id FROM {{events}}) JOIN {{node}} node ON node.node_id = user_id * 37 % {n}",
                      events=fx.table(spark, sf, "events"), node=fx.road_node(spark, sf))
    keys = spark.range(12).select(F.col("id").alias("course_key"))  # the twelve courses completions refer to
    courses = keys.select(
        "course_key", F.concat(F.lit("course-"), F.col("course_key").cast("string")).alias("course_ref"),
        F.get(F.array(*map(F.lit, ("cat", "dog", "rabbit", "whale"))), (F.col("course_key") % 4).cast("int")).alias("shape"),
        (F.lit(37.45) + F.floor(F.col("course_key") / 4) * 0.012).alias("lat"), (F.lit(126.85) + (F.col("course_key") % 5) * 0.01).alias("lon"),
        (F.lit(0.70) + F.col("course_key") * 0.01).alias("similarity"))
    return presets.weekly_recommendation(users, c, courses, 30).select("user_id", "course_key", "shape", "band")


def latency_report(spark, sf):
    rep = activity.latency_report(fx.request_log(spark, sf))
    return rounded(rep, "p50_ms", "p99_ms", "max_ms").withColumn("avg_ms", geo.half_even(F.col("avg_ms"), 3))


QUERIES = {f.__name__: f for f in (
    station_unique, station_lookup, address_variants, address_shape, place_labels, location_cascade, request_defaults, canonical_requests,
    request_keys, request_patches, preset_lookup, presets_nearby, preset_nearest, preset_relocation, preset_survey, distance_decision,
    remaining_jobs, preset_inventory, shape_usage, distance_probes, tolerant_best, alternative_shapes, gpx_export, route_json, atlas_export,
    build_manifest, map_clusters, passport, passport_runs, relay, undone_courses, facility_merge, weekly_recommendation, latency_report)}

_V = "VARCHAR"
_KEY = "regexp_replace(regexp_replace(lower(trim({t})), '^서울(?:특별시|시)?', '서울특별시'), '[^0-9a-z가-힣]', '', 'g')"


def _name(t):
    base = f"trim(regexp_replace({t}, '\\([^)]*\\)', '', 'g'))"
    return f"CASE WHEN ends_with({base}, '역') THEN {base} ELSE {base} || '역' END"


_fix = lambda x, d: f"printf('%.{d}f', {r(x, d)})"
_pd = equi("s.lat", "s.lon", "p.lat", "p.lon")
_district = " OR ".join(f"contains(q, '{d}')" for d in text.DISTRICTS)
_shape4 = "['rabbit', 'cat', 'dog', 'whale']"

REQ_SQL = {
    "station": STATION.format(str=_V) + " FROM supplier CROSS JOIN grid_dim g JOIN road_node n ON n.node_id = (s_suppkey * 131) % g.n",
    "address_query": ADDRESS.format(str=_V) + " FROM customer",
    "station_last": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lat, lon ORDER BY station_seq DESC) AS rn FROM station) WHERE rn = 1",
    "shape_pos": "SELECT * FROM (VALUES (0, 'rabbit'), (1, 'cat'), (2, 'dog'), (3, 'whale')) t(pos, shape)",
    "preset": PRESET + f" FROM (SELECT station_seq, {r('lat', 5)} AS lat, {r('lon', 5)} AS lon, {_name('official_name')} AS name, pos, shape FROM station_last, shape_pos WHERE station_seq % 7 <> 0)",
    "shape_request": f"""SELECT request_id, {r('lat', 5)} AS lat, {r('lon', 5)} AS lon, COALESCE(distance_km, 5) AS distance_km, include_hills, night_mode,
      CASE WHEN request_id % 5 < 4 THEN {_shape4}[request_id % 5 + 1] END AS shape, request_id % 11 = 0 AS needs FROM course_request""",
    "spot": f"SELECT point_id, lat, lon, {_shape4}[point_id % 4 + 1] AS shape FROM point_feature WHERE kind = 'facility'",
    "spot_pair": f"SELECT s.point_id, s.lat, s.lon, s.shape, p.name, p.lat AS p_lat, p.lon AS p_lon, p.similarity, {r(_pd)} AS distance_m FROM spot s JOIN preset p ON p.shape = s.shape AND p.available",
    "run_last": "SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, completion_id DESC) AS back FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, course_key ORDER BY ts DESC, completion_id DESC) AS rn FROM completion) WHERE rn = 1",
    "req_near": f"""SELECT r.lat, r.lon, r.shape, arg_min(p.length_m, p.d) AS n_length, arg_min(p.similarity, p.d) AS n_sim, arg_min(p.distance_km, p.d) AS n_km, MIN(p.d) AS distance_m FROM
      (SELECT DISTINCT lat, lon, shape FROM (SELECT lat, lon FROM shape_request), (SELECT shape FROM shape_pos)) r JOIN LATERAL
      (SELECT s.length_m, s.similarity, s.distance_km, {r(equi('r.lat', 'r.lon', 's.lat', 's.lon'))} AS d FROM preset s WHERE s.shape = r.shape AND s.available AND abs(s.lat - r.lat) < 0.03 AND abs(s.lon - r.lon) < 0.03) p ON p.d <= 2000 GROUP BY 1, 2, 3""",
}


def sql(body: str, extra: dict | None = None) -> str:
    return b.sql(body, {**PATH_SQL, **REQ_SQL, **(extra or {})})


_aliases = ", ".join([
    "official_name", _name("official_name"), f"regexp_replace({_name('official_name')}, '역$', '')", "line || '호선 ' || official_name", f"line || '호선 ' || {_name('official_name')}",
    "road_address", "lot_address", "trim(regexp_replace(road_address, '\\([^)]*\\)', '', 'g'))", "trim(regexp_replace(lot_address, '\\s+\\S+역\\(\\d+호선\\)$', ''))",
    *[f"regexp_replace({c}, '^서울특별시', '{p}')" for c in ("road_address", "lot_address") for p in ("서울", "서울시")]])
_canon = "list_sort(list_filter(['convenience_store', 'park', 'restroom', 'water'], lambda x: list_contains({n}, x)))"
_head = [*(f"'{t}'" for t in exports.GPX_HEAD)]

ORACLES = {
    "station_unique": sql(f"SELECT {r('lat')} AS lat, {r('lon')} AS lon, station_seq, line, official_name FROM station_last"),
    "station_lookup": sql(f"""SELECT query_key, {r('lat')} AS lat, {r('lon')} AS lon, name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_key ORDER BY station_seq) AS rn FROM (
      SELECT DISTINCT station_seq, lat, lon, name, {_KEY.format(t='alias')} AS query_key FROM (SELECT station_seq, lat, lon, {_name('official_name')} AS name, unnest([{_aliases}]) AS alias FROM station) WHERE alias <> '')) WHERE rn = 1"""),
    "address_variants": sql(f"""WITH a AS (SELECT query_id, trim(regexp_replace(location, '\\s+', ' ', 'g')) AS q FROM address_query),
      c AS (SELECT *, regexp_replace(regexp_replace(q, '([가-힣]+(?:로|길))\\s+(\\d+(?:로|길))', '\\1\\2', 'g'), '([가-힣]+(?:로|길)\\d+(?:로|길))\\s+(\\d+)', '\\1 \\2', 'g') AS compact FROM a),
      v AS (SELECT query_id, [q, compact, CASE WHEN regexp_matches(compact, '^서울(?:특별시|시)?') THEN trim(regexp_replace(compact, '^서울(?:특별시|시)?\\s*', '서울특별시 ')) END,
        CASE WHEN contains(compact, '테헤란로') AND NOT ({_district}) THEN '강남구 ' || compact END, CASE WHEN contains(compact, '테헤란로') AND NOT ({_district}) THEN '서울특별시 강남구 ' || compact END,
        CASE WHEN contains(compact, '신설동') AND NOT ({_district}) THEN '동대문구 ' || compact END, CASE WHEN contains(compact, '신설동') AND NOT ({_district}) THEN '서울특별시 동대문구 ' || compact END,
        CASE WHEN NOT (starts_with(q, '서울 ') OR starts_with(q, '서울시') OR starts_with(q, '서울특별시')) THEN '서울특별시 ' || compact END] AS l FROM c),
      u AS (SELECT query_id, MIN(i) AS i, variant FROM (SELECT query_id, unnest(range(1, 9)) AS i, unnest(l) AS variant FROM v) WHERE variant IS NOT NULL AND variant <> '' GROUP BY query_id, variant)
      SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS position, variant FROM u"""),
    "address_shape": sql(f"SELECT query_id, regexp_matches(location, '{text.ADDRESS_LIKE}') AS is_address, {_KEY.format(t='location')} AS query_key FROM address_query"),
    "place_labels": sql("""SELECT p_partkey, regexp_replace(substr(regexp_replace(p_name || ' [*' || p_brand || '*]' || chr(9) || '(#1) ' || repeat(p_type, 8) || ' + `x` | {y}! - 1.5 <z>_\\', '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 120), '([\\\\`*_{}\\[\\]()<>#+\\-.!|])', '\\\\\\1', 'g') AS label FROM part"""),
    "location_cascade": sql(f"""WITH gz AS ({GAZ_SQL}), q AS (SELECT a.query_id, CASE WHEN a.query_id % 20 <> 0 AND a.query_id % 13 <> 0 THEN location END AS location,
        CASE WHEN a.query_id % 30 = 0 THEN n.lat + 1 WHEN a.query_id % 10 = 0 THEN n.lat END AS lat, CASE WHEN a.query_id % 10 = 0 THEN n.lon END AS lon FROM address_query a JOIN road_node n ON n.node_id = a.query_id),
      lk AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_key ORDER BY station_seq) AS rn FROM (SELECT DISTINCT station_seq, lat, lon, name, {_KEY.format(t='alias')} AS query_key FROM (SELECT station_seq, lat, lon, {_name('official_name')} AS name, unnest([{_aliases}]) AS alias FROM station) WHERE alias <> '')) WHERE rn = 1),
      h AS (SELECT q.*, replace(location, ' ', '') AS k, e.name AS e_name, e.lat AS e_lat, e.lon AS e_lon, l.name AS l_name, l.lat AS l_lat, l.lon AS l_lon FROM q LEFT JOIN gz e ON e.name = replace(q.location, ' ', '') LEFT JOIN lk l ON l.query_key = {_KEY.format(t='q.location')}),
      f AS (SELECT h.*, CASE WHEN NOT regexp_matches(location, '{text.ADDRESS_LIKE}') AND length(k) BETWEEN 2 AND 10 THEN (SELECT MIN(pos) FROM gz WHERE contains(h.k, gz.name) OR contains(gz.name, h.k)) END AS z FROM h),
      o AS (SELECT f.*, z_.name AS z_name, z_.lat AS z_lat, z_.lon AS z_lon, CASE WHEN f.lat IS NOT NULL THEN CASE WHEN f.lat BETWEEN 37.4 AND 37.72 AND f.lon BETWEEN 126.76 AND 127.19 THEN 1 ELSE 9 END WHEN e_name IS NOT NULL THEN 2 WHEN l_name IS NOT NULL THEN 3 WHEN z IS NOT NULL THEN 4 ELSE 9 END AS rung FROM f LEFT JOIN gz z_ ON z_.pos = f.z)
      SELECT query_id, CAST(rung AS INTEGER) AS rung, {r('CASE rung WHEN 1 THEN lat WHEN 2 THEN e_lat WHEN 3 THEN l_lat WHEN 4 THEN z_lat END')} AS lat, {r('CASE rung WHEN 1 THEN lon WHEN 2 THEN e_lon WHEN 3 THEN l_lon WHEN 4 THEN z_lon END')} AS lon,
        CASE rung WHEN 1 THEN COALESCE(location, '(' || {_fix('lat', 4)} || ', ' || {_fix('lon', 4)} || ')') WHEN 2 THEN e_name WHEN 3 THEN l_name WHEN 4 THEN z_name END AS name,
        CASE WHEN rung < 9 THEN NULL WHEN lat IS NOT NULL THEN 'outside' WHEN location IS NULL THEN 'missing' ELSE 'unknown' END AS error FROM o"""),
    "request_defaults": sql(f"""SELECT request_id, CASE WHEN distance_km IS NOT NULL THEN distance_km WHEN duration_min > 0 THEN {r('duration_min / 6.5::DOUBLE', 1)} ELSE 5 END AS distance_km,
      CASE WHEN distance_km IS NOT NULL THEN 'given' WHEN duration_min > 0 THEN 'from duration' ELSE 'default' END AS note FROM course_request"""),
    "canonical_requests": sql(f"""SELECT request_id, {r('distance_km', 2)} AS distance_km, array_to_string(f, ',') AS facilities,
      sha256({_fix('lat', 5)} || '|' || {_fix('lon', 5)} || '||' || {_fix('distance_km', 2)} || '|' || CAST(include_hills AS VARCHAR) || '|' || CAST(night_mode AS VARCHAR) || '|' || COALESCE(shape, '') || '|' || array_to_string(f, ',')) AS course_ref
      FROM (SELECT *, {_canon.format(n="CASE WHEN request_id % 3 = 0 THEN ['water', 'cafe', 'park', 'water'] WHEN needs THEN ['restroom'] ELSE [] END")} AS f FROM shape_request)"""),
    "request_keys": sql(f"""SELECT request_id, {_fix('lat', 5)} || ',' || {_fix('lon', 5)} || ',' || shape AS preset_key, token, CASE WHEN request_id % 9 <> 0 THEN shape END AS token_shape, CASE WHEN request_id % 9 <> 0 THEN distance_km END AS token_km
      FROM (SELECT *, CASE WHEN request_id % 9 = 0 THEN shape || '-99k' ELSE shape || '-' || printf('%d', CAST(distance_km AS BIGINT)) || 'k' END AS token FROM shape_request WHERE shape IS NOT NULL)"""),
    "request_patches": sql("""SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 8 ELSE distance_km END AS distance_km, CASE WHEN request_id % 3 = 0 THEN NOT include_hills ELSE include_hills END AS include_hills, night_mode,
      CASE request_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'whale' ELSE shape END AS shape, CASE WHEN request_id % 2 = 0 OR request_id % 3 = 0 OR request_id % 7 IN (0, 1) THEN NULL ELSE 'nothing to change' END AS error FROM shape_request"""),
    "preset_lookup": sql("""SELECT r.request_id, CASE WHEN p.available IS NULL THEN 'not_covered' WHEN p.available THEN 'found' ELSE 'unavailable' END AS outcome, p.name AS preset_name, p.length_m
      FROM shape_request r LEFT JOIN preset p ON p.lat = r.lat AND p.lon = r.lon AND p.shape = r.shape AND NOT r.include_hills AND NOT r.night_mode AND NOT r.needs"""),
    "presets_nearby": sql(f"""SELECT {r('lat')} AS lat, {r('lon')} AS lon, shape, {r('p_lat')} AS p_lat, {r('p_lon')} AS p_lon, distance_m, CAST(round_even(distance_m / 50, 0) * 50 AS BIGINT) AS move_m, CAST(greatest(1, round_even(distance_m / 80, 0)) AS BIGINT) AS walk_min, distance_m < 150 AS is_exact
      FROM spot_pair WHERE distance_m <= 2000"""),
    "preset_nearest": sql("SELECT point_id, name AS preset_name, distance_m FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY distance_m, name) AS rn FROM spot_pair WHERE distance_m <= 2000) WHERE rn = 1"),
    "preset_relocation": sql("SELECT s.point_id, similarity, distance_m FROM spot s LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY -similarity, distance_m) AS rn FROM spot_pair WHERE distance_m <= 30000) p ON p.point_id = s.point_id AND rn = 1"),
    "preset_survey": sql(f"""WITH sv AS (SELECT * FROM (VALUES (0, 'dog'), (1, 'cat'), (2, 'whale'), (3, 'rabbit')) t(position, shape)),
      a AS (SELECT q.request_id AS place_id, q.lat, q.lon, CASE WHEN q.request_id % 2 = 0 THEN q.distance_km END AS wanted, sv.shape, sv.position, p.available AND p.length_m IS NOT NULL AS ex, p.length_m AS x_len, p.similarity AS x_sim, n.n_length, n.n_sim, n.distance_m AS n_d
        FROM shape_request q CROSS JOIN sv LEFT JOIN preset p ON p.lat = q.lat AND p.lon = q.lon AND p.shape = sv.shape LEFT JOIN req_near n ON n.lat = q.lat AND n.lon = q.lon AND n.shape = sv.shape),
      c AS (SELECT place_id, shape, position, wanted, CASE WHEN ex THEN 'exact' WHEN n_length IS NOT NULL THEN 'nearby' ELSE 'none' END AS source, CASE WHEN ex THEN x_len ELSE n_length END AS length_m, CASE WHEN ex THEN x_sim ELSE n_sim END AS sim,
        CASE WHEN ex THEN 0 ELSE n_d END AS distance_m, COALESCE(ex, FALSE) OR COALESCE(n_d < 150, FALSE) AS here FROM a),
      pk AS (SELECT place_id, position, ROW_NUMBER() OVER (PARTITION BY place_id ORDER BY CASE WHEN wanted IS NOT NULL THEN {r('abs(length_m / 1000 - wanted)')} ELSE -sim END, CASE WHEN wanted IS NOT NULL THEN -sim ELSE length_m / 1000 END, position) AS rn FROM c WHERE here)
      SELECT c.place_id, c.shape, c.source, c.length_m, c.distance_m, pk.position IS NOT NULL AS featured FROM c LEFT JOIN pk ON pk.place_id = c.place_id AND pk.position = c.position AND pk.rn = 1"""),
    "distance_decision": sql(f"""SELECT request_id, CASE WHEN NOT plain OR cl IS NULL THEN 'generate' WHEN NOT ex AND n_d >= 150 THEN 'relocate' WHEN {r('abs(cl / 1000 - distance_km) / distance_km')} <= 0.10 THEN 'serve' WHEN distance_km < least_km THEN 'suggest' ELSE 'generate' END AS decision
      FROM (SELECT q.request_id, q.distance_km, COALESCE(NOT include_hills AND NOT night_mode AND NOT needs, FALSE) AS plain, CASE WHEN p.available THEN p.distance_km ELSE n.n_km END AS least_km, COALESCE(p.available, FALSE) AS ex, n.distance_m AS n_d, CASE WHEN p.available THEN p.length_m ELSE n.n_length END AS cl
        FROM shape_request q LEFT JOIN preset p ON p.lat = q.lat AND p.lon = q.lon AND p.shape = q.shape LEFT JOIN req_near n ON n.lat = q.lat AND n.lon = q.lon AND n.shape = q.shape WHERE q.shape IS NOT NULL)"""),
    "remaining_jobs": sql(f"""SELECT j.lat, j.lon, j.shape, f.retry FROM (SELECT {r('lat', 5)} AS lat, {r('lon', 5)} AS lon, shape FROM station_last, shape_pos) j CROSS JOIN (VALUES (FALSE), (TRUE)) f(retry)
      LEFT JOIN preset p ON p.lat = j.lat AND p.lon = j.lon AND p.shape = j.shape WHERE p.shape IS NULL OR (f.retry AND NOT p.available)"""),
    "preset_inventory": sql("SELECT COUNT(*) FILTER (available) AS verified, COUNT(*) FILTER (NOT available) AS unavailable, COUNT(*) AS total FROM preset"),
    "shape_usage": sql("""SELECT CAST(pos AS INTEGER) AS position, s.shape, CASE WHEN s.shape = 'dog' THEN CAST(5 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END AS min_km, COALESCE(c, 0) AS requests FROM shape_pos s LEFT JOIN (SELECT shape, COUNT(*) AS c FROM shape_request GROUP BY 1) r ON r.shape = s.shape"""),
    "distance_probes": sql("""SELECT request_id, CAST(ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY abs(km - pref), km) - 1 AS INTEGER) AS position, km FROM (
      SELECT request_id, greatest(distance_km, 3) + i AS km, greatest(greatest(distance_km, 3), CASE shape WHEN 'dog' THEN 9 WHEN 'cat' THEN 8 WHEN 'whale' THEN 5 ELSE 8 END) AS pref
      FROM shape_request JOIN (SELECT range AS i FROM range(12)) ON greatest(distance_km, 3) + i <= 11 WHERE shape IS NOT NULL)"""),
    "tolerant_best": sql(f"""SELECT lat, lon, best.sim AS sim, best.km AS km, best.tag AS tag FROM (SELECT lat, lon, list_reduce(list_sort(list(
      {{'ord': CAST(floor({r('length_m / 100')}) AS BIGINT), 'sim': similarity, 'km': length_m / 1000, 'tag': shape}})),
      lambda a, c: CASE WHEN {r('c.sim - a.sim')} > 0.015 OR (abs({r('c.sim - a.sim')}) <= 0.015 AND c.km < a.km) THEN c ELSE a END) AS best FROM preset WHERE available GROUP BY lat, lon)"""),
    "alternative_shapes": sql("""WITH st AS (SELECT * FROM (VALUES ('rabbit', 0.70, 3), ('cat', 0.70, 3), ('dog', 0.68, 5), ('whale', 0.72, 3)) t(shape, gate, least_km))
      SELECT request_id, alternative, CAST(rn AS INTEGER) AS rank FROM (SELECT q.request_id, p.shape AS alternative, ROW_NUMBER() OVER (PARTITION BY q.request_id ORDER BY sp.pos) AS rn
        FROM shape_request q JOIN preset p ON p.lat = q.lat AND p.lon = q.lon AND p.available AND p.shape <> q.shape JOIN shape_pos sp ON sp.shape = p.shape JOIN st ON st.shape = p.shape AND p.similarity >= CAST(st.gate AS DOUBLE) AND q.distance_km >= st.least_km WHERE q.shape IS NOT NULL) WHERE rn <= 2"""),
    "gpx_export": sql(f"""SELECT course_id, line_no, text FROM (SELECT course_id, seq + 10 AS line_no, '      <trkpt lat="' || {_fix('lat', 6)} || '" lon="' || {_fix('lon', 6)} || '"/>' AS text FROM path_at
      UNION ALL SELECT course_id, i, CASE WHEN i < 8 THEN h[i + 1] WHEN i = 8 THEN '    <name>Loop &lt;' || course_id || '&gt; &amp; &#x27;co&#x27;</name>' ELSE '    <trkseg>' END FROM (SELECT DISTINCT course_id FROM course_path), (SELECT range AS i FROM range(10)), (SELECT [{', '.join(_head)}] AS h)
      UNION ALL SELECT course_id, n + 10 + i, CASE i WHEN 0 THEN '    </trkseg>' WHEN 1 THEN '  </trk>' ELSE '</gpx>' END FROM (SELECT course_id, COUNT(*) AS n FROM course_path GROUP BY 1), (SELECT range AS i FROM range(3)))"""),
    "route_json": sql(f"""SELECT course_id, seq + 1 AS line_no, '[' || {_fix('lat', 5)} || ',' || {_fix('lon', 5)} || ']' || CASE WHEN seq < n - 1 THEN ',' ELSE '' END AS text FROM (SELECT *, COUNT(*) OVER (PARTITION BY course_id) AS n FROM path_at)
      UNION ALL SELECT DISTINCT course_id, 0, '{{"points":[' FROM course_path UNION ALL SELECT course_id, COUNT(*) + 1, '],"km":' || {_fix('MAX(km)', 1)} || '}}' FROM path_km GROUP BY course_id"""),
    "atlas_export": sql(f"SELECT {r('lat', 5)} AS lat, {r('lon', 5)} AS lon, shape, name, {r('length_m / 1000', 1)} AS km, {_fix('lat', 5)} || ',' || {_fix('lon', 5)} || ',' || shape AS id FROM preset WHERE available"),
    "build_manifest": sql("""SELECT '{"date":"2026-01-01","sources":{"green":"polygons","cctv":"points"},"local_only":false,"counts":{"edges":' || COUNT(*) || ',"slope_edges":' || SUM(CAST(slope_known AS INT)) || ',"slope_surveyed_edges":' || SUM(CAST(slope_surveyed AS INT)) || ',"width_edges":' || COUNT(width_m) || ',"park_edges":' || SUM(CASE WHEN park_score > 0 THEN 1 ELSE 0 END) || '}}' AS document FROM edge_scored"""),
    "map_clusters": sql(f"""SELECT CAST(level AS INTEGER) AS level, CAST(floor(lat / size + 0.5) AS BIGINT) AS ci, CAST(floor(lon / size + 0.5) AS BIGINT) AS cj, {r('AVG(lat)', 4)} AS lat, {r('AVG(lon)', 4)} AS lon, COUNT(*) AS places, CAST(SUM(station_seq % 4 + 1) AS BIGINT) AS courses
      FROM station_last, (SELECT * FROM (VALUES (9, {D(0.075)}), (8, {D(0.05)}), (7, {D(0.03)}), (6, {D(0.016)})) t(level, size)) GROUP BY 1, 2, 3"""),
    "passport": sql("""SELECT user_id, CAST(SUM(runs) AS BIGINT) AS runs, (SELECT string_agg(DISTINCT shape, ',' ORDER BY shape) FROM run_last r WHERE r.user_id = p.user_id AND back <= 40) AS shapes, COUNT(*) FILTER (found = 4) AS masters,
      (SELECT COUNT(DISTINCT shape) FROM run_last r WHERE r.user_id = p.user_id AND back <= 40) = 4 AS complete FROM (SELECT user_id, place, COUNT(DISTINCT shape) AS found, COUNT(*) AS runs FROM run_last WHERE back <= 40 GROUP BY 1, 2) p GROUP BY user_id"""),
    "passport_runs": sql("SELECT user_id, course_key, completion_id, CAST(back AS INTEGER) AS back FROM run_last WHERE back <= 5"),
    "relay": sql("""WITH f AS (SELECT user_id, arg_min(shape, (ts, completion_id)) AS s FROM completion GROUP BY 1),
      l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, completion_id DESC) AS back FROM (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY c.user_id, course_key ORDER BY ts DESC, completion_id DESC) AS rn FROM completion c JOIN f ON f.user_id = c.user_id AND f.s = c.shape) WHERE rn = 1)
      SELECT f.user_id, f.s AS shape, COUNT(*) AS legs, MAX(course_key) AS top_course, (SELECT COUNT(*) FROM completion c WHERE c.user_id = f.user_id AND c.shape <> f.s) AS rejected FROM f JOIN l ON l.user_id = f.user_id AND back <= 8 GROUP BY 1, 2"""),
    "undone_courses": sql("SELECT u.user_id, k AS course_key FROM (SELECT DISTINCT user_id FROM completion) u, (SELECT range AS k FROM range(12)) EXCEPT SELECT user_id, course_key FROM completion"),
    "facility_merge": sql(f"""SELECT type, facility_id, name, {r('lat', 5)} AS lat, {r('lon', 5)} AS lon, CAST(grp AS INTEGER) AS source FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY type, {r('lat', 5)}, {r('lon', 5)} ORDER BY grp, facility_id) AS rn FROM (
      SELECT point_id AS facility_id, facility_type AS type, 'a' AS name, lat, lon, 0 AS grp FROM point_feature WHERE kind = 'facility'
      UNION ALL SELECT point_id + 1000000, facility_type, 'b', lat + {D(1e-7)}, CASE point_id % 3 WHEN 0 THEN lon + {D(0.01)} WHEN 1 THEN lon END, 1 FROM point_feature WHERE kind = 'facility') WHERE lat IS NOT NULL AND lon IS NOT NULL) WHERE rn = 1"""),
    "weekly_recommendation": sql(f"""WITH us AS (SELECT user_id, n.lat, n.lon FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN grid_dim g JOIN road_node n ON n.node_id = user_id * 37 % g.n),
      co AS (SELECT range AS course_key, ['cat', 'dog', 'rabbit', 'whale'][range % 4 + 1] AS shape, {D(37.45)} + CAST(floor(range / 4) AS DOUBLE) * {D(0.012)} AS lat, {D(126.85)} + CAST(range % 5 AS DOUBLE) * {D(0.01)} AS lon, {D(0.70)} + range * {D(0.01)} AS sim,
        (CAST('0x' || substr(sha256('course-' || range), 1, 8) AS BIGINT) + 30) % 97 AS turn_ FROM range(12)),
      dn AS (SELECT * FROM run_last WHERE back <= 40),
      ca AS (SELECT us.user_id, co.*, CAST(round_even({r(hav('us.lat', 'us.lon', 'co.lat', 'co.lon') + ' / 250')}, 0) AS BIGINT) AS band, EXISTS (SELECT 1 FROM dn WHERE dn.user_id = us.user_id AND dn.shape = co.shape) AS seen
        FROM us, co WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.user_id = us.user_id AND dn.course_key = co.course_key))
      SELECT us.user_id, c.course_key, c.shape, c.band FROM us LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY seen, band, turn_, -sim, course_key) AS rn FROM ca) c ON c.user_id = us.user_id AND rn = 1"""),
    "latency_report": sql(f"""SELECT name, COUNT(*) AS n, {r('AVG(latency_ms)', 3)} AS avg_ms, {r('MAX(CASE WHEN p = n_ // 2 THEN latency_ms END)')} AS p50_ms, {r('MAX(CASE WHEN p = n_ * 99 // 100 THEN latency_ms END)')} AS p99_ms, {r('MAX(latency_ms)')} AS max_ms,
        CASE WHEN AVG(latency_ms) <= 100 THEN 'PASS' ELSE 'FAIL' END AS avg_target, CASE WHEN MAX(CASE WHEN p = n_ * 99 // 100 THEN latency_ms END) <= 3000 THEN 'PASS' ELSE 'FAIL' END AS p99_target
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY latency_ms) - 1 AS p, COUNT(*) OVER (PARTITION BY name) AS n_ FROM (SELECT tool AS name, latency_ms FROM request_log UNION ALL SELECT 'overall', latency_ms FROM request_log)) GROUP BY name"""),
}
