"""Answers for a table of shape requests, in stages: only rows that a stage leaves open go on to the next, dearer one.

requests: request_id, lat, lon, shape, distance_km (null: left open), include_hills,
night_mode, need_facilities. Every request gets one way:

serve    a verified course that starts here, a preset's or one found by the sweep over distances, fits
suggest  the asked distance is too short here; the shortest clear course is offered instead
relocate the nearest verified course starts elsewhere
search   a course drawn for the asked distance
survey   no shape was named: the shape to show first here
refuse   nothing clear enough; `alternatives` names up to two shapes that do fit here
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geo, score
from strideframe.operators import presets
from strideframe.plans import shape_search
from strideframe.session import any_row, cut
from strideframe.sources import shapes as cat

COLUMNS = ["request_id", "shape", "asked_km", "way", "source", "km", "similarity", "preset_name", "start_lat", "start_lon", "distance_m", "reason"]


def _answer(rows: DataFrame, way: Column, source: str, **cols: Column) -> DataFrame:
    """Rows in the form of the answer table; columns that are not given are null."""
    types = {"km": "double", "similarity": "double", "preset_name": "string", "start_lat": "double", "start_lon": "double", "distance_m": "double", "reason": "string"}
    rest = [cols[c].cast(t).alias(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    return rows.select("request_id", "shape", F.col("distance_km").alias("asked_km"), way.alias("way"), F.lit(source).alias("source"), *rest)


def _from_presets(asked: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, open requests with `known`: whether this start is known to have no course).

    With a distance the decision is that of distance_decision; without one a preset
    here is served, and a start known to have none is sent to the nearest preset.
    """
    cols = asked.columns
    forced = presets.distance_decision(asked.where("distance_km IS NOT NULL"), table)
    own = forced.withColumns({"way": F.when(F.col("decision") == "generate", None).otherwise(F.col("decision")), "km": F.col("clean_km")})
    own = own.select(*cols, "outcome", "way", "km", "similarity", "preset_name")
    free = presets.lookup(asked.where("distance_km IS NULL"), table)
    free = free.withColumns({"way": F.when(F.col("outcome") == "found", "serve").when(F.col("outcome") == "unavailable", "relocate"), "km": F.col("length_m") / 1000.0})
    rows = cut(own.unionByName(free.select(*own.columns)))
    moved = rows.where("way = 'relocate'")
    near = presets.nearest(moved, table).select("lat", "lon", "shape", F.col("preset_name").alias("n_name"), F.col("p_lat"), F.col("p_lon"),
                                                (F.col("length_m") / 1000.0).alias("n_km"), F.col("similarity").alias("n_sim"), "distance_m")
    moved = moved.join(near, ["lat", "lon", "shape"], "left")
    here = rows.where("way IN ('serve', 'suggest')")
    # a served or suggested course may be a neighbour's within a few steps; it is named with the start it has
    beside = here.where("outcome <> 'found'").join(presets.nearest(here.where("outcome <> 'found'"), table).select(
        "lat", "lon", "shape", F.col("preset_name").alias("n_name"), "p_lat", "p_lon", F.col("similarity").alias("n_sim"), "distance_m"), ["lat", "lon", "shape"], "left")
    answers = (_answer(moved, F.when(F.col("n_name").isNull(), "refuse").otherwise(F.lit("relocate")), "preset", km=F.col("n_km"), similarity=F.col("n_sim"),
                       preset_name=F.col("n_name"), start_lat=F.col("p_lat"), start_lon=F.col("p_lon"), distance_m=F.col("distance_m"),
                       reason=F.when(F.col("n_name").isNull(), "no course here or near"))
               .unionByName(_answer(here.where("outcome = 'found'"), F.col("way"), "preset", km=F.col("km"), similarity=F.col("similarity"), preset_name=F.col("preset_name"),
                                    start_lat=F.col("lat"), start_lon=F.col("lon"), distance_m=F.lit(0.0)))
               .unionByName(_answer(beside, F.col("way"), "preset", km=F.col("km"), similarity=F.col("n_sim"), preset_name=F.col("n_name"),
                                    start_lat=F.col("p_lat"), start_lon=F.col("p_lon"), distance_m=F.col("distance_m"))))
    left = rows.where("way IS NULL").select(*cols, (F.col("outcome") != "not_covered").alias("known"))
    return cut(answers), cut(left)


def _from_sweep(left: DataFrame, nodes: DataFrame, edges: DataFrame, facilities: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, paths, still open) by the first clear distance of starts that no preset speaks for.

    Open distances take what the sweep finds. A given distance is served by it
    within 10 %, and told the clear distance if it asked for less than that one was tried with.
    """
    unknown = left.where("NOT known").drop("known")
    probes = unknown.withColumns({"asked_km": F.col("distance_km"), "distance_km": score.lookup(F.col("shape"), cat.MIN_KM, 3.0)})
    found, ways, _ = shape_search.first_clear_distance(probes.drop("asked_km"), nodes, edges, facilities)
    rows = left.join(found.select("request_id", "sim", "km", F.col("distance_km").alias("tried_km")), "request_id", "left")
    close = geo.half_even(F.abs(F.col("km") - F.col("distance_km")) / F.col("distance_km")) <= shape_search.DISTANCE_ERROR
    way = (F.when(F.col("km").isNull(), None).when(F.col("distance_km").isNull() | close, "serve").when(F.col("distance_km") < F.col("tried_km"), "suggest"))
    rows = cut(rows.withColumn("way", way))
    done = rows.where("way IS NOT NULL")
    answers = _answer(done, F.col("way"), "sweep", km=F.col("km"), similarity=F.col("sim"), start_lat=F.col("lat"), start_lon=F.col("lon"), distance_m=F.lit(0.0))
    if ways is not None:
        ways = ways.join(done.select("request_id"), "request_id", "left_semi")
    return cut(answers), ways, rows.where("way IS NULL").select(*left.columns)


def _alternatives(refused: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, alternatives): up to two other shapes, in catalogue order, that a quick screening clears at the same start and distance."""
    others = presets.per_shape(refused.select("request_id", "lat", "lon", F.col("shape").alias("own"), "distance_km"), cat.SHAPES)
    fits = (F.col("shape") != F.col("own")) & (score.lookup(F.col("shape"), cat.MIN_KM, 99.0) <= F.col("distance_km"))
    probes = cut(others.where(fits).select((F.col("request_id") * len(cat.SHAPES) + F.col("position")).alias("probe_id"), "request_id", "position", "lat", "lon", "shape", "distance_km"))
    if not any_row(probes):
        return refused.limit(0).select("request_id", F.array(F.lit("")).alias("alternatives"))
    best, _ = shape_search.search(probes.drop("request_id", "position").withColumnRenamed("probe_id", "request_id"), nodes, edges, quick=True)
    gate = score.lookup(F.col("shape"), {s: v["gate"] for s, v in cat.STYLES.items()}, 1.0)
    good = best.where(F.col("sim") >= gate).select(F.col("request_id").alias("probe_id")).join(probes, "probe_id")
    names = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", "shape"))), lambda s: s["shape"]), 1, 2)  # at most three a request
    return good.groupBy("request_id").agg(names.alias("alternatives"))


def plan_shape_courses(requests: DataFrame, preset_table: DataFrame, nodes: DataFrame, edges: DataFrame, facilities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, paths): one answer per request by the first stage that settles it, and the nodes of drawn courses.

    Stages: the named shape, presets, the sweep over distances, a search at the asked
    distance (strict, then relaxed), and for what is refused a quick look at other
    shapes. answers: COLUMNS and alternatives. paths: request_id, seq, node_id.
    """
    nodes, edges = cut(nodes), cut(edges)
    asked = cut(requests.select("request_id", "lat", "lon", "shape", "distance_km", "include_hills", "night_mode", "need_facilities"))
    known = F.col("shape").isin(*cat.SHAPES)
    answers = [_answer(asked.where(F.col("shape").isNotNull() & ~known), F.lit("refuse"), "request", reason=F.lit("unknown shape"))]
    open_shape = asked.where("shape IS NULL")
    places = open_shape.select(F.col("request_id").alias("place_id"), "lat", "lon", F.col("distance_km").alias("wanted_km"))
    first = presets.survey(places, preset_table, cat.SURVEY_SHAPES).where("featured").select(
        F.col("place_id").alias("request_id"), F.col("shape").alias("f_shape"), "length_m", "similarity", "distance_m")
    shown = open_shape.drop("shape").join(first, "request_id", "left").withColumn("shape", F.col("f_shape"))
    answers.append(_answer(shown, F.when(F.col("shape").isNull(), "refuse").otherwise(F.lit("survey")), "preset", km=F.col("length_m") / 1000.0, similarity=F.col("similarity"),
                           start_lat=F.col("lat"), start_lon=F.col("lon"), distance_m=F.col("distance_m"), reason=F.when(F.col("shape").isNull(), "no course here")))
    settled, left = _from_presets(asked.where(known), preset_table)
    answers.append(settled)
    ways = []
    if any_row(left):
        settled, found, left = _from_sweep(left, nodes, edges, facilities)
        answers.append(settled)
        ways.append(found)
        left = cut(left)
    dead_end = left.where("distance_km IS NULL")
    near = presets.relocation(dead_end, preset_table)
    moved = dead_end.join(near, ["lat", "lon", "shape"], "left").withColumn("found", F.col("preset_name").isNotNull() & presets.is_plain())
    answers.append(_answer(moved, F.when(F.col("found"), "relocate").otherwise(F.lit("refuse")), "preset", km=F.when(F.col("found"), F.col("length_m") / 1000.0),
                           similarity=F.when(F.col("found"), F.col("similarity")), preset_name=F.when(F.col("found"), F.col("preset_name")),
                           start_lat=F.when(F.col("found"), F.col("p_lat")), start_lon=F.when(F.col("found"), F.col("p_lon")),
                           distance_m=F.when(F.col("found"), F.col("distance_m")), reason=F.when(~F.col("found"), "no clear course up to the longest distance")))
    sized = left.where("distance_km IS NOT NULL").drop("known")
    short = F.col("distance_km") < score.lookup(F.col("shape"), cat.MIN_KM, 3.0)
    answers.append(_answer(sized.where(short), F.lit("refuse"), "request", reason=F.lit("shorter than the shape's least distance")))
    drawn = cut(sized.where(~short))
    refused = sized.where(short)
    if any_row(drawn):
        courses, found = shape_search.shaped_courses(drawn, nodes, edges, facilities)
        rows = cut(drawn.join(courses.select("request_id", "sim", (F.col("length_m") / 1000.0).alias("km"), "shipped"), "request_id", "left"))
        good = rows.where("shipped")
        answers.append(_answer(good, F.lit("search"), "search", km=F.col("km"), similarity=F.col("sim"), start_lat=F.col("lat"), start_lon=F.col("lon"), distance_m=F.lit(0.0)))
        bad = rows.where("NOT coalesce(shipped, false)")
        gate = score.lookup(F.col("shape"), {s: v["gate"] for s, v in cat.STYLES.items()}, 1.0)
        answers.append(_answer(bad, F.lit("refuse"), "search", reason=F.when(F.coalesce(F.col("sim"), F.lit(0.0)) < gate, "not clear enough here").otherwise("no closed course of this length")))
        refused = refused.unionByName(bad.select(*refused.columns))
        ways.append(found.join(good.select("request_id"), "request_id", "left_semi"))
    table = answers[0]
    for part in answers[1:]:
        table = table.unionByName(part)
    refused = cut(refused)
    other = _alternatives(refused, nodes, edges) if any_row(refused) else None
    table = table.withColumn("alternatives", F.array().cast("array<string>")) if other is None else table.join(other, "request_id", "left").withColumn(
        "alternatives", F.coalesce("alternatives", F.array().cast("array<string>")))
    paths = None
    for part in (w for w in ways if w is not None):
        part = part.select("request_id", "seq", "node_id")
        paths = part if paths is None else paths.unionByName(part)
    if paths is None:
        paths = asked.limit(0).select("request_id", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("node_id"))
    return cut(table.select(*COLUMNS, "alternatives")), cut(paths)
