"""Verified courses per (place, shape) and how requests are matched to them.

presets: lat, lon, shape, name, available, length_m, similarity and
distance_km, the distance it was asked for. A row that is not available is known
to have no course; a missing row was never tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geo, text
from strideframe.session import any_row, cut

# Fixed values.
NEAR_PRESET_M = 2_000.0
RELOCATE_M = 30_000.0
EXACT_M = 150.0
FINER = 8  # cells per relocation distance
NARROW_M_PER_DEG = 88_000.0  # metres per degree at the network's north end, rounded down


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("preset_key", text.preset_key(F.col("lat"), F.col("lon"), F.col("shape")))


def is_plain() -> Column:
    """Whether a request can be answered by a preset: a shape, and neither hills nor night nor facilities."""
    return F.coalesce(~F.col("include_hills") & ~F.col("night_mode") & F.col("shape").isNotNull() & (F.size(F.coalesce("need_facilities", F.array())) == 0), F.lit(False))


def lookup(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """requests plus outcome: found, unavailable or not_covered. Hills, night and facilities bypass the presets."""
    table = keyed(presets).select("preset_key", "available", "length_m", "similarity", F.col("name").alias("preset_name"), F.col("distance_km").alias("preset_km"))
    plain = is_plain()
    joined = keyed(requests.where(plain)).join(table, "preset_key", "left")
    # rows that bypass the presets skip the join, where they would all share one empty key
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "preset_key"]
    bypass = keyed(requests.where(~plain)).select("*", *blank)
    outcome = F.when(F.col("available").isNull(), "not_covered").when(F.col("available"), "found").otherwise("unavailable")
    return joined.unionByName(bypass).withColumn("outcome", outcome).drop("available")


def nearby(spots: DataFrame, presets: DataFrame, max_m: float = NEAR_PRESET_M) -> DataFrame:
    """(lat, lon, shape) spots x available presets of the shape within max_m, with distance_m; by an equi join on cells."""
    return _pairs(spots.select("lat", "lon", "shape").distinct(), presets, max_m)


def _ready(presets: DataFrame) -> DataFrame:
    return presets.where("available").select("shape", F.col("name").alias("preset_name"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "length_m", "similarity",
                                             F.col("distance_km").alias("preset_km"))


def _measured(pairs: DataFrame, max_m: float) -> DataFrame:
    d = geo.half_even(geo.equirectangular(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")))
    return pairs.withColumn("distance_m", d).where(F.col("distance_m") <= max_m).drop("ci", "cj")


def _pairs(spots: DataFrame, presets: DataFrame, max_m: float) -> DataFrame:
    size = max_m / NARROW_M_PER_DEG
    from strideframe.operators.cells import square

    spread = _ready(presets).withColumn("o", F.explode(square(1))).withColumns({
        "ci": geo.cell(F.col("p_lat"), size) + F.col("o.di"), "cj": geo.cell(F.col("p_lon"), size) + F.col("o.dj")}).drop("o")
    spots = spots.withColumns({"ci": geo.cell(F.col("lat"), size), "cj": geo.cell(F.col("lon"), size)})
    return _measured(_by_cell(spots, spread), max_m)


def _by_cell(spots: DataFrame, presets: DataFrame) -> DataFrame:
    """Spots x presets of their cell. Cells are dealt to all tasks: a few bytes of rows make many pairs, and in memory
    the rows are far larger than their files, which Spark would go by to broadcast them."""
    cell = ["shape", "ci", "cj"]
    return spots.repartition(int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell).join(presets.hint("shuffle_hash"), cell)


def _first(value: Column) -> Column:
    """The number, with a missing one before all others, as in the order of rows."""
    return F.coalesce(value, F.lit(float("-inf")))


def _best(spots: DataFrame, meet: Callable[[DataFrame], DataFrame], *order: Column) -> DataFrame:
    """The first match per spot: the least of each number of `order` in turn, then of the names.

    The least of whole rows would be found by sorting all pairs on disk, a least number is folded in memory. So
    the pairs are met once per number, only those with the least numbers so far count on, and whole rows are
    compared among pairs that share all of them.
    """
    spot = ["lat", "lon", "shape"]
    known, left = cut(spots.select(*spot).distinct()), F.lit(True)
    for k, value in enumerate(order):
        known = cut(meet(known).where(left).groupBy(*known.columns).agg(F.min(_first(value)).alias(f"least{k}")))
        left = left & (_first(value) == F.col(f"least{k}"))
    facts = ("preset_name", "p_lat", "p_lon", "length_m", "similarity", "preset_km", "distance_m")
    best = meet(known).where(left).groupBy(*spot).agg(F.min(F.struct(*facts)).alias("m"))
    return best.select(*spot, *[f"m.{c}" for c in facts])


def nearest(spots: DataFrame, presets: DataFrame, max_m: float = NEAR_PRESET_M) -> DataFrame:
    return _best(spots, lambda known: _pairs(known, presets, max_m), F.col("distance_m"))


def _clear_enough(spots: DataFrame, presets: DataFrame, max_m: float, size: float) -> DataFrame:
    """(shape, ci, cj, preset facts): per cell of spots the presets around it that may be the clearest within max_m of a spot.

    A preset cell that lies within max_m as a whole sets a bar for its spots; presets less clear than the bar are out.
    """
    from strideframe.operators.cells import square

    rank = _first(-F.col("similarity"))
    ready = _ready(presets).withColumns({"pi": geo.cell(F.col("p_lat"), size), "pj": geo.cell(F.col("p_lon"), size), "rank": rank})
    corners = [f(f"{p}{c}").alias(f"{o}_{c}_{n}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max)) for p, o in (("", "s"), ("p_", "p"))]
    own = spots.groupBy("shape", geo.cell(F.col("lat"), size).alias("ci"), geo.cell(F.col("lon"), size).alias("cj")).agg(*corners[::2])
    there = ready.groupBy("shape", "pi", "pj").agg(F.min("rank").alias("top"), *corners[1::2])
    near = own.withColumn("o", F.explode(square(FINER + 1))).withColumns({"pi": F.col("ci") + F.col("o.di"), "pj": F.col("cj") + F.col("o.dj")}).drop("o")
    span = [F.greatest(F.col(f"s_{c}_hi") - F.col(f"p_{c}_lo"), F.col(f"p_{c}_hi") - F.col(f"s_{c}_lo")) for c in ("lat", "lon")]
    far = geo.hypot(*[d * geo.M_PER_DEG_LON_EQUATOR * 1.001 for d in span])  # no distance inside is longer, at any latitude
    # a cell is exploded to hundreds of rows, which Spark takes for one and would broadcast, so the ways of the joins are named
    cells = near.join(there.hint("shuffle_hash"), ["shape", "pi", "pj"])
    bar = cells.where(far <= max_m).groupBy("shape", "ci", "cj").agg(F.min("top").alias("bar"))
    live = cells.select("shape", "ci", "cj", "pi", "pj", "top").join(bar.hint("shuffle_hash"), ["shape", "ci", "cj"], "left").where(F.col("bar").isNull() | (F.col("top") <= F.col("bar")))
    kept = live.drop("top").join(ready.hint("shuffle_hash"), ["shape", "pi", "pj"]).where(F.col("bar").isNull() | (F.col("rank") <= F.col("bar")))
    return kept.drop("pi", "pj", "bar", "rank")


def relocation(spots: DataFrame, presets: DataFrame, max_m: float = RELOCATE_M) -> DataFrame:
    """Best preset to move to: clearest shape, then closest (then balance, which is equal where these are); null where there is none."""
    size = max_m / NARROW_M_PER_DEG / FINER
    spots = spots.select("lat", "lon", "shape").distinct()
    clear = cut(_clear_enough(spots, presets, max_m, size))

    def meet(known: DataFrame) -> DataFrame:
        placed = known.withColumns({"ci": geo.cell(F.col("lat"), size), "cj": geo.cell(F.col("lon"), size)})
        return _measured(_by_cell(placed, clear), max_m)

    return spots.join(_best(spots, meet, -F.col("similarity"), F.col("distance_m")), ["lat", "lon", "shape"], "left")


def move_facts(distance_m: Column) -> dict[str, Column]:
    """What a moved start costs: metres rounded to 50, minutes on foot, and whether it is the same place."""
    return {"move_m": (F.rint(distance_m / 50.0) * 50).cast("long"),
            "walk_min": F.greatest(F.lit(1), F.rint(distance_m / 80.0)).cast("long"), "is_exact": distance_m < EXACT_M}


def per_shape(df: DataFrame, shapes: tuple[str, ...]) -> DataFrame:
    """Every row once per shape of a short fixed list, with the shape's position."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("shape")) for i, s in enumerate(shapes)])
    return df.withColumn("_s", F.explode(rows)).select(*df.columns, "_s.position", "_s.shape")


def survey(places: DataFrame, presets: DataFrame, shapes: tuple[str, ...]) -> DataFrame:
    """One row per place and shape: the exact preset, else the nearest one, else none.

    places: place_id, lat, lon, wanted_km (null = open). `featured` marks the shape to show first: closest to
    the wanted distance, or the clearest and shortest; only presets that start
    here count.
    """
    asked = per_shape(places, shapes)
    own = lookup(asked.withColumns({"include_hills": F.lit(False), "night_mode": F.lit(False), "need_facilities": F.array().cast("array<string>")}), presets)
    near = nearest(own.where("outcome <> 'found'"), presets).select(
        "lat", "lon", "shape", F.col("length_m").alias("n_length"), F.col("similarity").alias("n_sim"), F.col("distance_m"))
    rows = own.join(near, ["lat", "lon", "shape"], "left")
    exact = F.col("outcome") == "found"
    here = exact | (F.col("distance_m") < EXACT_M)
    rows = rows.select(
        "place_id", "shape", "position", "wanted_km",
        F.when(exact, "exact").when(F.col("n_length").isNotNull(), "nearby").otherwise("none").alias("source"),
        F.coalesce(F.when(exact, F.col("length_m")), F.col("n_length")).alias("length_m"),
        F.coalesce(F.when(exact, F.col("similarity")), F.col("n_sim")).alias("similarity"),
        F.when(exact, 0.0).otherwise(F.col("distance_m")).alias("distance_m"), F.coalesce(here, F.lit(False)).alias("starts_here"))
    km = F.col("length_m") / 1000.0
    off = F.when(F.col("wanted_km").isNotNull(), geo.half_even(F.abs(km - F.col("wanted_km")))).otherwise(-F.col("similarity"))
    tie = F.when(F.col("wanted_km").isNotNull(), -F.col("similarity")).otherwise(km)
    pick = rows.where("starts_here").groupBy("place_id").agg(F.min(F.struct(off.alias("a"), tie.alias("b"), "position")).alias("m")).select(
        "place_id", F.col("m.position").alias("f_position"))
    return (rows.join(pick, "place_id", "left").withColumn("featured", F.coalesce(F.col("position") == F.col("f_position"), F.lit(False)))
            .drop("f_position", "position"))


def distance_decision(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """requests (request_id, lat, lon, shape, distance_km, include_hills, night_mode, need_facilities) plus decision.

    serve: a preset here is within 10 % of the asked distance; suggest: the ask
    is shorter than what that preset was asked for; relocate: the nearest preset
    starts elsewhere; generate: anything else. Hills, night and facilities are
    never answered by a preset, so such requests are generated.
    """
    own = cut(lookup(requests, presets))  # read three times below
    open_ = (F.col("outcome") != "found") & is_plain()
    near = nearest(own.where(open_), presets).select("lat", "lon", "shape", F.col("length_m").alias("n_length"), F.col("preset_km").alias("n_km"), "distance_m")
    # rows that bypass the presets skip the join; other requests may have their spot
    blank = [F.lit(None).cast("double").alias(c) for c in ("n_length", "n_km", "distance_m")]
    rows = own.where(~open_).select("*", *blank).unionByName(own.where(open_).join(near, ["lat", "lon", "shape"], "left"))
    clean = F.coalesce(F.when(F.col("outcome") == "found", F.col("length_m")), F.col("n_length"))
    least_km = F.coalesce(F.when(F.col("outcome") == "found", F.col("preset_km")), F.col("n_km"))
    km = clean / 1000.0
    moved = (F.col("outcome") != "found") & F.col("distance_m").isNotNull() & (F.col("distance_m") >= EXACT_M)
    decision = (F.when(clean.isNull(), "generate").when(moved, "relocate")
                .when(geo.half_even(F.abs(km - F.col("distance_km")) / F.col("distance_km")) <= 0.10, "serve")
                .when(F.col("distance_km") < least_km, "suggest").otherwise("generate"))
    return rows.withColumns({"decision": decision, "clean_km": km})


def remaining_work(stations: DataFrame, shapes: tuple[str, ...], done: DataFrame, retry_unavailable: bool = False) -> DataFrame:
    """(lat, lon, shape) jobs not in `done`; with retry also those done without a course."""
    finished = done.where("available") if retry_unavailable else done
    jobs = keyed(per_shape(stations, shapes).drop("position"))
    return jobs.join(keyed(finished).select("preset_key"), "preset_key", "left_anti").drop("preset_key")


def inventory(presets: DataFrame) -> DataFrame:
    return presets.agg(F.count_if("available").alias("verified"), F.count_if(~F.col("available")).alias("unavailable"), F.count("*").alias("total"))


def unique_by_place(stations: DataFrame) -> DataFrame:
    """One row per coordinate, the last one listed (highest station_seq)."""
    rest = [c for c in stations.columns if c not in ("lat", "lon", "station_seq")]
    return (stations.groupBy("lat", "lon").agg(F.max(F.struct("station_seq", *rest)).alias("s"))
            .select("lat", "lon", "s.*"))


def alias_lookup(stations: DataFrame) -> DataFrame:
    """(query_key, lat, lon, name): first listed station wins an alias."""
    spelled = stations.select("station_seq", "lat", "lon", text.station_name(F.col("official_name")).alias("name"), F.explode(
        text.station_aliases(F.col("line"), F.col("official_name"), F.col("road_address"), F.col("lot_address"))).alias("alias"))
    return (spelled.groupBy(text.query_key(F.col("alias")).alias("query_key"))
            .agg(F.min(F.struct("station_seq", "lat", "lon", "name")).alias("s")).select("query_key", "s.lat", "s.lon", "s.name"))


def resolve_locations(queries: DataFrame, gazetteer: list[tuple[str, float, float]], stations: DataFrame) -> DataFrame:
    """queries (query_id, location, lat, lon) plus where they were found.

    Rungs: coordinates, exact gazetteer name, station alias, then for short
    place-like texts the first gazetteer name contained either way; else a
    row with an error. The gazetteer is a short fixed list.
    """
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("lat"), F.lit(o).alias("lon")) for n, a, o in gazetteer])
    squeezed = F.regexp_replace(F.coalesce("location", F.lit("")), " ", "")
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    texts = queries.where(~given & F.col("location").isNotNull()).select("location").distinct()
    texts = texts.withColumns({"q": squeezed, "query_key": text.query_key(F.col("location"))})
    station = alias_lookup(stations).select("query_key", F.struct("name", "lat", "lon").alias("station"))
    exact = F.get(F.filter(names, lambda g: g["name"] == F.col("q")), F.lit(0))
    short = ~text.looks_like_address(F.col("location")) & F.length("q").between(2, 10)
    fuzzy = F.when(short, F.get(F.filter(names, lambda g: F.col("q").contains(g["name"]) | g["name"].contains(F.col("q"))), F.lit(0)))
    found = texts.join(station, "query_key", "left").select(
        F.col("location").alias("t"), F.when(exact.isNotNull(), 2).when(F.col("station").isNotNull(), 3).when(fuzzy.isNotNull(), 4).alias("t_rung"),
        F.coalesce(exact, F.col("station"), fuzzy).alias("hit"))
    named = ~given & F.col("location").isNotNull()
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema]
    rows = (queries.where(named).join(found, F.col("location") == F.col("t"), "left")
            .unionByName(queries.where(~named).select("*", *blank)))
    inside = geo.in_service_box(F.col("lat"), F.col("lon"))
    rung = F.when(given, F.when(inside, 1).otherwise(9)).otherwise(F.coalesce("t_rung", F.lit(9)))
    error = (F.when(given & ~inside, "outside").when(given, None).when(F.col("location").isNull(), "missing").when(F.col("hit").isNull(), "unknown"))
    label = F.coalesce("location", F.concat(F.lit("("), text.fixed(F.col("lat"), 4), F.lit(", "), text.fixed(F.col("lon"), 4), F.lit(")")))
    ok = error.isNull()
    return rows.select(
        "query_id", rung.alias("rung"), F.when(ok, F.when(given, F.col("lat")).otherwise(F.col("hit.lat"))).alias("lat"),
        F.when(ok, F.when(given, F.col("lon")).otherwise(F.col("hit.lon"))).alias("lon"),
        F.when(ok, F.when(given, label).otherwise(F.col("hit.name"))).alias("name"), error.alias("error"))


# Cell sizes tried one after the other; the last one holds every coordinate.
WIDENING_DEG = (0.02, 0.16, 1.28, 400.0)


def weekly_recommendation(users: DataFrame, completed: DataFrame, courses: DataFrame, week: int) -> DataFrame:
    """users (user_id, lat, lon) plus the course to try next, null when all are done.

    Not completed courses of shapes not yet seen come first, else any not
    completed one. Order: distance in 250 m bands, a weekly rotation of the
    course id's hash, clearest shape. courses: course_key, course_ref, shape,
    lat, lon, similarity. Users join courses on cells of growing size; one whose
    best course is farther than the cell guarantees tries the next size, so
    only users far from every course ever meet distant ones.
    """
    from strideframe.operators.cells import square

    turn = F.conv(F.substring(F.sha2("course_ref", 256), 1, 8), 16, 10).cast("long")
    pool = courses.select("course_key", "shape", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), "similarity", ((turn + week) % 97).alias("turn"))
    total, kinds = (courses.agg(F.count("*").alias("n"), F.count_distinct("shape").alias("k")).first())
    done = completed.select("user_id", "course_key").distinct()
    seen = completed.join(courses.select("shape").distinct(), "shape", "left_semi").select("user_id", "shape").distinct().withColumn("seen", F.lit(True))
    spent = done.groupBy("user_id").agg(F.count("*").alias("n"))
    known = seen.groupBy("user_id").agg(F.count("*").alias("k"))
    left = (users.select("user_id", "lat", "lon").join(spent, "user_id", "left").where(F.coalesce("n", F.lit(0)) < total).drop("n")
            .join(known, "user_id", "left").withColumn("all_seen", F.coalesce("k", F.lit(0)) >= kinds).drop("k"))
    out = None
    for size in WIDENING_DEG:
        a = left.withColumns({"ci": geo.cell(F.col("lat"), size), "cj": geo.cell(F.col("lon"), size)})
        c = pool.withColumn("o", F.explode(square(1))).withColumns(
            {"ci": geo.cell(F.col("c_lat"), size) + F.col("o.di"), "cj": geo.cell(F.col("c_lon"), size) + F.col("o.dj")}).drop("o")
        d = geo.haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
        pairs = a.join(c, ["ci", "cj"]).join(done, ["user_id", "course_key"], "left_anti").join(seen, ["user_id", "shape"], "left")
        best = pairs.groupBy("user_id", "all_seen").agg(F.min(F.struct(
            F.coalesce("seen", F.lit(False)).alias("seen"), F.rint(geo.half_even(d / 250.0)).cast("long").alias("band"), "turn",
            (-F.col("similarity")).alias("s"), "course_key", "shape")).alias("m"))
        # sure when the best lies inside the guaranteed reach and no unseen shape can be left outside it
        sure = (~F.col("m.seen") | F.col("all_seen")) & ((F.col("m.band") + 1) * 250.0 <= size * NARROW_M_PER_DEG)
        picked = best.where(sure | F.lit(size == WIDENING_DEG[-1])).select("user_id", "m.course_key", "m.shape", "m.band")
        out = picked if out is None else out.unionByName(picked)
        left = left.join(picked, "user_id", "left_anti")
        if size == WIDENING_DEG[-1] or not any_row(left):
            break
        left = cut(left)
    return users.select("user_id").join(out, "user_id", "left")
