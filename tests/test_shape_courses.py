"""The stages around the shape search: passes, sweeps, the resumable build and the staged answers. The search itself is stood in for where only the rules count."""

import pytest
from pyspark.sql import functions as F

from strideframe.operators import cells, graph
from strideframe.plans import shape_courses, shape_search
from strideframe.plans.requests import SIM_TOLERANCE
from strideframe.sources import files
from strideframe.sources import shapes as cat

AT = "request_id long, lat double, lon double, shape string, distance_km double"


class Drawn:
    """A search that finds a course a little longer than asked, with a similarity given per (shape, km); counts its requests."""

    def __init__(self, clear, usable=lambda shape, km: True):
        self.clear, self.usable, self.asked = clear, usable, []

    def __call__(self, requests, nodes, edges, *, relaxed=False, **_):
        rows = requests.collect()
        self.asked += [(r.request_id, r.shape, r.distance_km, relaxed) for r in rows]
        found = [(r.request_id, r.shape, r.distance_km * 1010.0, self.clear(r.shape, r.distance_km, relaxed), self.usable(r.shape, r.distance_km), r.request_id) for r in rows
                 if self.clear(r.shape, r.distance_km, relaxed) is not None]
        spark = requests.sparkSession
        best = spark.createDataFrame(found, "request_id long, shape string, length_m double, sim double, usable boolean, cand_id long")
        ways = spark.createDataFrame([(f[0], k, int(10 * f[2]) + k) for f in found for k in range(3)], "request_id long, seq long, node_id long")
        return best, ways


def full_sweep(clear, shape, start=0.0):
    """All distances in their order, stopped by hand: (km asked, similarity) of the kept course and the number tried."""
    least = max(start, cat.MIN_KM[shape])
    if least > cat.MAX_ART_KM:
        return None, 0
    km = [least + i for i in range(round(cat.MAX_ART_KM - least) + 1)]
    preferred = max(least, cat.PREFERRED_KM[shape])
    best, n = None, 0
    for d in sorted(km, key=lambda d: (abs(d - preferred), d)):
        n += 1
        sim = clear(shape, d, False)
        if sim is not None and sim >= cat.STYLES[shape]["gate"] and d * 1.01 <= cat.MAX_ART_KM:
            if best is None or sim > best[1] + SIM_TOLERANCE or (abs(sim - best[1]) <= SIM_TOLERANCE and d < best[0]):
                best = d, sim
        if best and best[1] >= shape_search.GOOD_ENOUGH:
            break
    return best, n


def test_sweep_leaves_at_the_first_clear_distance(spark, monkeypatch):
    def clear(shape, km, relaxed):
        return {"dog": {9.0: 0.685, 8.0: 0.69, 10.0: 0.95}, "cat": {7.0: 0.71}, "whale": {5.0: 0.5}, "rabbit": {3.0: 0.9}}[shape].get(km, 0.1)

    drawn = Drawn(clear)
    monkeypatch.setattr(shape_search, "search", drawn)
    asked = [(i, 37.5, 127.0, s, km) for i, (s, km) in enumerate([("dog", None), ("cat", None), ("whale", 4.0), ("rabbit", None), ("cat", 12.0), ("cat", 7.0)])]
    answers, ways, searched = shape_search.first_clear_distance(spark.createDataFrame(asked, AT), None, None)
    got = {r.request_id: (r.distance_km, r.sim) for r in answers.collect()}
    walked = {r.request_id: r.node_id for r in ways.where("seq = 0").collect()}
    tried = {r["request_id"]: r["count"] for r in searched.groupBy("request_id").count().collect()}
    assert len(drawn.asked) == sum(tried.values()) < sum(round(11 - max(km or 0, cat.MIN_KM[s])) + 1 for _, _, _, s, km in asked[:4])
    for i, _, _, s, km in asked:
        best, n = full_sweep(clear, s, km or 0.0)
        assert got.get(i) == best and tried.get(i, 0) == n
        assert best is None or walked[i] == int(10 * (best[0] * 1010.0))
    assert tried[0] == 3 and got[0] == (10.0, 0.95) and 2 not in got and 4 not in tried


def test_relaxed_pass_replaces_but_ships_only_over_the_strict_gate(spark, monkeypatch):
    gate = cat.STYLES["cat"]["gate"]
    strict = {1: 0.9, 2: gate - 0.10, 3: gate - 0.10, 4: gate - 0.02, 5: None, 6: None, 7: 0.9}
    loose = {2: gate + 0.05, 3: gate - 0.07, 4: gate + 0.02, 5: gate + 0.01, 6: None, 7: 0.95}
    drawn = Drawn(lambda s, km, relaxed: (loose if relaxed else strict)[int(km)], lambda s, km: km != 7)
    monkeypatch.setattr(shape_search, "search", drawn)
    requests = spark.createDataFrame([(i, 37.5, 127.0, "cat", float(i)) for i in range(1, 8)], AT)
    courses, ways = shape_search.shaped_courses(requests, None, None)
    got = {r.request_id: (r.relaxed, r.shipped, round(r.sim, 3)) for r in courses.collect()}
    assert got == {1: (False, True, 0.9),  # strict is fine
                   2: (True, True, round(gate + 0.05, 3)),  # relaxed wins and ships
                   3: (False, False, round(gate - 0.10, 3)),  # relaxed is no clear gain
                   4: (False, False, round(gate - 0.02, 3)),  # over the gate, but by less than the gain over the strict one
                   5: (True, True, round(gate + 0.01, 3)),  # nothing strict
                   7: (False, False, 0.9)}  # neither is usable
    assert [a[0] for a in drawn.asked if a[3]] == [2, 3, 4, 5, 6, 7]
    assert {r.request_id for r in ways.collect()} == {1, 2, 3, 4, 5, 7}


def test_build_goes_on_where_it_was_cut_off(spark, monkeypatch, tmp_path):
    def clear(shape, km, relaxed):
        return 0.9 if shape in ("dog", "cat") and km == 6 else 0.1

    stations = spark.createDataFrame([(37.45 + i / 100, 126.85) for i in range(6)], "lat double, lon double")
    monkeypatch.setattr(shape_search, "search", Drawn(clear))
    whole = sorted(map(str, shape_search.resume_presets(stations, f"{tmp_path}/one", None, None, batch_jobs=1000).collect()))
    assert len(whole) == 24 and sum("available=True" in r for r in whole) == 12

    write, calls = files.append_results, []

    def cut_off(rows, path, batch):
        write(rows, path, batch)
        calls.append(batch)
        if len(calls) == 2:
            raise KeyboardInterrupt  # the second batch is written but never committed

    monkeypatch.setattr(files, "append_results", cut_off)
    with pytest.raises(KeyboardInterrupt):
        shape_search.resume_presets(stations, f"{tmp_path}/two", None, None, batch_jobs=6)
    first = shape_search.stored_presets(spark, f"{tmp_path}/two").count()
    assert 0 < first < 24
    drawn = Drawn(clear)
    monkeypatch.setattr(shape_search, "search", drawn)
    again = shape_search.resume_presets(stations, f"{tmp_path}/two", None, None, batch_jobs=6)
    assert sorted(map(str, again.collect())) == whole
    assert len({a[0] // 100 for a in drawn.asked}) <= 24 - first  # committed jobs are not run again
    # unavailable rows can be run once more; the newer row counts
    monkeypatch.setattr(shape_search, "search", Drawn(lambda s, km, relaxed: 0.9 if km == 6 else 0.1))
    retried = shape_search.resume_presets(stations, f"{tmp_path}/two", None, None, batch_jobs=100, retry_unavailable=True)
    assert retried.count() == 24 and retried.where("available").count() == 24


def test_every_request_gets_one_way(spark, monkeypatch):
    def clear(shape, km, relaxed):
        return {"dog": 0.9, "cat": 0.3, "whale": 0.9 if km <= 5 else 0.2, "rabbit": 0.2}[shape]

    monkeypatch.setattr(shape_search, "search", Drawn(clear))
    here, there, far = (37.5, 127.0), (37.51, 127.0), (37.6, 127.1)
    table = spark.createDataFrame([(*here, "dog", "spot", True, 9000.0, 0.8, 8.0), (*here, "cat", "spot", False, None, None, None), (*there, "cat", "next", True, 5000.0, 0.75, 5.0)],
                                  "lat double, lon double, shape string, name string, available boolean, length_m double, similarity double, distance_km double")
    asked = [(1, *here, "dog", 9.0, False, "serve", "preset"), (2, *here, "dog", 6.0, False, "suggest", "preset"), (3, *here, "cat", None, False, "relocate", "preset"),
             (4, *here, "dog", 11.0, False, "search", "search"), (5, *far, "dog", None, False, "serve", "sweep"), (6, *far, "whale", 9.0, False, "refuse", "search"),
             (7, *here, None, None, False, "survey", "preset"), (8, *here, "cow", 5.0, False, "refuse", "request"), (9, *far, "rabbit", None, False, "refuse", "preset"),
             (10, *here, "dog", 9.0, True, "serve", "sweep"), (11, *far, "dog", 6.0, False, "suggest", "sweep"), (12, *far, "dog", 2.0, False, "suggest", "sweep")]
    requests = spark.createDataFrame([(i, a, o, s, km, hills, False, None) for i, a, o, s, km, hills, _, _ in asked],
                                     AT + ", include_hills boolean, night_mode boolean, need_facilities array<string>")
    empty = spark.createDataFrame([], "x long")
    answers, ways = shape_courses.plan_shape_courses(requests, table, empty, empty)
    got = {r.request_id: r for r in answers.collect()}
    assert answers.count() == len(asked)
    assert {i: (r.way, r.source) for i, r in got.items()} == {a[0]: a[6:] for a in asked}
    assert got[3].preset_name == "next" and 1000 < got[3].distance_m < 1200 and (got[3].start_lat, got[3].km) == (37.51, 5.0)
    assert got[2].km == 9.0 and got[7].shape == "dog" and got[6].alternatives == ["dog"] and got[8].reason == "unknown shape"
    assert {r.request_id for r in ways.collect()} == {4, 5, 10, 11, 12}  # drawn here, suggested ones too


# ---- searches next to their arcs ----------------------------------------------------------------

def test_routes_try_wider_ways_and_share_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_SEARCHES", 2)
    nodes = spark.createDataFrame([(i, 37.5 + i * 1e-4, 127.0) for i in range(6)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 2, 1.0, 9.0), (0, 2, 5.0, 1.0), (2, 3, 1.0, 1.0), (4, 5, 1.0, 1.0)], "u long, v long, length_m double, narrow double")
    adj = graph.adjacency(edges, nodes, {"length_m": F.col("length_m"), "narrow": F.col("narrow")})

    def weigh(search, arcs):
        import numpy as np

        yield np.where(arcs["narrow"] < 5, arcs["length_m"], np.inf)
        yield arcs["length_m"]

    box = spark.range(1).select(F.lit(37.5).alias("lat"), F.lit(127.0).alias("lon")).withColumns(cells.area_box(F.lit(3000.0))).drop("lat", "lon")
    asked = spark.createDataFrame([(0, 0, [2, 3, 0]), (1, 1, [2]), (2, 3, [5]), (3, 4, [5]), (4, 99, [0])], "search_id long, source long, targets array<long>").crossJoin(box)
    got = {}
    for r in graph.routes(asked, adj, weigh, ["length_m", "narrow"]).orderBy("search_id", "target", "seq").collect():
        got.setdefault((r.search_id, r.target), ([], r.attempt, r.d))[0].append(r.node_id)
    assert got == {(0, 2): ([0, 2], 0, 5.0), (0, 3): ([0, 2, 3], 0, 6.0), (0, 0): ([0], 0, 0.0), (1, 2): ([1, 0, 2], 0, 6.0), (3, 5): ([4, 5], 0, 1.0)}
    only = spark.createDataFrame([(1, 1, [2])], "search_id long, source long, targets array<long>").crossJoin(box)
    blocked = graph.adjacency(edges.where("NOT (u = 0 AND v = 2)"), nodes, {"length_m": F.col("length_m"), "narrow": F.col("narrow")})
    assert {(r.attempt, r.d) for r in graph.routes(only, blocked, weigh, ["length_m", "narrow"]).collect()} == {(1, 1.0)}
    # the whole tree: ties go to the smaller parent, unreachable nodes are left out
    square = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)], "u long, v long, length_m double")
    tree = graph.shortest_paths(only.withColumn("source", F.lit(0).cast("long")).drop("targets"), graph.adjacency(square, nodes, {"length_m": F.col("length_m")}),
                                lambda search, arcs: iter([arcs["length_m"]]), ["length_m"])
    assert sorted((r.node, r.d, r.parent) for r in tree.collect()) == [(0, 0.0, None), (1, 1.0, 0), (2, 1.0, 0), (3, 2.0, 1)]
