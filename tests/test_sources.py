"""Readers over files of the shape the raw layers have."""

import gzip
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from strideframe.functions import geo, score
from strideframe.operators import edges as ed
from strideframe.plans import requests as rq
from strideframe.sources import exports, files


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp949"])
def test_csv_encodings_and_header_words(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes("관리번호,위도,경도\n1,37.5,127.0\n2,x,127.0\n3,38.9,127.0\n".encode(encoding))
    raw = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.lat, r.lon) for r in files.streetlights(raw).collect()] == [(37.5, 127.0)]


def test_plane_systems(spark):
    one = spark.range(1)
    r = one.select(geo.plane_5186_to_wgs84(F.lit(200000.0), F.lit(600000.0)).alias("p")).first().p
    assert abs(r.lat - 38.0) < 1e-9 and abs(r.lon - 127.0) < 1e-9
    there = one.select(geo.project(F.lit(37.55), F.lit(126.9), geo.PLANE_5174).alias("q"))
    back = there.select(geo.unproject(F.col("q.x"), F.col("q.y"), geo.PLANE_5174).alias("p"))
    p = back.first().p
    assert abs(p.lat - 37.55) < 1e-9 and abs(p.lon - 126.9) < 1e-9
    w = one.select(geo.plane_5174_to_wgs84(F.lit(200000.0), F.lit(450000.0)).alias("p")).first().p
    assert abs(w.lat - 37.549) < 0.005 and abs(w.lon - 127.0008) < 0.005


def test_raster_tiles(spark, tmp_path):
    values = [10, 20, 30, 40, -32768, 60, 70, 80, 90]
    (tmp_path / "N37E126.hgt").write_bytes(struct.pack(">9h", *values))
    cells = files.raster_tiles(spark, str(tmp_path), size=3)
    assert {(r.r, r.c): r.elev for r in cells.collect()} == {(i // 3, i % 3): (None if v == -32768 else float(v)) for i, v in enumerate(values)}
    at = files.raster_position(spark.createDataFrame([(1, 37.9, 126.1), (2, 37.0, 126.99)], "node_id long, lat double, lon double"), size=3)
    got = {r.node_id: r.elev for r in ed.bilinear_sample(at, cells, (3, 3), ["tile_lat", "tile_lon"]).collect()}
    assert got[1] == 10.0  # one corner unknown: the first known one
    assert abs(got[2] - 89.8) < 1e-9  # past the last row the edge repeats


def test_vertices_and_heights(spark):
    line = spark.createDataFrame([("a", [[(float(i), 0.0) for i in range(14)]], 5.0)], "line_id string, parts array<array<struct<x:double,y:double>>>, height double")
    assert sorted(r.x for r in files.line_vertices(line).collect()) == [0.0, 6.0, 12.0]


def test_preset_gates(spark, tmp_path):
    rows = [dict(format_version=1, graph_fingerprint="f", key="a", course=dict(length_m=1.0, ascent_m=0.0, shape_similarity=0.8)),
            dict(format_version=1, graph_fingerprint="f", key="b", course=None), dict(format_version=2, graph_fingerprint="f", key="c", course=None),
            dict(format_version=1, graph_fingerprint="old", key="d", course=None)]
    with gzip.open(tmp_path / "p.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    got = {r.preset_key: r.available for r in files.read_presets(spark, str(tmp_path / "p.json.gz"), "f").collect()}
    assert got == {"a": True, "b": False}


def test_file_audit(spark, tmp_path):
    for n in ("ok", "bad", "new"):
        (tmp_path / n).write_bytes(n.encode())
    manifest = spark.createDataFrame([("ok", hashlib.sha256(b"ok").hexdigest()), ("bad", "0")], "name string, sha256 string")
    assert {r.name: r.verdict for r in files.audit_files(spark, str(tmp_path), manifest).collect()} == {"ok": "ok", "bad": "mismatch", "new": "unregistered"}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, 37.4 + i * 0.01, 127.0) for i in range(20)], "node_id long, lat double, lon double")
    exports.write_by_cell(df, str(tmp_path / "nodes"))
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 20
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(30)], "course_id long, line_no long, text string")
    exports.write_documents(lines, str(tmp_path / "docs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "docs")).collect()] == [f"l{i}" for i in range(30)]
    files.append_results(df, str(tmp_path / "build"), 0)
    files.append_results(df, str(tmp_path / "build"), 0)
    assert spark.read.parquet(str(tmp_path / "build")).count() == 20


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "i long, s string")
    b = spark.createDataFrame([(2, "b"), (1, "a")], "i long, s string")
    c = spark.createDataFrame([(2, "b"), (1, "c")], "i long, s string")
    one, two, three = (files.fingerprint(d).first().fingerprint for d in (a, b, c))
    assert one == two != three and len(one) == 20


def test_request_ranges(spark):
    df = spark.createDataFrame([(1, 37.5, 127.0, 5.0), (2, 36.0, 127.0, 5.0), (3, 37.5, 127.0, 50.0), (4, None, 127.0, 5.0)],
                               "request_id long, lat double, lon double, distance_km double")
    good, bad = rq.valid_requests(df)
    assert [r.request_id for r in good.collect()] == [1] and bad.count() == 3


def test_missing_values_are_neutral(spark):
    row = spark.createDataFrame([(None,) * 6], "sidewalk_score double, slope_pct double, lighting_score double, cctv_score double, park_score double, crossing_score double")
    got = row.select(score.edge_rfs().alias("s")).first().s
    want = 0.25 + 0.75 * (0.25 * 0.5 + 0.20 * (2 / 3) + 0.15 * 0.5 + 0.10 * 0.5 + 0.10 * 0.5)
    assert abs(got - want) < 1e-12


def test_encoding_is_that_of_the_whole_file(spark, tmp_path):
    """An ASCII header and first lines over a Korean body; a UTF-8 file with a mark; one that fits nothing."""
    body = "".join(f"{i},{'plain' if i < 2000 else '서울숲 뚝섬'},\"a, b\"\r\n" for i in range(2003))
    (tmp_path / "korean.csv").write_bytes(("id,name,note\r\n" + body).encode("cp949"))
    got = files.read_csv(spark, f"{tmp_path}/korean.csv")
    rows = got.collect()
    assert got.columns == ["id", "name", "note"] and len(rows) == 2003
    assert [r.name for r in rows if int(r.id) >= 1999] == ["plain"] + ["서울숲 뚝섬"] * 3 and {r.note for r in rows} == {"a, b"}
    (tmp_path / "utf.csv").write_bytes("\ufeff위도,경도\n37.5,127.0\n".encode())
    assert files.read_csv(spark, f"{tmp_path}/utf.csv").columns == ["위도", "경도"]
    (tmp_path / "none.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/none.csv")
