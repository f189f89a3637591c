"""Readers and cleaners for the raw layers of a network build."""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strideframe.functions import geo

# --- fixed values -----------------------------------------------------------
ENCODINGS = ("UTF-8", "cp949", "euc_kr")
LAT_WORDS, LON_WORDS = ("위도", "lat", "y좌표", "ycoord"), ("경도", "lon", "x좌표", "xcoord")
X_WORDS, Y_WORDS = ("x좌표", "x"), ("y좌표", "y")
ROUTE_WORDS, WIDTH_WORDS = ("노선명",), ("폭",)
VERTEX_STRIDE = 6
RASTER_SIZE = 3601
RASTER_NULL = -32768
POI_TAGS = {("shop", "convenience"): "convenience_store", ("amenity", "toilets"): "restroom",
            ("amenity", "drinking_water"): "water", ("leisure", "park"): "park"}
GREEN_TAGS = {"leisure": ("park", "nature_reserve", "garden"), "landuse": ("grass", "forest", "recreation_ground"), "natural": ("water",)}
PRESET_FORMAT = 1
# ----------------------------------------------------------------------------


def _code_page(spark: SparkSession, path: str) -> str:
    """The first of ENCODINGS in which every line of the files decodes; one pass over their bytes."""
    def tally(batches):
        for batch in batches:
            bad = [0] * len(ENCODINGS)
            for line in batch.column("line").to_pylist():
                if line.isascii():
                    continue
                for k, encoding in enumerate(ENCODINGS):
                    try:
                        line.decode(encoding)
                    except UnicodeDecodeError:
                        bad[k] += 1
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()) for b in bad], names=[f"bad{k}" for k in range(len(ENCODINGS))])

    # The text source hands on the bytes of a line as they are.
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line"))
    bad = lines.mapInArrow(tally, ", ".join(f"bad{k} long" for k in range(len(ENCODINGS)))).agg(*[F.sum(f"bad{k}") for k in range(len(ENCODINGS))]).first()
    for encoding, n in zip(ENCODINGS, bad):
        if not n:
            return encoding
    raise ValueError(f"no known encoding fits {path}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text, in the first encoding in which the whole file decodes.

    UTF-8 is read by Spark's own reader. Lines of other code pages are decoded in
    Arrow batches and then parsed; a record may not go over several lines there.
    """
    encoding = _code_page(spark, path)
    if encoding == "UTF-8":
        df = spark.read.csv(path, header=True)
        return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])

    def decode(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line.decode(encoding) for line in batch.column("line").to_pylist()], pa.string())], names=["line"])

    raw = spark.read.text(path)
    lines = raw.select(F.col("value").cast("binary").alias("line")).mapInArrow(decode, "line string").where("line <> ''")
    header = lines.first()[0]
    names = next(csv.reader([header]))
    schema = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
    parsed = lines.where(F.col("line") != header).select(F.from_csv("line", schema.simpleString()[7:-1].replace(":", " ")).alias("r"))
    return parsed.select(*[F.col(f"r.c{k}").alias(c) for k, c in enumerate(names)])


def find_column(columns: list[str], *words: str) -> str:
    """First header that contains any of the words."""
    for name in columns:
        low = name.strip().lower()
        if any(w.lower() in low for w in words):
            return name
    raise ValueError(f"no column for {words} among {columns}")


def number(name: str) -> Column:
    return F.trim(F.col(f"`{name}`")).try_cast("double")


def _inside(df: DataFrame) -> DataFrame:
    """Rows whose position _at lies in the network box, with it as lat, lon."""
    return (df.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).drop("_at")
            .where(geo.in_network_box(F.col("lat"), F.col("lon"))))


def streetlights(raw: DataFrame) -> DataFrame:
    """Raw rows plus lat, lon: degrees inside the network box, else plausible plane pairs reprojected; others go."""
    lat, lon = number(find_column(raw.columns, *LAT_WORDS)), number(find_column(raw.columns, *LON_WORDS))
    parsed = raw.withColumns({"_a": lat, "_o": lon}).where(F.col("_a").isNotNull() & F.col("_o").isNotNull())
    plain = geo.in_network_box(F.col("_a"), F.col("_o"))
    plane = F.col("_o").between(100_000, 300_000) & F.col("_a").between(400_000, 700_000)
    at = (F.when(plain, F.struct(F.col("_a").alias("lat"), F.col("_o").alias("lon")))
          .when(plane, geo.plane_5186_to_wgs84(F.col("_o"), F.col("_a"))))
    return _inside(parsed.withColumn("_at", at)).drop("_a", "_o")


def signals(raw: DataFrame) -> DataFrame:
    """Raw rows plus lat, lon of their plane coordinates, inside the network box."""
    x, y = number(find_column(raw.columns, *X_WORDS)), number(find_column(raw.columns, *Y_WORDS))
    return _inside(raw.withColumn("_at", geo.plane_5186_to_wgs84(x, y)))


def restrooms(raw: DataFrame, x: str = "x 좌표", y: str = "y 좌표", names: tuple[str, ...] = ("건물명", "도로명주소", "지번주소")) -> DataFrame:
    """Raw rows plus type, name, lat, lon, source; name is the first usable of the given columns."""
    def clean(c: str) -> Column:
        text = F.regexp_replace(F.trim(F.col(f"`{c}`")), r"^\|+|\|+$", "")
        return F.when(text != "", text)

    out = raw.withColumns({"lat": number(y), "lon": number(x)}).where(geo.in_service_box(F.col("lat"), F.col("lon")))
    return out.withColumns({"type": F.lit("restroom"), "name": F.coalesce(*[clean(c) for c in names], F.lit("")), "source": F.lit("public-restroom")})


def width_report(raw: DataFrame) -> DataFrame:
    """(route_name, width_m) of a sidewalk sheet exported as CSV."""
    return raw.select(F.col(f"`{find_column(raw.columns, *ROUTE_WORDS)}`").alias("route_name"),
                      number(find_column(raw.columns, *WIDTH_WORDS)).alias("width_m")).dropna()


def raster_tiles(spark: SparkSession, path: str, size: int = RASTER_SIZE) -> DataFrame:
    """(tile_lat, tile_lon, r, c, elev) from tiles named like N37E126.hgt: big-endian int16, row 0 in the north."""
    def decode(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                tile = name.rsplit("/", 1)[-1]
                values = np.frombuffer(content, ">i2").reshape(size, size)
                for r in range(size):  # a raster row at a time keeps the Arrow batches small
                    row = values[r].astype("float64")
                    row[values[r] == RASTER_NULL] = np.nan
                    yield pd.DataFrame({"tile_lat": int(tile[1:3]), "tile_lon": int(tile[4:7]), "r": r, "c": np.arange(size), "elev": row})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(decode, "tile_lat long, tile_lon long, r long, c long, elev double")
    return rows.withColumn("elev", F.when(~F.isnan("elev"), F.col("elev")))


def raster_position(df: DataFrame, size: int = RASTER_SIZE) -> DataFrame:
    """df plus the tile and float row/column of (lat, lon)."""
    return df.withColumns({"tile_lat": F.floor("lat"), "tile_lon": F.floor("lon")}).withColumns({
        "rf": (F.col("tile_lat") + 1 - F.col("lat")) * (size - 1), "cf": (F.col("lon") - F.col("tile_lon")) * (size - 1)})


def line_vertices(lines: DataFrame, stride: int = VERTEX_STRIDE) -> DataFrame:
    """(line_id, part, pos, x, y, height): every stride-th vertex. lines: line_id, parts (array of arrays of (x, y)), height."""
    parts = lines.select("line_id", "height", F.posexplode("parts").alias("part", "line"))
    pts = parts.select("line_id", "height", "part", F.posexplode("line").alias("pos", "p"))
    return pts.where(F.col("pos") % stride == 0).select("line_id", "part", "pos", "p.x", "p.y", "height")


def height_points(spots: DataFrame, contours: DataFrame, to_wgs84=geo.plane_5174_to_wgs84) -> DataFrame:
    """(point_id, lat, lon, val): spot heights and thinned contour vertices, reprojected.

    spots: spot_id, x, y, height. contours as line_vertices takes them.
    """
    def placed(df: DataFrame, ident: Column) -> DataFrame:
        at = df.withColumn("at", to_wgs84(F.col("x"), F.col("y")))
        return at.select(ident.alias("point_id"), "at.lat", "at.lon", F.col("height").cast("double").alias("val"))

    return placed(spots, F.concat(F.lit("s"), F.col("spot_id"))).unionByName(
        placed(line_vertices(contours), F.concat_ws("-", F.lit("c"), "line_id", "part", "pos")))


def first_tag(tag: Column) -> Column:
    """First value of a list-valued tag."""
    return F.get(tag, F.lit(0))


def street_edges(ways: DataFrame) -> DataFrame:
    """Network rows with single-valued tags; short geometries carry no shape. Tags are arrays."""
    return ways.select("u", "v", F.coalesce("length_m", F.lit(0.0)).alias("length_m"), F.coalesce(first_tag(F.col("highway")), F.lit("unclassified")).alias("highway"),
                       first_tag(F.col("lit")).alias("lit"), F.coalesce(first_tag(F.col("name")), F.lit("")).alias("name"),
                       F.when(F.size("geometry") > 2, F.col("geometry")).alias("geometry"))


def ring_centroids(vertices: DataFrame, key: str = "poly_id") -> DataFrame:
    """(key, lat, lon): area centroids of closed rings given as vertex rows (key, seq, lat, lon)."""
    nxt = vertices.select(key, (F.col("seq") - 1).alias("seq"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    start = vertices.where("seq = 0").select(key, F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    sides = vertices.join(nxt, [key, "seq"]).join(start, key)
    ax, ay = F.col("lon") - F.col("lon0"), F.col("lat") - F.col("lat0")
    bx, by = F.col("lon2") - F.col("lon0"), F.col("lat2") - F.col("lat0")
    cross = ax * by - bx * ay
    return (sides.groupBy(key, "lat0", "lon0").agg(F.sum(cross).alias("a"), F.sum((ax + bx) * cross).alias("mx"), F.sum((ay + by) * cross).alias("my"))
            .select(key, (F.col("lat0") + F.col("my") / (3 * F.col("a"))).alias("lat"), (F.col("lon0") + F.col("mx") / (3 * F.col("a"))).alias("lon")))


def facilities_from_tags(pois: DataFrame) -> DataFrame:
    """(facility_id, type, name, lat, lon) of the four facility classes. pois: poi_id, tag, value, name, lat, lon."""
    kind = F
    for (tag, value), name in POI_TAGS.items():
        kind = kind.when((F.col("tag") == tag) & (F.col("value") == value), F.lit(name))
    typed = pois.withColumn("type", kind.otherwise(F.lit(None).cast("string"))).where(F.col("type").isNotNull())
    return typed.select(F.col("poi_id").alias("facility_id"), "type", F.coalesce("name", F.lit("")).alias("name"), "lat", "lon")


def green_polygons(features: DataFrame) -> DataFrame:
    """Polygon features of the green tag groups. features: geom_type, tag, value, ..."""
    wanted = F.lit(False)
    for tag, values in GREEN_TAGS.items():
        wanted = wanted | ((F.col("tag") == tag) & F.col("value").isin(*values))
    return features.where(wanted & F.col("geom_type").isin("Polygon", "MultiPolygon"))


def keep_existing(fresh: DataFrame, existing: DataFrame | None, local_only: bool = False) -> tuple[DataFrame, str]:
    """(table, label): an absent or empty fetch keeps the old table; local-only runs never replace it."""
    if existing is not None and (local_only or fresh.isEmpty()):
        return existing, "preserved-existing"
    return fresh, "none" if fresh.isEmpty() else "fresh"


def infra_points(points: DataFrame) -> DataFrame:
    """Stored points, filtered again so that a bad row cannot pass as a street feature."""
    return points.where(geo.in_network_box(F.col("lat"), F.col("lon")))


def read_presets(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """(preset_key, available, length_m, similarity) of preset files that match the format and the network.

    JSON lines, one entry per line (gzip is read as it is): format_version,
    graph_fingerprint, key, course (null = known to have none).
    """
    schema = "format_version int, graph_fingerprint string, key string, course struct<length_m: double, ascent_m: double, shape_similarity: double>"
    rows = spark.read.schema(schema).json(path)
    ok = rows.where((F.col("format_version") == PRESET_FORMAT) & (F.col("graph_fingerprint") == fingerprint))
    return ok.select(F.col("key").alias("preset_key"), F.col("course").isNotNull().alias("available"), "course.length_m",
                     F.col("course.shape_similarity").alias("similarity"))


def audit_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, verdict): ok, mismatch or unregistered per file. manifest: name, sha256."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    joined = files.join(manifest, "name", "left")
    return joined.select("name", F.when(F.col("sha256").isNull(), "unregistered").when(F.col("sha256") == F.col("actual"), "ok").otherwise("mismatch").alias("verdict"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: an order-free content hash of a table and its row count."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash"), F.count("*").alias("n")).select(
        F.substring(F.sha2(F.concat_ws(":", F.col("hash").cast("string"), F.col("n").cast("string")), 256), 1, 20).alias("fingerprint"), "n")


def append_results(results: DataFrame, path: str, batch: int) -> None:
    """One batch of a resumable build; a repeated batch replaces itself."""
    results.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def commit_rows(rows: DataFrame, path: str) -> int:
    """Appends rows to the folder as a new batch and then commits it; returns the batch's number.

    The batch is the folder batch=N under `rows`; its commit is a table of one row
    under `commits`, written after it. What a job that was cut off left
    behind has no commit, is not read, and its number is taken again.
    """
    spark = rows.sparkSession
    last = _commits(spark, path).agg(F.max("batch")).first()[0]
    batch = 0 if last is None else last + 1
    append_results(rows, f"{path}/rows", batch)
    spark.range(1).select(F.lit(batch).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch:09d}")
    return batch


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return _read_if_there(spark, f"{path}/commits/*", "batch long")


def _read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files that a path pattern leads to; an empty table if there are none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def committed_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed batches of a folder, with their batch."""
    numbers = sorted(r.batch for r in _commits(spark, path).collect())  # one row a batch
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/batch={n}" for n in numbers])
