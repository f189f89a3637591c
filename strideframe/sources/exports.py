"""Sinks: tables by cell, manifests, route documents as ordered text lines, checkpointed builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import geo, text
from strideframe.operators.paths import Paths, running_km

# Fixed values of the track document.
GPX_HEAD = ('<?xml version="1.0" encoding="UTF-8"?>', '<gpx version="1.1" creator="strideframe" xmlns="http://www.topografix.com/GPX/1/1">',
            "  <metadata>", '    <copyright author="OpenStreetMap contributors">', "      <license>https://www.openstreetmap.org/copyright</license>",
            "    </copyright>", "  </metadata>", "  <trk>")
GPX_TAIL = ("    </trkseg>", "  </trk>", "</gpx>")


def _document(line: Paths, names: DataFrame, head: list[Column], point: Column, tail: list[Column]) -> DataFrame:
    """(course_id, line_no, text): head lines, one line per path row, tail lines. A document is never gathered."""
    key, seq = line.key, line.seq
    body = line.df.select(key, (F.col(seq) + len(head)).cast("long").alias("line_no"), point.alias("text"))
    frame = names.select(key, F.posexplode(F.array(*head)).alias("p", "text"), F.lit(0).cast("long").alias("base"))
    after = names.select(key, F.posexplode(F.array(*tail)).alias("p", "text"), (F.col("n") + len(head)).alias("base"))
    edges = frame.unionByName(after).select(key, (F.col("p") + F.col("base")).cast("long").alias("line_no"), "text")
    return body.unionByName(edges)


def gpx_lines(line: Paths, names: DataFrame) -> DataFrame:
    """Track documents. line: lat, lon. names: course_id, name, n (points)."""
    head = [F.lit(t) for t in GPX_HEAD] + [F.concat(F.lit("    <name>"), text.xml_text(F.col("name")), F.lit("</name>")), F.lit("    <trkseg>")]
    point = F.concat(F.lit('      <trkpt lat="'), text.fixed(F.col("lat"), 6), F.lit('" lon="'), text.fixed(F.col("lon"), 6), F.lit('"/>'))
    return _document(line, names, head, point, [F.lit(t) for t in GPX_TAIL])


def _json_parts(line: Paths) -> tuple[Column, Column, Column]:
    """Head, point and tail lines of a route document, of rows with the path's n and km."""
    comma = F.when(F.col(line.seq) < F.col("n") - 1, ",").otherwise("")
    point = F.concat(F.lit("["), text.fixed(F.col("lat"), 5), F.lit(","), text.fixed(F.col("lon"), 5), F.lit("]"), comma)
    return F.lit('{"points":['), point, F.concat(F.lit('],"km":'), text.fixed(F.col("km"), 1), F.lit("}"))


def route_json_lines(line: Paths, names: DataFrame) -> DataFrame:
    """Route documents {"points": [[lat, lon], ...], "km": x}. names: course_id, n, km."""
    head, point, tail = _json_parts(line)
    sized = line.over(line.df.join(names.select(line.key, "n"), line.key))
    return _document(sized, names, [head], point, [tail])


def route_json(line: Paths) -> DataFrame:
    """Route documents of whole paths. A short path's rows make its lines where they are, so that it is read and dealt once."""
    key, seq = line.key, line.seq
    km = running_km(line).df
    if line.long:
        return route_json_lines(line, km.groupBy(key).agg(F.count("*").alias("n"), F.max("km").alias("km")))
    whole = Window.partitionBy(key)
    rows = km.withColumns({"n": F.count("*").over(whole), "km": F.max("km").over(whole), "first": F.row_number().over(whole.orderBy(seq)) == 1})
    head, point, tail = _json_parts(line)

    def row(number: Column, words: Column) -> Column:
        return F.struct(number.cast("long").alias("line_no"), words.alias("text"))

    body = F.when(F.col(key).isNotNull(), row(F.col(seq) + 1, point))
    ends = [F.when(F.col("first"), row(number, words)) for number, words in ((F.lit(0), head), (F.col("n") + 1, tail))]
    return rows.select(key, F.explode(F.array_compact(F.array(body, *ends))).alias("l")).select(key, "l.line_no", "l.text")


def write_documents(lines: DataFrame, path: str, key: str = "course_id") -> None:
    """Text files in document order: ranges of (key, line_no), so one huge document spans several files."""
    (lines.repartitionByRange(F.col(key), F.col("line_no")).sortWithinPartitions(key, "line_no")
     .select("text").write.mode("overwrite").text(path))


def write_by_cell(df: DataFrame, path: str, lat: str = "lat", lon: str = "lon", size: float = 0.05) -> None:
    """Parquet partitioned by a coarse latitude cell, rows of a cell clustered by longitude."""
    keyed = df.withColumn("lat_cell", geo.cell(F.col(lat), size))
    (keyed.repartitionByRange(F.col("lat_cell"), F.col(lon)).sortWithinPartitions("lat_cell", lon)
     .write.mode("overwrite").partitionBy("lat_cell").parquet(path))


def manifest(counts: DataFrame, sources: dict[str, str], date: str, local_only: bool) -> DataFrame:
    """One JSON document with source labels and build counts. counts: one row."""
    labels = F.struct(*[F.lit(v).alias(k) for k, v in sources.items()])
    body = F.struct(F.lit(date).alias("date"), labels.alias("sources"), F.lit(local_only).alias("local_only"), F.struct(*counts.columns).alias("counts"))
    return counts.select(F.to_json(body).alias("document"))


def atlas_rows(presets: DataFrame) -> DataFrame:
    """Compact row per verified course."""
    return presets.where("available").select(
        geo.half_even(F.col("lat"), 5).alias("lat"), geo.half_even(F.col("lon"), 5).alias("lon"), "shape", "name",
        geo.half_even(F.col("length_m") / 1000.0, 1).alias("km"), text.preset_key(F.col("lat"), F.col("lon"), F.col("shape")).alias("id"))
