"""Whole builds: raw layers -> scored network, its report and its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import standing
from strideframe.session import cut

# Half sides of the neighbourhood of a sanity spot, in degrees.
SPOT_DLAT, SPOT_DLON = 0.009, 0.011


def spot_edges(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """(spot_id, edge columns): edges whose first endpoint lies in a spot's box, by an equi join on box-sized cells."""
    def key(lat, lon):
        return F.floor(lat / SPOT_DLAT).cast("long"), F.floor(lon / SPOT_DLON).cast("long")

    si, sj = key(F.col("lat"), F.col("lon"))
    near = (spots.select("spot_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"),
                         F.explode(F.sequence(si - 1, si + 1)).alias("ci"), sj.alias("sj"))
            .select("spot_id", "s_lat", "s_lon", "ci", F.explode(F.sequence(F.col("sj") - 1, F.col("sj") + 1)).alias("cj")))
    ei, ej = key(F.col("u_lat"), F.col("u_lon"))
    return (edges.withColumns({"ci": ei, "cj": ej}).join(near, ["ci", "cj"])
            .where((F.abs(F.col("u_lat") - F.col("s_lat")) < SPOT_DLAT) & (F.abs(F.col("u_lon") - F.col("s_lon")) < SPOT_DLON)))


def sanity_report(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """Mean score around each spot against 0.9 x the citywide 80th percentile.

    Edges are folded to sums per first endpoint before they meet the spots;
    sums run over millionths, so they do not depend on the order of rows.
    """
    edges = cut(edges.select("u_lat", "u_lon", "rfs"))
    q80 = standing.value_at(edges, "rfs", {"q80": (4, 5)}).first()["q80"]
    folded = edges.groupBy("u_lat", "u_lon").agg(F.count("*").alias("n"), F.sum(F.rint(F.col("rfs") * 1e6).cast("long")).alias("total"))
    means = spot_edges(folded, spots).groupBy("spot_id").agg(
        F.sum("n").alias("n_edges"), (F.sum("total") / (F.sum("n") * 1e6)).alias("mean_rfs"))
    out = spots.select("spot_id").join(means, "spot_id", "left").fillna({"n_edges": 0, "mean_rfs": 0.0})
    ok = geo.half_even(F.col("mean_rfs")) >= geo.half_even(F.lit(q80 * 0.9))
    return out.withColumns({"q80": F.lit(q80), "verdict": F.when(ok, "PASS").otherwise("CHECK")})


def enrichment_counts(edges: DataFrame) -> DataFrame:
    """One row: how many edges each source reached."""
    return edges.agg(
        F.count("*").alias("edges"), F.count_if("slope_known").alias("slope_edges"),
        F.count_if("slope_surveyed").alias("slope_surveyed_edges"), F.count("width_m").alias("width_edges"),
        F.count_if(F.col("park_score") > 0).alias("park_edges"))
