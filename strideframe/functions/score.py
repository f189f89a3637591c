"""Edge scoring: priors, blends, running friendliness and routing weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strideframe.functions.geo import half_even

# --- fixed values -----------------------------------------------------------
SIDEWALK_PRIOR = {
    "footway": 0.9, "path": 0.8, "pedestrian": 1.0, "steps": 0.2, "living_street": 0.7,
    "residential": 0.55, "service": 0.5, "unclassified": 0.5, "tertiary": 0.45,
    "secondary": 0.4, "primary": 0.35, "cycleway": 0.75, "track": 0.6,
}
CROSSING_PRIOR = {
    "footway": 0.85, "path": 0.9, "pedestrian": 0.95, "cycleway": 0.85, "living_street": 0.7,
    "residential": 0.6, "service": 0.6, "tertiary": 0.45, "secondary": 0.35, "primary": 0.3,
}
LIT_PRIOR = {"yes": 0.95, "no": 0.15}
NEUTRAL = 0.5
PROFILES = {
    "day": {"sidewalk": 0.25, "slope": 0.20, "lighting": 0.15, "cctv": 0.10, "park": 0.20, "crossing": 0.10},
    "night": {"sidewalk": 0.15, "slope": 0.10, "lighting": 0.30, "cctv": 0.25, "park": 0.10, "crossing": 0.10},
}
COMPONENTS = ("sidewalk", "slope", "lighting", "cctv", "park", "crossing")
FOLLOW_FACTOR = {
    "primary": 0.84, "primary_link": 0.90, "secondary": 0.88, "secondary_link": 0.92,
    "tertiary": 0.94, "tertiary_link": 0.98, "unclassified": 1.00, "residential": 1.15,
    "living_street": 1.20, "service": 1.30, "footway": 1.24, "path": 1.28,
    "pedestrian": 1.16, "steps": 1.55,
}
FOLLOW_EDGE_M = 12.0
MAIN_ROAD_FACTOR = {
    "primary": 0.70, "primary_link": 0.78, "secondary": 0.74, "secondary_link": 0.82,
    "tertiary": 0.86, "tertiary_link": 0.92, "trunk": 0.74, "trunk_link": 0.82,
    "unclassified": 1.05, "residential": 1.30, "living_street": 1.40, "service": 1.60,
    "footway": 1.45, "path": 1.55, "pedestrian": 1.20, "steps": 1.90,
}
# ----------------------------------------------------------------------------


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    """Value of a small fixed table, else the default; stays inside code generation."""
    out = F
    for name, value in values.items():
        out = out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def sidewalk_prior(highway: Column) -> Column:
    return lookup(highway, SIDEWALK_PRIOR, NEUTRAL)


def crossing_prior(highway: Column) -> Column:
    return lookup(highway, CROSSING_PRIOR, NEUTRAL)


def lighting_prior(lit: Column) -> Column:
    return lookup(lit, LIT_PRIOR, NEUTRAL)


def route_name_key(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+", "")


def width_score(width_m: Column) -> Column:
    return (F.when(width_m >= 2.0, 1.0).when(width_m <= 1.0, 0.3)
            .otherwise(0.3 + 0.7 * (width_m - 1.0)))


def density(n: Column, saturate: int) -> Column:
    return F.least(F.lit(1.0), F.coalesce(n, F.lit(0)).cast("double") / F.lit(float(saturate)))


def slope_pct(e1: Column, e2: Column, surveyed: Column, length_m: Column) -> Column:
    """Grade from two node elevations above the source's noise floor; null if either is missing."""
    floor = F.when(surveyed, 0.3).otherwise(1.5)
    rise = F.greatest(F.lit(0.0), F.abs(e2 - e1) - floor)
    grade = half_even(F.least(F.lit(15.0), rise / length_m * 100.0), 2)
    return F.when(e1.isNotNull() & e2.isNotNull() & (length_m > 0), grade)


def crossing_blend(prior: Column, signal_density: Column) -> Column:
    return half_even(0.5 * prior + 0.5 * (1.0 - 0.7 * signal_density), 2)


def lighting_blend(prior: Column, light_density: Column) -> Column:
    return half_even(0.4 * prior + 0.6 * (0.2 + 0.8 * light_density), 2)


def cctv_blend(cctv_density: Column) -> Column:
    return half_even(0.3 + 0.7 * cctv_density, 2)


def slope_score(slope: Column, hills: Column | bool) -> Column:
    flat = F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), slope - 1.0) / 3.0)
    hilly = F.when(slope.between(3.0, 8.0), 1.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.abs(slope - 3.0) / 6.0))
    if isinstance(hills, bool):
        return hilly if hills else flat
    return F.when(hills, hilly).otherwise(flat)


def component_values(hills: Column | bool) -> dict[str, Column]:
    """The six score components of the edge columns, missing values made neutral."""
    c = F.col
    return {
        "sidewalk": F.coalesce(c("sidewalk_score"), F.lit(0.5)),
        "slope": slope_score(F.coalesce(c("slope_pct"), F.lit(2.0)), hills),
        "lighting": F.coalesce(c("lighting_score"), F.lit(0.5)),
        "cctv": F.coalesce(c("cctv_score"), F.lit(0.5)),
        "park": F.coalesce(c("park_score"), F.lit(0.0)),
        "crossing": F.coalesce(c("crossing_score"), F.lit(0.5)),
    }


def component_weight(name: str, night: Column | bool) -> Column:
    day, dark = F.lit(PROFILES["day"][name]), F.lit(PROFILES["night"][name])
    if isinstance(night, bool):
        return dark if night else day
    return F.when(night, dark).otherwise(day)


def edge_rfs(night: Column | bool = False, hills: Column | bool = False) -> Column:
    """Running friendliness 0..1 of an edge row."""
    total = F.lit(0.0)
    for name, value in component_values(hills).items():
        total = total + component_weight(name, night) * value
    return 0.25 + 0.75 * total


def routing_weight(night: Column | bool, hills: Column | bool) -> Column:
    """Length inflated by the missing friendliness and, on flat requests, by the grade."""
    deficit = 1.0 + (1.0 - edge_rfs(night, hills))
    grade = 0.22 * F.greatest(F.lit(0.0), F.coalesce(F.col("slope_pct"), F.lit(2.0)) - 1.0)
    if isinstance(hills, bool):
        cost = deficit if hills else deficit + grade
    else:
        cost = F.when(hills, deficit).otherwise(deficit + grade)
    return F.col("length_m") * cost


def with_routing_weights(edges):
    """Adds w_df, w_dh, w_nf, w_nh."""
    return edges.withColumns({
        f"w_{t}{h}": routing_weight(t == "n", h == "h") for t in "dn" for h in "fh"})


def _sidewalk_factor(good: float, bad: float) -> Column:
    walk = F.coalesce(F.col("sidewalk_score"), F.lit(0.5))
    return F.when(walk >= 0.85, good).when(walk < 0.55, bad).otherwise(1.0)


def followable_weight(base: Column) -> Column:
    """base made cheaper on easy-to-follow streets, plus a fixed cost per edge."""
    return base * (lookup(F.col("highway"), FOLLOW_FACTOR, 1.06) * _sidewalk_factor(0.90, 1.12)) + FOLLOW_EDGE_M


def main_road_cost() -> Column:
    """Cheap on broad named streets, dear on alleys and tiny paths."""
    alley = (F.coalesce(F.col("name"), F.lit("")) == "") & F.col("highway").isin("service", "footway", "path")
    return (lookup(F.col("highway"), MAIN_ROAD_FACTOR, 1.08) * _sidewalk_factor(0.88, 1.16)
            * F.when(alley, 1.10).otherwise(1.0))
