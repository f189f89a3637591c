"""Column-building geometry functions. All angles in degrees, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: spherical radius and local plane scales.
EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG_LAT = 110_540.0
M_PER_DEG_LON_EQUATOR = 111_320.0


def half_even(x: Column, digits: int = 6) -> Column:
    """Round to `digits`, ties to even, never -0.0."""
    p = float(10 ** digits)
    return F.rint(x * F.lit(p)) / F.lit(p) + F.lit(0.0)


def steady_sum(x: Column) -> Column:
    """Sum to a millionth that does not depend on the order of rows: whole millionths are added, so a later rounding finds no stray tie."""
    return F.sum(F.rint(x * 1e6).cast("long")).cast("double") / 1e6


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def cell(x: Column, size: float) -> Column:
    """Grid index of a coordinate (coordinates of the network are positive)."""
    return F.floor(x / F.lit(size)).cast("long")


def in_network_box(lat: Column, lon: Column) -> Column:
    """Open box used to clean point layers."""
    return (lat > 37.3) & (lat < 37.8) & (lon > 126.6) & (lon < 127.3)


def in_service_box(lat: Column, lon: Column) -> Column:
    """Closed box in which requests are accepted."""
    return lat.between(37.4, 37.72) & lon.between(126.76, 127.19)


def m_per_deg_lon(lat: Column) -> Column:
    return F.lit(M_PER_DEG_LON_EQUATOR) * F.cos(F.radians(lat))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    sin_lat = F.sin(F.radians(lat2 - lat1) / 2)
    sin_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (sin_lon * sin_lon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Plane distance with the longitude shrunk at the mean latitude."""
    dx = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = F.radians(lat2 - lat1)
    return F.sqrt(dx * dx + dy * dy) * F.lit(EARTH_RADIUS_M)


def plane_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    return (lon - lon0) * m_per_deg_lon(lat0)


def plane_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * F.lit(M_PER_DEG_LAT)


def plane_lat(y: Column, lat0: Column) -> Column:
    return lat0 + y / F.lit(M_PER_DEG_LAT)


def plane_lon(x: Column, lat0: Column, lon0: Column) -> Column:
    return lon0 + x / m_per_deg_lon(lat0)


def plane_d2(lat: Column, lon: Column, plat: Column, plon: Column) -> Column:
    """Squared metres in the plane around (lat, lon)."""
    dy = (plat - lat) * F.lit(M_PER_DEG_LAT)
    dx = (plon - lon) * m_per_deg_lon(lat)
    return dy * dy + dx * dx


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def turn_angle(v1x: Column, v1y: Column, v2x: Column, v2y: Column) -> Column:
    """Direction change 0..180 between two legs; null when a leg has no length."""
    n1, n2 = hypot(v1x, v1y), hypot(v2x, v2y)
    cosine = (v1x * v2x + v1y * v2y) / (n1 * n2)
    return F.when((n1 >= 1e-9) & (n2 >= 1e-9), F.degrees(F.acos(clamp(cosine, -1.0, 1.0))))


def signed_turn(v1x: Column, v1y: Column, v2x: Column, v2y: Column) -> Column:
    """Direction change -180..180, left positive."""
    return F.degrees(F.atan2(v1x * v2y - v1y * v2x, v1x * v2x + v1y * v2y))


def segment_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Clamped position 0..1 of the projection of p on segment a-b."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    return F.when(len2 == 0, F.lit(0.0)).otherwise(
        clamp(((px - ax) * dx + (py - ay) * dy) / len2, 0.0, 1.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_fraction(px, py, ax, ay, bx, by)
    return hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def left_of(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def segments_cross(a, b, c, d) -> Column:
    """True where segment a-b properly crosses c-d; each argument is an (x, y) pair."""
    return (left_of(*a, *c, *d) != left_of(*b, *c, *d)) & (left_of(*a, *b, *c) != left_of(*a, *b, *d))


def screen_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Arrow angle on a map drawn with y downwards."""
    k = F.lit(M_PER_DEG_LON_EQUATOR)
    dx, dy = (lon2 - lon1) * k, (lat2 - lat1) * k
    # due west is -180: the sign of a zero is lost inside atan2
    return F.when((dy == 0) & (dx < 0), -180.0).otherwise(F.degrees(F.atan2(-dy, dx)))


def pose_error(rotation: Column) -> Column:
    """0..1 distance of a template rotation from the readable poses."""
    poses = F.array(*[F.lit(float(p)) for p in (0, 15, 345, 30, 330, 45, 315)])  # fixed values
    gap = F.array_min(F.transform(poses, lambda t: F.abs(F.pmod(rotation - t + 180.0, F.lit(360.0)) - 180.0)))
    return F.least(gap, F.lit(90.0)) / 90.0


def unit_hash(text: Column) -> Column:
    """Deterministic number in [0, 1) from the first 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# Ellipsoids and grids of the published Korean plane systems (fixed values).
GRS80 = (6_378_137.0, 298.257222101)
BESSEL = (6_377_397.155, 299.1528128)
PLANE_5186 = dict(ellipsoid=GRS80, lat0=38.0, lon0=127.0, k0=1.0, x0=200_000.0, y0=600_000.0)
PLANE_5174 = dict(ellipsoid=BESSEL, lat0=38.0, lon0=127.0 + 10.405 / 3600.0, k0=1.0,
                  x0=200_000.0, y0=500_000.0)
# Seven-parameter shift Bessel -> WGS84 published for EPSG:5174 (metres, arc seconds, ppm).
SHIFT_5174 = (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)


def _ellipsoid(ell):
    a, inv_f = ell
    f = 1.0 / inv_f
    return a, f, 2 * f - f * f


def _meridian_arc(lat_rad: float, a: float, e2: float) -> float:
    c0 = 1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256
    c2 = 3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024
    c4 = 15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024
    c6 = 35 * e2 ** 3 / 3072
    return a * (c0 * lat_rad - c2 * math.sin(2 * lat_rad) + c4 * math.sin(4 * lat_rad)
                - c6 * math.sin(6 * lat_rad))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once.

    The projection series use their intermediate values many times over; written
    out, or after a filter has been pushed through them, they would grow to
    millions of nodes. A bound lambda variable keeps them small.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unproject(x: Column, y: Column, plane: dict) -> Column:
    """Struct (lat, lon) on the plane's own ellipsoid, by the classic series in the footpoint latitude."""
    a, _, e2 = _ellipsoid(plane["ellipsoid"])
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    m0 = _meridian_arc(math.radians(plane["lat0"]), a, e2)
    mu_scale = a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256)

    def foot_of(v):
        mu = v["mu"]
        foot = (mu + F.sin(2 * mu) * (3 * e1 / 2 - 27 * e1 ** 3 / 32) + F.sin(4 * mu) * (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32)
                + F.sin(6 * mu) * (151 * e1 ** 3 / 96) + F.sin(8 * mu) * (1097 * e1 ** 4 / 512))
        return let(F.struct(foot.alias("f"), v["x"].alias("x")), terms)

    def terms(v):
        f = v["f"]
        w = F.sqrt(1 - F.sin(f) * F.sin(f) * e2)
        return let(F.struct(f.alias("f"), v["x"].alias("x"), w.alias("w"), (F.cos(f) * F.cos(f) * ep2).alias("c"), (F.tan(f) * F.tan(f)).alias("t")), offset)

    def offset(v):
        d = (v["x"] - plane["x0"]) * v["w"] / (a * plane["k0"])
        return let(F.struct(v["f"].alias("f"), v["w"].alias("w"), v["c"].alias("c"), v["t"].alias("t"), d.alias("d"), (d * d).alias("d2")), position)

    def position(v):
        f, w, c, t, d, d2 = (v[n] for n in ("f", "w", "c", "t", "d", "d2"))
        lat = f - w * w / (1 - e2) * F.tan(f) * d2 * (
            F.lit(0.5) - d2 / 24 * (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2)
            + d2 * d2 / 720 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c))
        lon = d * (1 - d2 / 6 * (1 + 2 * t + c) + d2 * d2 / 120 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t)) / F.cos(f)
        return F.struct(F.degrees(lat).alias("lat"), (F.degrees(lon) + plane["lon0"]).alias("lon"))

    return let(F.struct(((F.lit(m0) + (y - plane["y0"]) / plane["k0"]) / mu_scale).alias("mu"), x.alias("x")), foot_of)


def project(lat: Column, lon: Column, plane: dict) -> Column:
    """Struct (x, y) of a position given on the plane's own ellipsoid."""
    a, _, e2 = _ellipsoid(plane["ellipsoid"])
    ep2 = e2 / (1 - e2)
    m0 = _meridian_arc(math.radians(plane["lat0"]), a, e2)

    def terms(v):
        p = v["p"]
        arc = (p * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) - F.sin(2 * p) * (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024)
               + F.sin(4 * p) * (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) - F.sin(6 * p) * (35 * e2 ** 3 / 3072)) * a
        return let(F.struct((F.lit(a) / F.sqrt(1 - F.sin(p) * F.sin(p) * e2)).alias("nu"), F.tan(p).alias("tan"), (F.tan(p) * F.tan(p)).alias("t"),
                            (F.cos(p) * F.cos(p) * ep2).alias("c"), (v["dl"] * F.cos(p)).alias("aa"), arc.alias("m")), position)

    def position(v):
        nu, tan, t, c, aa, m = (v[n] for n in ("nu", "tan", "t", "c", "aa", "m"))
        a2 = aa * aa
        x = nu * aa * (1 + a2 / 6 * (1 - t + c) + a2 * a2 / 120 * (5 - 18 * t + t * t + 72 * c - 58 * ep2))
        y = m - m0 + nu * tan * a2 * (F.lit(0.5) + a2 / 24 * (5 - t + 9 * c + 4 * c * c)
                                      + a2 * a2 / 720 * (61 - 58 * t + t * t + 600 * c - 330 * ep2))
        return F.struct((x * plane["k0"] + plane["x0"]).alias("x"), (y * plane["k0"] + plane["y0"]).alias("y"))

    return let(F.struct(F.radians(lat).alias("p"), F.radians(lon - plane["lon0"]).alias("dl")), terms)


def plane_5186_to_wgs84(x: Column, y: Column) -> Column:
    """Struct (lat, lon). GRS80 and WGS84 differ by less than a millimetre here, so no datum step is needed."""
    return unproject(x, y, PLANE_5186)


def plane_5174_to_wgs84(x: Column, y: Column) -> Column:
    """Struct (lat, lon): inverse projection on Bessel, then the seven-parameter shift."""
    a, _, e2 = _ellipsoid(BESSEL)
    tx, ty, tz, rx, ry, rz, ppm = SHIFT_5174
    rx, ry, rz = (math.radians(v / 3600.0) for v in (rx, ry, rz))
    s = 1 + ppm * 1e-6
    a2, f2, e22 = _ellipsoid((6_378_137.0, 298.257223563))
    b2 = a2 * (1 - f2)

    def centred(v):
        phi, lam = F.radians(v["lat"]), F.radians(v["lon"])
        nu = F.lit(a) / F.sqrt(1 - F.sin(phi) * F.sin(phi) * e2)
        return let(F.struct((nu * F.cos(phi) * F.cos(lam)).alias("x"), (nu * F.cos(phi) * F.sin(lam)).alias("y"),
                            (nu * (1 - e2) * F.sin(phi)).alias("z")), shifted)

    def shifted(v):
        gx, gy, gz = v["x"], v["y"], v["z"]
        return let(F.struct(((gx - gy * rz + gz * ry) * s + tx).alias("x"), ((gx * rz + gy - gz * rx) * s + ty).alias("y"),
                            ((gy * rx - gx * ry + gz) * s + tz).alias("z")), angles)

    def angles(v):
        p = hypot(v["x"], v["y"])
        return let(F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), p.alias("p"), F.atan2(v["z"] * a2, p * b2).alias("th")), geodetic)

    def geodetic(v):
        st, ct = F.sin(v["th"]), F.cos(v["th"])
        lat = F.atan2(v["z"] + st * st * st * (e22 / (1 - e22) * b2), v["p"] - ct * ct * ct * (e22 * a2))
        return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(v["y"], v["x"])).alias("lon"))

    return let(unproject(x, y, PLANE_5174), centred)
