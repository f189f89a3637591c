"""Place names, addresses, keys and labels as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strideframe.functions.geo import half_even

# --- fixed values -----------------------------------------------------------
SEOUL = "서울특별시"
DISTRICTS = (
    "강남구", "강동구", "강북구", "강서구", "관악구", "광진구", "구로구", "금천구", "노원구", "도봉구", "동대문구", "동작구",
    "마포구", "서대문구", "서초구", "성동구", "성북구", "송파구", "양천구", "영등포구", "용산구", "은평구", "종로구", "중구", "중랑구",
)
ROAD_HINTS = {"테헤란로": "강남구"}
NEIGHBOURHOOD_HINTS = {"신설동": "동대문구"}
SEOUL_PREFIX = r"^서울(?:특별시|시)?"
ADDRESS_LIKE = r"(?:[가-힣]+(?:동|가|로|길)\s*\d|(?:\d+-\d+)|\d+\s*번지)"
LABEL_CHARS = 120
# ----------------------------------------------------------------------------


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def query_key(text: Column) -> Column:
    """Spelling-insensitive key of a station or address query."""
    low = F.regexp_replace(F.lower(F.trim(text)), SEOUL_PREFIX, SEOUL)
    return F.regexp_replace(low, "[^0-9a-z가-힣]", "")


def without_brackets(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\([^)]*\)", ""))


def station_name(official: Column) -> Column:
    base = without_brackets(official)
    return F.when(base.endswith("역"), base).otherwise(F.concat(base, F.lit("역")))


def station_aliases(line: Column, official: Column, road: Column, lot: Column) -> Column:
    """Every accepted spelling of a station row, without blanks and repeats."""
    name = station_name(official)
    numbered = F.concat(line, F.lit("호선 "))

    def prefixed(address: Column, short: str) -> Column:
        return F.regexp_replace(address, f"^{SEOUL}", short)

    spellings = F.array(
        official, name, F.regexp_replace(name, "역$", ""), F.concat(numbered, official), F.concat(numbered, name), road, lot,
        without_brackets(road), F.trim(F.regexp_replace(lot, r"\s+\S+역\(\d+호선\)$", "")),
        prefixed(road, "서울"), prefixed(road, "서울시"), prefixed(lot, "서울"), prefixed(lot, "서울시"))
    return F.array_distinct(F.filter(spellings, lambda s: s != ""))


def looks_like_address(text: Column) -> Column:
    return text.rlike(ADDRESS_LIKE)


def address_variants(text: Column) -> Column:
    """Ordered spellings worth asking an address service for, without repeats."""
    q = squeeze(text)
    compact = F.regexp_replace(q, r"([가-힣]+(?:로|길))\s+(\d+(?:로|길))", "$1$2")
    compact = F.regexp_replace(compact, r"([가-힣]+(?:로|길)\d+(?:로|길))\s+(\d+)", "$1 $2")
    official = F.when(compact.rlike(SEOUL_PREFIX), F.trim(F.regexp_replace(compact, SEOUL_PREFIX + r"\s*", SEOUL + " ")))
    has_seoul = q.startswith("서울 ") | q.startswith("서울시") | q.startswith(SEOUL)
    has_district = F.lit(False)
    for d in DISTRICTS:
        has_district = has_district | q.contains(d)
    with_seoul = F.concat(F.lit(SEOUL + " "), compact)
    hinted = []
    for hints in (ROAD_HINTS, NEIGHBOURHOOD_HINTS):
        district = F
        for word, name in hints.items():
            district = district.when(compact.contains(word) & ~has_district, F.lit(name))
        hinted += [F.concat(district, F.lit(" "), compact), F.concat(F.lit(SEOUL + " "), district, F.lit(" "), compact)]
    ways = F.array(q, compact, official, *hinted, F.when(~has_seoul, with_seoul))
    return F.array_distinct(F.filter(ways, lambda v: v.isNotNull() & (v != "")))


def label(text: Column) -> Column:
    """A place label safe to embed in markup: no control characters, at most 120 characters, escaped."""
    clean = F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]", ""), 1, LABEL_CHARS)
    return F.regexp_replace(clean, r"([\\`*_{}\[\]()<>#+\-.!|])", r"\\$1")


def xml_text(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def fixed(x: Column, digits: int) -> Column:
    """Decimal text with exactly `digits` places."""
    return F.format_string(f"%.{digits}f", half_even(x, digits))


def shortest(x: Column) -> Column:
    """Decimal text without trailing zeros, as %g prints ordinary distances."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""), r"\.$", "")


def preset_key(lat: Column, lon: Column, shape: Column) -> Column:
    return F.concat_ws(",", fixed(lat, 5), fixed(lon, 5), shape)


def shape_token(shape: Column, distance_km: Column) -> Column:
    return F.concat(shape, F.lit("-"), shortest(distance_km), F.lit("k"))


def parse_shape_token(token: Column) -> tuple[Column, Column]:
    """(shape, km), both null when the token is malformed or the distance is outside 1..42.195."""
    shape = F.regexp_extract(token, r"^(.+)-[^-]*$", 1)
    km = F.regexp_extract(token, r"-([0-9]+(?:\.[0-9]+)?)k*$", 1).try_cast("double")
    ok = (F.length(token) <= 64) & (shape != "") & km.between(1.0, 42.195)
    return F.when(ok, shape), F.when(ok, km)


def course_identity(lat: Column, lon: Column, name: Column, distance_km: Column, hills: Column, night: Column, shape: Column,
                    facilities: Column) -> Column:
    """Stable id of a request: SHA-256 over its canonical text."""
    text = F.concat_ws("|", fixed(lat, 5), fixed(lon, 5), F.coalesce(name, F.lit("")), fixed(distance_km, 2), hills.cast("string"),
                       night.cast("string"), F.coalesce(shape, F.lit("")), F.array_join(facilities, ","))
    return F.sha2(text, 256)


def canonical_facilities(types: Column) -> Column:
    allowed = F.array(*[F.lit(t) for t in ("convenience_store", "park", "restroom", "water")])
    return F.array_sort(F.array_intersect(allowed, F.coalesce(types, F.array().cast("array<string>"))))
