"""SQL snippets shared by the DuckDB twins of the queries."""

from strideframe.functions import score

M_LAT, M_LON = "110540.0::DOUBLE", "111320.0::DOUBLE"


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def r(x: str, digits: int = 6) -> str:
    p = D(float(10 ** digits))
    return f"(round_even(({x}) * {p}, 0) / {p} + {D(0.0)})"


def steady(x: str) -> str:
    """Sum of whole millionths."""
    return f"(CAST(SUM(CAST(round_even(({x}) * {D(1e6)}, 0) AS BIGINT)) AS DOUBLE) / {D(1e6)})"


def hav(a: str, b: str, c: str, d: str) -> str:
    sa = f"sin(radians({c} - {a}) / 2)"
    so = f"sin(radians({d} - {b}) / 2)"
    return (f"({D(12742000.0)} * asin(sqrt({sa} * {sa} + cos(radians({a})) * cos(radians({c})) * ({so} * {so}))))")


def equi(a: str, b: str, c: str, d: str) -> str:
    dx = f"(radians({d} - {b}) * cos(radians(({a} + {c}) / 2)))"
    dy = f"radians({c} - {a})"
    return f"(sqrt({dx} * {dx} + {dy} * {dy}) * {D(6371000.0)})"


def mlon(lat: str) -> str:
    return f"({D(111320.0)} * cos(radians({lat})))"


def plane_d2(lat: str, lon: str, plat: str, plon: str) -> str:
    dy = f"(({plat} - {lat}) * {D(110540.0)})"
    dx = f"(({plon} - {lon}) * {mlon(lat)})"
    return f"({dy} * {dy} + {dx} * {dx})"


def cell(x: str, size: float) -> str:
    return f"CAST(floor({x} / {D(size)}) AS BIGINT)"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {D(lo)}), {D(hi)})"


def turn(ax: str, ay: str, bx: str, by: str) -> str:
    n1, n2 = f"sqrt({ax} * {ax} + {ay} * {ay})", f"sqrt({bx} * {bx} + {by} * {by})"
    cosine = f"({ax} * {bx} + {ay} * {by}) / ({n1} * {n2})"
    return f"CASE WHEN {n1} >= 1e-9 AND {n2} >= 1e-9 THEN degrees(acos({clamp(cosine, -1.0, 1.0)})) END"


def signed_turn(ax: str, ay: str, bx: str, by: str) -> str:
    return f"degrees(atan2({ax} * {by} - {ay} * {bx}, {ax} * {bx} + {ay} * {by}))"


def seg_frac(px, py, ax, ay, bx, by) -> str:
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    return (f"CASE WHEN {len2} = 0 THEN {D(0.0)} ELSE "
            f"{clamp(f'(({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / {len2}', 0.0, 1.0)} END")


def seg_dist(px, py, ax, ay, bx, by) -> str:
    t = f"({seg_frac(px, py, ax, ay, bx, by)})"
    ex = f"({px} - ({ax} + {t} * ({bx} - {ax})))"
    ey = f"({py} - ({ay} + {t} * ({by} - {ay})))"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


def lookup(key: str, values: dict, default: float) -> str:
    body = " ".join(f"WHEN '{k}' THEN {D(v)}" for k, v in values.items())
    return f"CASE {key} {body} ELSE {D(default)} END"


def density(n: str, saturate: int) -> str:
    return f"least({D(1.0)}, CAST(COALESCE({n}, 0) AS DOUBLE) / {D(float(saturate))})"


def slope_score(s: str, hills: bool) -> str:
    if hills:
        return (f"CASE WHEN {s} BETWEEN 3.0 AND 8.0 THEN {D(1.0)} ELSE "
                f"greatest({D(0.0)}, {D(1.0)} - abs({s} - {D(3.0)}) / {D(6.0)}) END")
    return f"greatest({D(0.0)}, {D(1.0)} - greatest({D(0.0)}, {s} - {D(1.0)}) / {D(3.0)})"


def components(hills: bool, p: str = "") -> dict[str, str]:
    out = {k: f"COALESCE({p}{k}_score, {D(0.0 if k == 'park' else 0.5)})"
           for k in score.COMPONENTS if k != "slope"}
    out["slope"] = f"({slope_score(f'COALESCE({p}slope_pct, {D(2.0)})', hills)})"
    return {k: out[k] for k in score.COMPONENTS}


def rfs(night: bool = False, hills: bool = False, p: str = "") -> str:
    w = score.PROFILES["night" if night else "day"]
    total = D(0.0)
    for name, value in components(hills, p).items():
        total = f"({total} + {D(w[name])} * {value})"
    return f"({D(0.25)} + {D(0.75)} * {total})"


def weight(night: bool, hills: bool, p: str = "") -> str:
    cost = f"({D(1.0)} + ({D(1.0)} - {rfs(night, hills, p)}))"
    if not hills:
        cost = f"({cost} + {D(0.22)} * greatest({D(0.0)}, COALESCE({p}slope_pct, {D(2.0)}) - {D(1.0)}))"
    return f"({p}length_m * {cost})"


def sidewalk_factor(good: float, bad: float) -> str:
    w = f"COALESCE(sidewalk_score, {D(0.5)})"
    return f"CASE WHEN {w} >= 0.85 THEN {D(good)} WHEN {w} < 0.55 THEN {D(bad)} ELSE {D(1.0)} END"


def followable(base: str) -> str:
    return f"({base} * ({lookup('highway', score.FOLLOW_FACTOR, 1.06)} * {sidewalk_factor(0.90, 1.12)}) + {D(12.0)})"


def main_road_cost() -> str:
    alley = "(COALESCE(name, '') = '' AND highway IN ('service', 'footway', 'path'))"
    return (f"({lookup('highway', score.MAIN_ROAD_FACTOR, 1.08)} * {sidewalk_factor(0.88, 1.16)} "
            f"* CASE WHEN {alley} THEN {D(1.10)} ELSE {D(1.0)} END)")
