"""Personal data in place notes: patterns propose spans, checksums confirm them, context words adjust the score.

Records: facilities (facility_id, name string, any further columns). Built-in
column functions only. A null or empty name holds no span. Offsets count code
points, the end is exclusive. Every row is judged alone, so repeated rows, ties and
rows without an id need no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, their patterns, context words and scores.
# A pattern that starts with a look-behind can only begin where a run of its first
# characters begins (or where the last match ended), and its repeats never give
# back what they took; both keep one pass linear and change no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Lengths of account numbers by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_START = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})"
#: From a start on: the country's own length, else as far as capitals and digits go, up to a space before another start.
IBAN_ENDS = (
    "^(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])",
    r"^[A-Z]{2}[0-9]{2}(?:(?:\x20(?![A-Z]{2}[0-9]{2}))?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
)
IBAN_CHARS = 72
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = {
    "email": (EMAIL, "mail|contact|write|e-mail", 0.8),
    "ip": (IP, "ip|host|server|address", 0.6),
    "card": (CARD, "card|visa|credit|payment", 0.7),
    "phone": (PHONE, "phone|call|tel|mobile", 0.6),
    "iban": (IBAN_START, "iban|bank|account|konto", 0.8),
    "ssn": (SSN, "ssn|social|insurance", 0.3),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 48
CONTEXT_GAIN = 0.3
# What stands between two members of a list; they share their context.
LIST_GAP = r"(?i)^[^\p{L}\p{N}]{1,16}(?:(?:and|or|und|[0-9]{1,3}[.)])[^\p{L}\p{N}]{1,8})?$"
THRESHOLD = 0.5
_MATCHES = "array<struct<lo:int,hi:int,gap:string>>"
_FOUND = "array<struct<lo:int,hi:int,near:boolean,joined:boolean>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i + 1, F.lit(1))) - 48
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return text.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(name: Column, pattern: str, kind: str) -> Column:
    """The confirmed matches of a pattern: array of (lo, hi, gap), gap being the text back to the match before, null after an unconfirmed one.

    The text between matches gives their places: the parts of split() and the matches
    of regexp_extract_all() alternate.
    """
    parts = F.arrays_zip(F.split(name, pattern, -1).alias("gap"), F.regexp_extract_all(name, F.lit(pattern), F.lit(0)).alias("text"))

    def step(acc: Column, part: Column) -> Column:
        gap, text = part["gap"], part["text"]
        lo = acc["at"] + F.length(gap)
        hi = lo + F.coalesce(F.length(text), F.lit(0))
        good = text.isNotNull() & _confirmed(kind, text)
        found = F.struct(lo.alias("lo"), hi.alias("hi"), F.when(acc["good"], gap).alias("gap"))
        return F.struct(hi.alias("at"), good.alias("good"), F.when(good, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("good"), F.array().cast(_MATCHES).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _account_matches(name: Column) -> Column:
    """The account numbers that pass their checksum, as in _matches.

    Every place where one can start is tried, so what only looks like a number hides
    none that starts inside it: first the end that the country's length sets, then
    the last capital or digit.
    """
    def step(acc: Column, part: Column) -> Column:
        lo = acc["at"]
        ahead = F.substr(name, lo + 1, F.lit(IBAN_CHARS))
        ends = [F.regexp_extract(ahead, end, 0) for end in IBAN_ENDS]
        passed = [F.when((end != "") & _mod97(F.regexp_replace(end, " ", "")), F.length(end)) for end in ends]
        hi = lo + F.when(lo >= acc["until"], F.coalesce(*passed))
        found = F.struct(lo.alias("lo"), hi.alias("hi"), F.when(acc["until"] > 0, F.substr(name, acc["until"] + 1, lo - acc["until"])).alias("gap"))
        return F.struct((lo + F.length(part)).alias("at"), F.coalesce(hi, acc["until"]).alias("until"),
                        F.when(hi.isNotNull(), F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("until"), F.array().cast(_MATCHES).alias("out"))
    return F.aggregate(F.split(name, IBAN_START, -1), start, step, lambda acc: acc["out"])


def _told(found: Column, backward: bool) -> Column:
    """found (lo, hi, near, joined) in reverse order, where near goes on from one member of a list to the next."""
    def step(acc: Column, m: Column) -> Column:
        near = m["near"] | (acc["near"] & (acc["joined"] if backward else m["joined"]))
        one = F.struct(m["lo"].alias("lo"), m["hi"].alias("hi"), near.alias("near"), m["joined"].alias("joined"))
        return F.struct(near.alias("near"), m["joined"].alias("joined"), F.concat(F.array(one), acc["out"]).alias("out"))

    start = F.struct(F.lit(False).alias("near"), F.lit(False).alias("joined"), F.array().cast(_FOUND).alias("out"))
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def _spans(name: Column, kind: str, rank: int) -> Column:
    """The confirmed spans of one kind: array of (lo, rank, hi, kind, score).

    A context word counts within CONTEXT_CHARS characters before or after the span, or
    at any other member of a list that the span belongs to.
    """
    pattern, words, score = KINDS[kind]
    may = {"email": F.contains(name, F.lit("@")), "phone": F.contains(name, F.lit("+")), "ssn": F.contains(name, F.lit("-"))}.get(kind, F.lit(True))
    empty = F.array().cast("array<struct<lo:int,rank:int,hi:int,kind:string,score:double>>")

    def judge(m: Column) -> Column:
        before = F.substr(name, F.greatest(m["lo"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(m["lo"], F.lit(CONTEXT_CHARS)))
        around = F.lower(F.concat(before, F.lit("\n"), F.substr(name, m["hi"] + 1, F.lit(CONTEXT_CHARS))))
        near = around.rlike(rf"(?:^|[^a-z])(?:{words})(?:e?s)?(?:[^a-z]|$)")
        return F.struct(m["lo"].alias("lo"), m["hi"].alias("hi"), near.alias("near"), F.coalesce(m["gap"].rlike(LIST_GAP), F.lit(False)).alias("joined"))

    found = F.transform(_account_matches(name) if kind == "iban" else _matches(name, pattern, kind), judge)
    found = _told(_told(found, False), True)

    def span(m: Column) -> Column:
        sure = F.lit(score) + F.when(m["near"], F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        return F.struct(m["lo"].alias("lo"), F.lit(rank).alias("rank"), m["hi"].alias("hi"), F.lit(kind).alias("kind"), F.least(sure, F.lit(1.0)).alias("score"))

    spans = F.transform(found, span)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.when(may, spans).otherwise(empty)


def private_spans(facilities: DataFrame) -> DataFrame:
    """All columns of `facilities` with private_spans: array of (lo, rank, hi, kind, score) by start, then kind.

    The base kinds (email, ip, card, phone) stay whatever their score; iban needs its
    checksum, ssn a context word near it or its list to reach the threshold.
    """
    name = F.coalesce("name", F.lit(""))
    return facilities.withColumn("private_spans", F.array_sort(F.concat(*[_spans(name, kind, i) for i, kind in enumerate(KINDS)])))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def redacted(name: Column, spans: Column) -> Column:
    """name with every span replaced by [KIND]; spans that overlap become one, named after the first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substr(name, acc["at"] + 1, s["lo"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["hi"]).alias("at"), F.when(s["lo"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(name, acc["at"] + 1)))).otherwise(name)
