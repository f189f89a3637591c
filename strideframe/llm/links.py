"""Rules that allow or block links by host and path.

The project keeps no records with foreign links (its own ones are built from one
base address), so the operator is general: any table with a column `url`. Column
functions only.

A link is taken apart into expressions, host suffix and path prefix, of the shapes
that occur among the rules. The hash prefixes of expressions and rules are joined,
full digests confirm a hit, and of all rules that fit a link the longest decides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the join goes by.
PREFIX_DIGITS = 8
#: An expression that most links share is spread over so many keys; each rule is there once a key.
SALTS = 16
#: Verdict on links that no rule fits.
DEFAULT = "allow"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def link_host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return _lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def link_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty for null or without `://`."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _expression(host: Column, path: Column) -> Column:
    """Host suffix and path prefix with their lengths, so that no two pairs give one text."""
    return F.concat_ws(":", F.length(host), F.length(path), host, path)


def _keys(host: Column, path: Column) -> list[Column]:
    digest = F.sha2(_expression(host, path), 256)
    return [F.substring(digest, 1, PREFIX_DIGITS).alias("link_prefix"), digest.alias("link_digest")]


def rule_table(rules: DataFrame) -> DataFrame:
    """rules (action, host, path) with hash prefix and digest: one row a host and path, `block` if both actions are there.

    A-Z of hosts are lower-cased; a null path is empty and fits every path. Rules
    with a null or empty host, or with another action than allow and block, are left out.
    """
    own = rules.select("action", _lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    own = own.where("host <> '' AND action IN ('allow', 'block')").groupBy("host", "path").agg(F.max("action").alias("action"))
    return own.select(*_keys(F.col("host"), F.col("path")), F.concat("host", "path").alias("rule"), "action", F.length("host").alias("host_length"),
                      F.length(F.concat("host", "path")).alias("rule_length"))


def judge_links(links: DataFrame, rules: DataFrame) -> DataFrame:
    """links with the columns host, path, rule (null if none fits) and verdict (allow or block).

    A rule fits its host and all subdomains if the path starts with the rule's. The
    longest fitting rule wins (host and path together; ties to the longer host,
    which leaves none). Where no rule fits, the verdict is DEFAULT.

    Null links, and texts without `://`, have an empty host and path that no rule
    fits. Repeated rows are all judged; very long links cost one expression a rule
    shape and no more. Empty tables of links or rules are fine. Columns of links
    named like an output column are replaced by it; no other column is touched.

    Each different host and path is judged once. The shapes of the rules (number of
    labels, length of path) come to the driver: their number is bounded by the
    longest rule, not by the rules. A rule table small enough for Spark's own
    broadcast costs no shuffle; a larger one meets the expressions by salted keys.
    """
    parts = links.withColumns({"host": link_host(F.col("url")), "path": link_path(F.col("url"))})
    shapes = sorted({(r[0], r[1]) for r in rules.where("host <> ''").select(
        _labels(F.col("host")), F.length(F.coalesce("path", F.lit("")))).distinct().collect()})
    pairs = parts.select("host", "path").where("host <> ''").distinct()
    host, path = F.col("host"), F.col("path")
    possible = [F.when((_labels(host) >= n) & (F.length(path) >= m), F.struct(F.substring_index(host, ".", -n).alias("suffix"), F.substring(path, 1, m).alias("start")))
                for n, m in shapes]
    none = F.expr("cast(array() as array<struct<suffix:string,start:string>>)")
    asked = pairs.withColumn("link_part", F.explode(F.array_compact(F.array(*possible)) if possible else none))
    asked = asked.select("host", "path", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("link_salt"),
                         *_keys(F.col("link_part.suffix"), F.col("link_part.start")))
    known = rule_table(rules).withColumnRenamed("link_digest", "rule_digest").withColumn("link_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = asked.join(known, ["link_salt", "link_prefix"]).where("link_digest = rule_digest")
    best = hits.groupBy("host", "path").agg(F.max(F.struct("rule_length", "host_length", "rule", "action")).alias("best"))
    best = best.select(host.alias("hit_host"), path.alias("hit_path"), F.col("best.rule").alias("hit_rule"), F.col("best.action").alias("hit_action"))
    kept = [c for c in parts.columns if c not in ("rule", "verdict")]
    left, right = parts.select(*kept).alias("l"), best.alias("r")
    met = left.join(right, (F.col("l.host") == F.col("r.hit_host")) & (F.col("l.path") == F.col("r.hit_path")), "left")
    return met.select(*[F.col(f"l.`{c}`") for c in kept], F.col("r.hit_rule").alias("rule"), F.coalesce("r.hit_action", F.lit(DEFAULT)).alias("verdict"))
