"""Decoy outlines, spelling forms and link rules, each against a brute-force form."""

from __future__ import annotations

import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import decoys, links, queries, spellings


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- decoys -------------------------------------------------------------------------------------

def mined(outlines, step, k=5):
    good = [(i, s, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, s, v in outlines
            if i is not None and s is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, s, v) in enumerate(good):
        if i % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, b, t == s) for b, (j, t, w) in enumerate(good) if b != a and len(w) == len(v)]
        for p, j, _, _ in sorted(x for x in scored if x[3])[:k]:
            fits = sorted(x for x in scored if not x[3] and -80 * p <= -100 * x[0] <= -100 * p)[:k]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fits)]
    return sorted(out, key=repr)


@pytest.fixture()
def small_shards(monkeypatch):
    monkeypatch.setattr(decoys, "SHARD_ROWS", 60)
    monkeypatch.setattr(decoys, "LEAF_ROWS", 8)
    monkeypatch.setattr(decoys, "FAN_OUT", 3)
    monkeypatch.setattr(decoys, "BLOCK_ASKS", 20)


def test_decoys_match_brute_force(spark, small_shards):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    data = []
    for i in range(420):
        c = rng.randrange(5)
        data.append((i, str(c) if i % 5 else str((c + 1) % 5), [float(np.float32(x + rng.gauss(0, 0.3))) for x in centres[c]]))
    data += [(1000 + i, str(i % 3), [0.5] * 6) for i in range(150)]  # equal outlines: more than a shard holds, ties go by id
    data += [(2001, "1", None), (2002, None, [1.0] * 6), (2003, "1", [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, "1", [float("nan")] * 6), (2005, "1", [float("-inf")] * 6),
             (None, "1", [0.5] * 6), (2010, "1", []), (2011, "2", []), (2012, "1", []), (2020, "0", [1.0, 2.0]), (2021, "0", [1.0, 2.0]), (2022, "1", [1.0, 2.0]),
             (1010, "2", [0.5] * 6), (1010, "2", [0.5] * 6), (20, "1", [9.0] * 6), (2030, "0", [-1.0, 0.0]), (2031, "0", [1.0, 0.0]), (2033, "1", [1.0, 0.0])]
    df = spark.createDataFrame(data, "course_id long, shape string, outline array<float>").withColumn("score", F.lit(1)).withColumn("shard", F.lit("a"))
    got = decoys.decoy_outlines(df, F.col("course_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows(got) == mined(data, 10)
    assert rows(decoys.decoy_outlines(df.limit(0), F.col("course_id") % 10 == 0)) == []
    assert rows(decoys.decoy_outlines(df.where("course_id IN (2001, 2004)"), F.lit(True))) == []


def test_long_outlines_and_number_shapes(spark):
    rng = np.random.default_rng(3)
    data = [(i, i % 2, [float(x) for x in rng.normal(size=3000).astype(np.float32) + 1]) for i in range(24)]
    got = decoys.decoy_outlines(spark.createDataFrame(data, "course_id long, shape int, outline array<float>"), F.col("course_id") % 6 == 0)
    want = mined(data, 6)
    assert want and rows(got) == want


def test_packed_tree_holds_every_row_in_tight_boxes():
    rng = np.random.default_rng(5)
    cells = rng.integers(-9, 9, (500, 4)).astype(float)
    tree = decoys.RTree(np.arange(500), np.arange(500), ["a"] * 250 + ["b"] * 250, cells, cells, 16, 4)
    assert sorted(tree.ids.tolist()) == list(range(500)) and all(b - a <= 16 for a, b in tree.spans)
    asked = rng.normal(size=(5, 4))
    least, greatest = tree.intervals(asked)
    for node, (a, b) in enumerate(tree.spans):
        assert (tree.box_low[node] == tree.low[a:b].min(0)).all() and (tree.box_high[node] == tree.low[a:b].max(0)).all()
        scores = asked @ tree.low[a:b].T
        assert (scores.min(1) >= least[:, node] - 1e-9).all() and (scores.max(1) <= greatest[:, node] + 1e-9).all()
    assert sorted(k for kids in tree.children for k in kids) == list(range(len(tree.least) - 1))


def test_tiles_are_bounded(spark, small_shards):
    rng = random.Random(2)
    data = [(i, "a", [float(20 * (i % 8) + rng.random()), float(20 * (i % 8) + rng.random())]) for i in range(960)]
    kept = decoys.deal_tiles(decoys.usable_outlines(spark.createDataFrame(data, "course_id long, shape string, outline array<float>"))).collect()
    sizes = {}
    for r in kept:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert len(kept) == 960 and max(sizes.values()) <= 2 * 60 and len(sizes) >= 8


def test_rows_of_asks_are_not_broadcast(spark, small_shards):
    rng = random.Random(3)
    data = [(i, "ab"[i % 2], [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    outlines = spark.createDataFrame(data, "course_id long, shape string, outline array<float>")
    rows_ = decoys.cut(decoys.deal_tiles(decoys.usable_outlines(outlines)))
    trees, roots = decoys.plant(rows_)
    asks = decoys.cut(rows_.where("course_id % 5 = 0").select("*", F.concat_ws(":", "course_id", "mark").alias("ask"), F.lit(True).alias("same"),
                                                              F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")))
    for found in (decoys.best_in_window(trees, roots, asks, 3), decoys.decoy_outlines(outlines, F.col("course_id") % 5 == 0, 3)):
        assert not re.search(r"BroadcastHashJoin \[(ask|anchor)#", found._jdf.queryExecution().sparkPlan().toString())


# ---- spellings ----------------------------------------------------------------------------------

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def forms(n):
    out, form = [], {}
    close = {w: [o for o in n if near(w, o)] for w in n}
    for w in n:
        best = min(close[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def edited(rng, w, letters):
    i, kind = rng.randrange(len(w)), rng.randrange(3)
    return w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind < 2):]


def test_forms_match_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdeéß"
    n = {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        n[w] = 10 ** rng.randrange(2, 6)
        for _ in range(12):
            e = w
            for _ in range(rng.randrange(1, 4)):
                e = edited(rng, e, letters)
            if len(e) >= 6:
                n.setdefault(e, rng.randrange(5, 60))
    n |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "abababab": 7, "abababa": 7, "babababa": 7, "ababababa": 40}
    n |= {"tiefer": 5, "tiefen": 30, "tiefes": 30, "x" * 3000: 5, "x" * 2999 + "y": 50, "서울숲공원길": 5, "서울숲공원": 90, "서울숲공월길": 40}
    df = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("root", F.lit("r")).withColumn("place", F.lit(1))
    got = rows(spellings.spelling_forms(df, 5))
    assert got == forms(n) and sum(1 for r in got if r[1] != r[2] and r[1]) >= 5
    odd = spark.createDataFrame([(None, 5), ("abc", 9), ("abcdef", 5)], "word string, n long")
    assert rows(spellings.spelling_forms(odd)) == [("abcdef", None, "abcdef", 5, 0, None)]
    assert rows(spellings.spelling_forms(odd.limit(0))) == []


def test_words_are_not_broadcast(spark):
    counts = spark.createDataFrame([("kitten", 9), ("mitten", 90), ("kittens", 5), ("garden", 7)], "word string, n long")
    assert "Broadcast" not in spellings.near_words(counts)._jdf.queryExecution().sparkPlan().toString()
    found = spellings.spelling_forms(counts)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert rows(found) == [("garden", None, "garden", 7, 0, None), ("kitten", "mitten", "mitten", 9, 2, 90), ("kittens", None, "kittens", 5, 1, None), ("mitten", None, "mitten", 90, 1, None)]


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(8)
    for _ in range(200):
        places = sorted(rng.sample(range(9), 3))
        costs = [rng.randrange(5) for _ in places]
        a, b = spellings.best_pivots(places, costs)
        assert places[b] - places[a] >= 2
        assert costs[a] + costs[b] == min(costs[i] + costs[j] for i in range(3) for j in range(i) if places[i] - places[j] >= 2)


def test_spelling_query_on_odd_texts(spark, tmp_path):
    rng = random.Random(6)
    texts = [(None, "Garten garten GARTEN gärten"), (1, None), (2, ""), (3, "12 ; --"), (4, "étrange étranges "
             * 40)]
    texts += [(10 + i, " ".join(rng.choice(("Morgen", "morgens", "ÉTRANGE", "garten-haus", "x" * 500)) for _ in range(60))) for i in range(60)]
    texts += [(10, "Morgen morgens")] * 2  # repeated ids
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("run", F.lit("r")).withColumn("facility_id", F.lit("f")).write.parquet(f"{tmp_path}/documents.parquet")
    n = {}
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                n[run] = n.get(run, 0) + 1
    want = forms({w: m for w, m in n.items() if m >= 5})
    assert want and rows(queries.op12_spelling_forms(spark, str(tmp_path))) == want


# ---- links --------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http:///en/", "https://Example.com/en/5?x=1", "https://example.com/en", "https://www.EXAMPLE.com/en/x#y", "ftp://a.www.example.com/en/x",
        "http://notexample.com/en/1", "http://example.com?/en/", "http://example.com#/en/", "http://b.net/es/1", "http://net/fr/", "http://net.fr/", "http://x.net/ES/",
        "a://b://c.net/es/1", "http://.example.com/en/1", "http://example.com./en/1", "http://a..com/", "http://EXÄMPLE.net/fr/ü", "http://x.net/es/" + "p" * 20000,
        "http://" + "a." * 3000 + "example.com/en/z", "http://user@x.com:80/en/", "x" * 30000, "http://deep.org/a/b/c", "http://deep.org/a/", "http://exact.org/only"]
RULES = [*queries.LINK_RULES, ("block", "DEEP.org", "/a/b"), ("allow", "deep.org", "/a/b/c"), ("block", "exact.org", "/only"), ("allow", "exact.org", "/only"),
         ("block", "x.com:80", None), ("block", None, "/"), ("block", "", "/"), ("maybe", "b.net", "/es/1")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    host, best = host.translate(low), None
    for action, h, p in RULES:
        h, p = (h or "").translate(low), p or ""
        if h and action in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), h + p, action))
    return (url, host, path, best and best[2], best[3] if best else "allow")


def test_rules_match_brute_force(spark):
    data = [(u,) for u in [*URLS, *URLS[5:9], *["http://b.net/es/1"] * 200]]
    df = spark.createDataFrame(data, "url string").withColumns({c: F.lit("mine") for c in ("rule", "verdict", "path", "action", "link_salt", "hit_rule")})
    rules = spark.createDataFrame(RULES, "action string, host string, path string").withColumn("url", F.lit("u"))
    got = links.judge_links(df, rules)
    assert sorted(got.columns) == sorted(["url", "rule", "verdict", "path", "host", "action", "link_salt", "hit_rule"])
    assert {(r.action, r.link_salt, r.hit_rule) for r in got.collect()} == {("mine",) * 3}
    assert rows(got.select("url", "host", "path", "rule", "verdict")) == sorted((judged(u) for u, in data), key=repr)
    assert rows(links.judge_links(df, rules.limit(0)).select("rule", "verdict").distinct()) == [(None, "allow")]
    assert rows(links.judge_links(df.limit(0), rules)) == []


def test_rules_met_by_shuffle(spark):
    """With broadcasts off, the salted keys give the same rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(u,) for u in URLS], "url string")
        rules = spark.createDataFrame(RULES, "action string, host string, path string")
        got = links.judge_links(df, rules).select("url", "host", "path", "rule", "verdict")
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got) == sorted((judged(u) for u in URLS), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
