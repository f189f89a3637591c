"""Operators on small records, each against a brute-force form."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from strideframe.llm import edits, extract, outlines, packing, pieces, private, quality, repeats, shards, simhash

ODD = [(1, None), (2, ""), (2, ""), (3, "  \n\t "), (4, "Han river loop"), (5, "han River  loop"), (None, "Han river loop"), (6, "a" * 3000),
       (7, "Seoul 서울 runs é " * 300), (7, "Seoul 서울 runs é " * 300), (8, "x")]


def places(spark, rows=ODD):
    """Facility records with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "facility_id long, name string")
    return df.withColumns({c: F.lit(1) for c in ("copy", "task", "key", "spans", "fingerprint", "n", "seed")})


def none(spark):
    return places(spark, [])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- outlines -----------------------------------------------------------------------------------

def top(vectors, k):
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            c = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
            good[i] = min(good.get(i, c), c)
    out = []
    for q in good:
        if q % 3 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], good[i])), i) for i in good if i != q and len(good[i]) == len(good[q]))
            out += [(q, n + 1, i, -m) for n, (m, i) in enumerate(s[:k])]
    return sorted(out, key=repr)


def test_outlines_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(outlines, "SHARD_ROWS", 200)
    monkeypatch.setattr(outlines, "LEAF_ROWS", 8)
    monkeypatch.setattr(outlines, "BLOCK_QUERIES", 20)
    rng = random.Random(1)
    vectors = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(500)]
    vectors += [(500 + i, [0.5] * 6) for i in range(60)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6),
                                                             (None, [0.0] * 6), (904, []), (906, []), (907, [1.0, 2.0]), (909, [1.0, 2.0]), (3, [9.0] * 6)]
    df = spark.createDataFrame(vectors, "course_id long, outline array<float>").withColumn("score", F.lit(1))
    assert rows(outlines.nearest_outlines(df, F.col("course_id") % 3 == 0, 5)) == top(vectors, 5)
    assert rows(outlines.nearest_outlines(df.limit(0), F.lit(True), 5)) == []


# ---- packing ------------------------------------------------------------------------------------

def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        lens = sorted(rng.choice((rng.randrange(9), rng.randrange(60))) for _ in range(rng.randrange(1, 40)))
        own = sorted(set(lens))
        n = [lens.count(x) for x in own]
        for k in (1, 2, 3, 50):
            best = {(-1, 0): 0}
            for j, top_ in enumerate(own):
                for b in range(1, k + 1):
                    best[j, b] = min((best[i, b - 1] + sum((top_ - own[x]) * n[x] for x in range(i + 1, j + 1)) for i in range(-1, j) if (i, b - 1) in best), default=10**9)
            want = min(best[len(own) - 1, b] for b in range(1, k + 1))
            bounds = packing.best_bounds(own, n, [a * b for a, b in zip(own, n)], k)
            assert len(bounds) <= k and sum(min(b for b in bounds if b >= x) - x for x in lens) == want


def test_packing_keeps_every_course(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 50)
    rng = random.Random(3)
    data = [(i, rng.choice((5, 5, 5, rng.randrange(900), 200_000))) for i in range(400)] + [(None, 4), (7, None), (7, None), (8, -3)]
    got = packing.pack_courses(spark.createDataFrame(data, "course_id long, n_points long").withColumn("bucket", F.lit(0)), 4, 2000).collect()
    assert sorted(str((r.course_id, r.n_points)) for r in got) == sorted(str((i, max(0, n or 0))) for i, n in data)
    batches = {}
    for r in got:
        assert r.padding == r.bucket_points - r.n_points >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for b in batches.values():
        assert sorted(r.place for r in b) == list(range(len(b))) and (len(b) == 1 or len(b) * b[0].bucket_points <= 2000)
    for k in {k for k, _ in batches}:
        full = max(1, 2000 // max(1, next(r.bucket_points for r in got if r.bucket == k)))
        sizes = [len(b) for (j, _), b in sorted(batches.items()) if j == k]
        assert all(s == full for s in sizes[:-1])
    assert packing.pack_courses(spark.createDataFrame([], "course_id long, n_points long")).collect() == []


def test_histogram_bins_are_ordered(spark):
    n = [*range(4000, 4300), 8191, 8192, 8193, 2**20, 2**31]
    df = spark.createDataFrame([(x,) for x in n], "n_points long")
    got = [r.bin for r in df.select("n_points", packing._bin(F.col("n_points")).alias("bin")).orderBy("n_points").collect()]
    assert got == sorted(got)


# ---- personal data ------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) <= 255, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_private_spans_match_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["4111 1111 1111 1111", "4111-1111 11111111", "a.b%c@d-e.f.g", "@", "1.2.3.4", "256.1.1.1", "001.02.3.255.9", "+82 (10) 1234-5678", "+1", "é😀", ".", " ", "-", "  ",
            "x", "_y@z.kr", "12345678901234567890", "0", "7", "+"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)] + [t for _, t in ODD if t] + ["a" * 50_000 + "@b.c", "1" * 50_000, "a@" + "b." * 9_000 + "c"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "facility_id long, name string").withColumn("kind", F.lit(1))
    got = private.private_spans(df).select("name", private.span_text(private.base_spans(F.col("private_spans"))).alias("s")).collect()
    assert [r.s for r in got] == [base_spans(r.name or "") for r in got]
    assert private.private_spans(none(spark)).collect() == []


def test_checksums_context_and_redaction(spark):
    texts = ["pay GB82 WEST 1234 5698 7654 32 now", "pay GB83 WEST 1234 5698 7654 32 now", "ssn 123-45-6789", "run 123-45-6789", "write a@b.kr, +82 10-1234-5678.", None]
    df = private.private_spans(spark.createDataFrame(list(enumerate(texts)), "facility_id long, name string")).orderBy("facility_id")
    got = [r.s for r in df.select(private.span_text(F.col("private_spans")).alias("s")).collect()]
    assert got == ["iban:4:31", "", "ssn:4:15", "", "email:6:12,phone:14:30", ""]
    clean = [r.c for r in df.select(private.redacted(F.col("name"), F.col("private_spans")).alias("c")).collect()]
    assert clean == ["pay [IBAN] now", texts[1], "ssn [SSN]", texts[3], "write [EMAIL], [PHONE].", None]


def _all_spans(spark, texts):
    df = private.private_spans(spark.createDataFrame(list(enumerate(texts)), "facility_id long, name string")).orderBy("facility_id")
    return [[x for x in r.s.split(",") if x] for r in df.select(private.span_text(F.col("private_spans")).alias("s")).collect()]


def test_account_numbers_end_at_their_length(spark):
    numbers = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]
    texts = [f"{a}{n}{b}" for n in numbers for a in ("", "IBAN ", "AB12 ", "BE99 ") for b in ("", " BIC COBADEFF", " 2024-01-01", " A b", " now", ".", f" {numbers[1]}")]
    got = _all_spans(spark, texts)
    for text, spans in zip(texts, got, strict=True):
        want = {f"iban:{m.start()}:{m.end()}" for n in numbers for m in re.finditer(n, text)}
        assert {s for s in spans if s.startswith("iban")} == want, text
    assert _all_spans(spark, ["DE88370400440532013000 BIC", "xDE89370400440532013000", "DE89370400440532013000x"]) == [[], [], []]


def test_context_of_lists_and_trailing_words(spark):
    one, two = "123-45-6789", "987-65-4321"
    many = ", ".join(f"{i:03d}-45-6789" for i in range(100, 112))
    texts = [f"SSN: {one}, {two}", f"{one} (SSN)", f"SSNs: {one}", f"SSNs: {many}", f"{many} are social insurance numbers", f"SSN {one}\n{two} and {one}",
             f"run {one}, {two}", f"ssn {one}" + " x" * 60 + f" {two}", f"classn {one}"]
    assert [len(s) for s in _all_spans(spark, texts)] == [2, 1, 1, 12, 12, 3, 0, 1, 0]


# ---- pieces -------------------------------------------------------------------------------------

def test_pieces_equal_the_model_and_round_trip(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcthein \né日") for _ in range(rng.randrange(400))) for _ in range(60)] + ["<0x0A> <s>", "the" * 400, "😀"]
    df = places(spark, [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in ODD if i is not None])
    back = pieces.decode_names(pieces.encode_names(df))
    want = sorted((r.facility_id, tuple(model.encode(r.name or "")), r.name or "") for r in df.collect())
    assert sorted((r.facility_id, tuple(r.ids), r["name"]) for r in back.collect()) == want
    assert pieces.encode_names(none(spark)).collect() == []


# ---- quality ------------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id facility_id", "text name", "source", "lang type")
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id facility_id", "quality good")
    judged = {r.facility_id: r.quality for r in quality.judge(docs, labels.where("facility_id % 2 = 0")).collect()}
    held = labels.where("facility_id % 2 = 1").collect()
    assert np.mean([(judged[r.facility_id] >= 0.5) == bool(r.good) for r in held]) > 0.97


def test_quality_of_odd_tables(spark):
    df = places(spark).withColumns({"source": F.when(F.col("facility_id") > 4, "s"), "type": F.lit(None).cast("string"), "judge": F.lit(1)})
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, None), (None, 1), (99, 1)], "facility_id long, good int")
    assert quality.judge(df, labels).count() == len(ODD)
    assert quality.keep_good(df, labels.limit(0)).columns == df.columns and quality.keep_good(df, labels.limit(0)).count() == len(ODD)
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.judge(df.limit(0), labels).count() == quality.keep_good(df.limit(0), labels).count() == 0


def test_sparse_sites_shrink_to_the_global_rate(spark):
    data = [("big", "a", 4.0)] * 300 + [("bad", "a", -4.0)] * 300 + [("one", "a", -4.0)]
    rates, rate = quality.judge_rates(spark.createDataFrame(data, "source string, type string, evidence double"))
    got = {r.judge_source: r.judge_rate for r in rates.collect()}
    assert got["bad"] < got["one"] < rate < got["big"]


# ---- fingerprints -------------------------------------------------------------------------------

def test_edit_prints_follow_edits(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(800)) for _ in range(30)]
    one = [t[:300] + "Z" + t[300:] for t in base]
    a, b = edits.walk_prints(base), edits.walk_prints(one)
    assert edits.likeness(a, b).mean() > 0.9 and edits.likeness(a, np.roll(a, 1, 0)).max() < 0.15
    assert (np.concatenate([edits.walk_prints([t]) for t in base]) == a).all()
    df = spark.createDataFrame(list(enumerate(base + one[:10] + base[:5])), "facility_id long, name string")
    groups = {r.facility_id: r.group_id for r in edits.near_names(edits.name_prints(df)).collect()}
    assert all(groups[40 + i] == i for i in range(5)) and len({groups[i] for i in range(30)}) == 30
    assert sum(groups[30 + i] == i for i in range(10)) >= 9


def test_edit_prints_with_next(spark, monkeypatch):
    monkeypatch.setattr(edits, "TASK_ROWS", 2)
    data = [r for r in ODD if r[0] is not None and r[0] != 2] + [(50, "end of the list")]
    got = edits.prints_with_next(places(spark, data)).collect()
    order = sorted(data, key=lambda r: r[0])
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((r.facility_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_id = {r.facility_id: r for r in got}
    assert by_id[1].fingerprint == "0" * 256 and by_id[1].near_edited == 1.0
    assert edits.prints_with_next(places(spark)).count() == len(ODD) and edits.prints_with_next(none(spark)).count() == 0


def test_edit_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(edits, "PART_ROWS", 50)
    rng = random.Random(14)
    texts = []
    for size in (600, 30, 8) * 8:
        base = "".join(rng.choices("abcdefghij klmno", k=size))
        for _ in range(20):
            t = list(base)
            for _ in range(max(1, int(size * rng.uniform(0.01, 0.08)))):
                t[rng.randrange(len(t))] = rng.choice("pqrs")
            texts.append("".join(t))
            base = rng.choice((base, texts[-1]))
    texts += ["", "a", "ab", "a"]
    prints = edits.walk_prints(texts)
    label = np.arange(len(texts))
    for i in range(len(texts)):
        for j in np.flatnonzero(edits.likeness(prints[i][None], prints) >= 0.8):
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "facility_id long, name string")
    got = {r.facility_id: r.group_id for r in edits.with_groups(edits.name_prints(df)).collect()}
    assert got == dict(enumerate(label.tolist())) and 20 < len(set(got.values())) < len(texts) - 100
    assert edits.with_groups(edits.name_prints(none(spark))).count() == 0


# ---- pages --------------------------------------------------------------------------------------

def test_pages_held_out_and_odd(spark):
    field = extract.train(extract.labelled_pages(200))
    right = total = 0
    for blocks, labels in extract.labelled_pages(150, seed=31):
        if blocks:
            scores = [sum(field.weights.get(f, 0.0) for f in x) for x in extract.page_features(blocks, {})]
            right += sum(a == b for a, b in zip(field.decode(scores), labels))
            total += len(labels)
    assert right / total > 0.98
    html = ["<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Han &amp; river</h1><p>Five  good\nkilometres along the water.<br><p>It ends at the bridge, near the park.</article><footer>&copy; x</footer>",
            "<p>", "", None, "<div class='content'><p>A long run begins in the north of the city, and it is flat.</p></div><script>if (a < b) '</p>'</script>", "<" * 5000, "<p " + "a" * 20000]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in extract.page_texts(df).collect()}
    assert got[0].text == "Han & river Five good kilometres along the water. It ends at the bridge, near the park."
    assert [got[i].text for i in (1, 2, 3)] == ["", "", ""] and got[4].text.startswith("A long run") and all(r.n_chars == len(r.text) for r in got.values())
    assert extract.page_texts(df.limit(0)).count() == 0


# ---- shards -------------------------------------------------------------------------------------

def test_shards_keep_to_the_limit(spark):
    rng = random.Random(8)
    data = [(i, rng.randrange(2000)) for i in range(3000)] + [(9999, 50_000)] + [(7, 900)] * 200 + [(None, None), (5, None), (6, -1)]
    df = spark.createDataFrame(data, "course_id long, size_bytes long").withColumn("bits", F.lit(1))
    got = shards.shard_courses(df, 20_000)
    assert sorted(str(r[:2]) for r in got.select("course_id", "size_bytes").collect()) == sorted(str(r) for r in data)
    sizes = shards.shard_sizes(got).collect()
    assert all(r["size"] <= 20_000 or r["n"] == 1 for r in sizes)
    names = [r.shard.split(".")[0] for r in sizes]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert len({r.shard for r in shards.shard_courses(df, 10**9).collect()}) == 1 and shards.shard_courses(df.limit(0)).count() == 0


# ---- repeats ------------------------------------------------------------------------------------

def removed(data, least):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in data]
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - least + 1):
                w = t[p:p + least]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - least + 1):
            if i is not None and first[t[p:p + least]] < i:
                gone[p:p + least] = [True] * least
        out.append((i, len(t), sum(gone), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [4096, 2])
def test_repeats_match_brute_force(spark, most):
    rng = random.Random(9)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(6)]
    parts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    data = [(rng.randrange(60), "".join(rng.choice((rng.choice(parts), rng.choice(parts)[:rng.randrange(90)], "q%d" % rng.randrange(99))) for _ in range(rng.randrange(6)))) for _ in range(80)]
    data += [(70 + i, parts[0][i:] + str(i)) for i in range(8)] + ODD
    df = places(spark, data)
    spans = repeats.repeated_spans(df, 50, 20, most)
    got = repeats.cut_repeats(df)
    assert rows(got.select("facility_id", "repeat_bytes", "repeat_removed", "repeat_kept")) == [(i, n, g, bytearray(k)) for i, n, g, k in removed(data, 50)]
    if most == 2:
        cover = {(r.facility_id, r.copy): sum(len(range(lo, hi)) for lo, hi in _union(r.spans)) for r in spans.collect()}
        want = repeats.repeated_spans(df)
        assert cover == {(r.facility_id, r.copy): sum(len(range(lo, hi)) for lo, hi in _union(r.spans)) for r in want.collect()}
    assert repeats.cut_repeats(none(spark)).count() == 0
    assert repeats.without_repeats(df).columns == df.columns


def test_anchors_are_shuffled_in_turns(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdef ") for _ in range(900)) for _ in range(6)]
    batch = pa.RecordBatch.from_pydict({"facility_id": pa.array(range(6), pa.int64()), "copy": pa.array([0] * 6, pa.int32()), "name": texts})

    def marks(*turn):
        return [tuple(r.values()) for b in repeats._anchor_rows(50, 20, *turn)(iter([batch])) for r in b.to_pylist()]

    parts = [marks(k, repeats.TURNS) for k in range(repeats.TURNS)]
    assert sorted(x for p in parts for x in p) == sorted(marks()) and max(map(len, parts)) < 0.4 * len(marks())
    kept, settle = [], repeats.settle
    monkeypatch.setattr(repeats, "settle", lambda df: kept.append(df.columns) or settle(df))
    df = places(spark, [(i, texts[i % 3]) for i in range(6)])
    assert repeats.cut_repeats(df).where("repeat_removed > 0").count() == 3
    assert sum("mixed" in c for c in kept) == repeats.TURNS > 1


def _union(spans):
    out = []
    for lo, hi in sorted(tuple(s) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


# ---- SimHash ------------------------------------------------------------------------------------

def fingerprint(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    got = rows(simhash.shingle_fingerprints(places(spark)))
    want = sorted(((i, (f := fingerprint(t, 3)) - (f >> 63 << 64)) for i, t in ODD), key=repr)
    assert got == want


@pytest.mark.parametrize("most", [20_000, 3])
def test_groups_match_brute_force(spark, most):
    rng = random.Random(10)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        p = rng.choice(prints)
        for _ in range(rng.choice((0, 1, 2, 3, 4))):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    df = spark.createDataFrame([(i, p - (p >> 63 << 64)) for i, p in enumerate(prints)], "facility_id long, fingerprint long")
    links = simhash.near_prints(df, most)
    forest = {r.node: r.root for r in simhash.star_forest(links).collect()}
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = simhash._join_labels(np.arange(len(a)), *np.nonzero(near))
    signed = a.view(np.int64).tolist()
    roots = [forest.get(p, p) for p in signed]
    assert len({(x, y) for x, y in zip(roots, label.tolist())}) == len(set(roots)) == len(set(label.tolist()))
    if most > 3:
        assert {r.facility_id: r.component_id for r in simhash.near_groups(df).collect()} == {i: int(label[i]) for i in range(len(a))}
        assert simhash.near_groups(df.limit(0)).count() == 0


def test_near_copies(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(250)] for _ in range(12)]
    data = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        near = list(b)
        near[rng.randrange(250)] = "changed"
        near[rng.randrange(250)] = "again"
        data += [(100 + i, " ".join(near)), (200 + i, " ".join(b)), (300 + i, " ".join(rng.sample(b, 250)))]
    data += [(400, None), (401, ""), (None, "lost"), (None, None)]
    df = places(spark, data)
    kept = {r.facility_id for r in simhash.without_near_copies(df).collect()}
    assert kept == {*range(12), *range(300, 312), 400, None}
    assert simhash.without_near_copies(none(spark)).count() == 0


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def _near(a, b):
    return len(a & b) / len(a | b) >= 0.8


def test_near_copies_hold_for_cuts_and_additions(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(2000)]
    base = [rng.choices(words, k=rng.choice((60, 150, 400))) for _ in range(90)]
    change = (lambda w: w[:int(len(w) * 0.9) + 1], lambda w: w + rng.choices(words, k=len(w) // 10), lambda w: w[len(w) // 10:])
    near = [change[i % 3](w) for i, w in enumerate(base)]
    data = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w)) for i, w in enumerate(near)]
    assert all(_near(_shingles(data[i][1]), _shingles(data[90 + i][1])) for i in range(90))
    got = {r.facility_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(data, "facility_id long, name string")).collect()}
    assert got == {i: i % 100 for i in got} and len(got) == 180


def test_near_copies_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 7)
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(2000)]
    texts = []
    for k in range(30):
        w = rng.choices(words, k=rng.choice((20, 100, 300)))
        for _ in range(4 if k else 20):
            texts.append(" ".join(w))
            cut, fresh = rng.uniform(0.06, 0.22), rng.uniform(0, 0.08)
            w = w[int(len(w) * cut * (k % 2)):] if rng.random() < 0.5 else w[:int(len(w) * (1 - cut))] + rng.choices(words, k=int(len(w) * fresh))
    sets = [_shingles(t) for t in texts]
    near = np.array([[_near(a, b) for b in sets] for a in sets])
    label = simhash._join_labels(np.arange(len(texts)), *np.nonzero(near))
    got = {r.facility_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "facility_id long, name string")).collect()}
    assert got == dict(enumerate(label.tolist())) and 30 < len(set(got.values())) < len(texts) - 20


# ---- pipeline -----------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.withColumns({"name": F.lit("x"), "spans": F.lit(1)}), sf)
        if k < 4:
            assert set(docs.columns) <= set(out.columns) and 0.6 * n < out.count() <= n
            docs = repeats.settle(out.select(*docs.columns))
        else:
            assert out.count() == docs.count()
    assert docs.where("n_chars <> length(text)").count() == 0
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
