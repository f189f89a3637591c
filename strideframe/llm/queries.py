"""Registered queries of this subpackage: thin steps between the given tables and the operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import decoys, edits, extract, links, outlines, packing, pieces, private, quality, repeats, shards, simhash, spellings
from strideframe.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_AS_RECORD = {"doc_id": "facility_id", "text": "name", "lang": "type"}


def facilities(docs: DataFrame) -> DataFrame:
    """documents as facility records; columns that already have a record's name step aside."""
    aside = {c: f"documents_{c}" for c in docs.columns if c in _AS_RECORD.values()}
    return docs.withColumnsRenamed(aside).withColumnsRenamed(_AS_RECORD)


def documents(records: DataFrame) -> DataFrame:
    """facility records as documents, the way back."""
    back = records.withColumnsRenamed({b: a for a, b in _AS_RECORD.items()})
    return back.withColumnsRenamed({f"documents_{c}": c for c in _AS_RECORD.values()})


def verdicts(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("facility_id"), F.col("quality").alias("good"))


def _places(spark, sf_dir):
    return facilities(_table(spark, sf_dir, "documents"))


def word_count(text):
    """Words of a text: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def op1_nearest_outlines(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("course_id"), F.col("embedding").alias("outline"))
    found = outlines.nearest_outlines(vectors, F.col("course_id") % 50 == 0, 5)
    return found.withColumnRenamed("course_id", "vec_id")


def op2_pack_courses(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    packed = packing.pack_courses(docs.select(F.col("doc_id").alias("course_id"), word_count(F.col("text")).alias("n_points")))
    return packed.select(F.col("course_id").alias("doc_id"), F.col("n_points").alias("n_words"), "bucket", F.col("bucket_points").alias("bucket_words"),
                         "batch", "place", "padding")


def op3_private_spans(spark, sf_dir):
    found = private.private_spans(_places(spark, sf_dir).select("facility_id", "name"))
    spans = F.col("private_spans")
    return found.select(F.col("facility_id").alias("doc_id"), *[private.kind_count(spans, k).alias(f"n_{k}") for k in private.BASE],
                        F.sha2(private.span_text(private.base_spans(spans)), 256).alias("base_sha256"), private.span_text(spans).alias("spans"))


def op4_piece_ids(spark, sf_dir):
    back = pieces.decode_names(pieces.encode_names(_places(spark, sf_dir)))
    return back.select(F.col("facility_id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("name", 256).alias("decoded_sha256"))


def op5_place_quality(spark, sf_dir):
    judged = quality.judge(_places(spark, sf_dir), verdicts(_table(spark, sf_dir, "labels")))
    return judged.select(F.col("facility_id").alias("doc_id"), F.round("evidence", 6).alias("evidence"), F.round("judge_rate", 6).alias("site_rate"),
                         F.round("quality", 6).alias("quality"), (F.col("quality") >= quality.KEEP).cast("int").alias("keep"))


def op6_edit_prints(spark, sf_dir):
    return edits.with_groups(edits.prints_with_next(_places(spark, sf_dir))).withColumnRenamed("facility_id", "doc_id")


def op7_page_texts(spark, sf_dir):
    return extract.page_texts(_table(spark, sf_dir, "pages"))


def op8_hash_shards(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("course_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"))
    return shards.shard_courses(rows).select(F.col("course_id").alias("doc_id"), F.col("size_bytes").alias("n_bytes"), "shard")


def op9_cut_repeats(spark, sf_dir):
    done = repeats.cut_repeats(_places(spark, sf_dir).select("facility_id", "name"))
    return done.select(F.col("facility_id").alias("doc_id"), F.col("repeat_bytes").alias("n_bytes"), F.col("repeat_removed").alias("n_removed"),
                       F.col("repeat_spans").alias("n_spans"), F.sha2("repeat_kept", 256).alias("kept_sha256"))


def op10_simhash_groups(spark, sf_dir):
    prints = cut(simhash.shingle_fingerprints(_places(spark, sf_dir)))
    return simhash.near_groups(prints).select(F.col("facility_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_decoy_outlines(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    shape = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return decoys.decoy_outlines(vectors.select(F.col("vec_id").alias("course_id"), F.col("embedding").alias("outline"), shape.alias("shape")), F.col("course_id") % 100 == 0)


def op12_spelling_forms(spark, sf_dir):
    runs = spellings.name_runs(_places(spark, sf_dir), 6).withColumnRenamed("facility_id", "doc_id")
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run"))
    at = (h % F.length("run")).cast("int")
    spoilt = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(h % 199 == 0, spoilt).otherwise(F.col("run")).alias("word"))
    return spellings.spelling_forms(spellings.word_counts(words, 6, 5), 5)


#: Rules of op13_judge_links: action, host, path.
LINK_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op13_judge_links(spark, sf_dir):
    rules = spark.createDataFrame(LINK_RULES, "action string, host string, path string")
    return links.judge_links(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_nearest_outlines, op2_pack_courses, op3_private_spans, op4_piece_ids, op5_place_quality, op6_edit_prints,
                                    op7_page_texts, op8_hash_shards, op9_cut_repeats, op10_simhash_groups, op11_decoy_outlines, op12_spelling_forms,
                                    op13_judge_links)}

# Vectors share one length in the given table.
ORACLES: dict[str, str] = {
    "op1_nearest_outlines": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, v.e)]) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op11_decoy_outlines": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS shape,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER () AS own FROM v),
s AS (SELECT a.own, a.vec_id AS anchor_id, b.vec_id AS other_id, b.own AS other, a.shape = b.shape AS same,
             CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.e, b.e)]) AS BIGINT) AS score
      FROM r a JOIN r b ON a.own <> b.own WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.own, p.other ORDER BY s.score DESC, s.other_id) AS rank
      FROM p JOIN s ON s.own = p.own AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    # crc32 from its polynomial; words that lose the letter at one place and are then equal differ by a replaced letter there.
    "op12_spelling_forms": """
WITH fold AS (SELECT [list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) FOR b IN range(256)] AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS raw FROM documents WHERE text IS NOT NULL),
low AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m FROM runs WHERE length(raw) >= 6 GROUP BY ALL),
summed AS (SELECT run, m, xor(4294967295, list_reduce(list_prepend(4294967295, flatten([CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END
             FOR x IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')])), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM low, fold),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM summed),
w AS (SELECT word, sum(m)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM w),
gone AS (SELECT word, n, spot, substr(word, 1, spot - 1) || substr(word, spot + 1) AS less FROM gaps),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.less = b.less AND a.spot = b.spot AND a.word <> b.word
         UNION SELECT g.word, w.word, w.n FROM gone g JOIN w ON w.word = g.less
         UNION SELECT w.word, g.word, g.n FROM gone g JOIN w ON w.word = g.less),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
      FROM w LEFT JOIN best ON best.word = w.word AND k = 1),
chain AS (WITH RECURSIVE c AS (SELECT word, coalesce(form, word) AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL) SELECT * FROM c),
root AS (SELECT chain.word, chain.root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL)
SELECT f.word, f.form, root.root, f.n, f.n_near, f.form_n FROM f JOIN root ON root.word = f.word""",
    "op13_judge_links": """
WITH u AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS own FROM pages),
a AS (SELECT own, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM u),
p AS (SELECT own, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS x(action, rule_host, rule_path)),
m AS (SELECT p.*, rule_host || rule_path AS rule, action, row_number() OVER (PARTITION BY own ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
      FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1""",
}
