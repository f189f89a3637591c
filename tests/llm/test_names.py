"""Columns named like the operators' own ones: outputs take their place, all others stay as they were."""

from pyspark.sql import functions as F

import corpus_pipeline
from strideframe.llm import edits, quality, repeats, shards, simhash
from strideframe.llm.tables import set_aside, without

TEXT = "A quiet path leads past the old mill and along the river to the second bridge, where the lamps are lit until late at night. "


def records(spark, *names):
    rows = [(i, TEXT * 2 + str(i % 3), "web", "en") for i in range(12)] + [(None, None, None, None), (12, "", "web", "en")]
    df = spark.createDataFrame(rows, "facility_id long, name string, source string, type string")
    return df.withColumns({c: F.concat(F.lit("own "), F.coalesce(F.col("facility_id").cast("string"), F.lit("none"))) for c in names})


def kept(df, *names):
    """Whether the further columns still belong to their rows."""
    return all(r[c] == f"own {'none' if r.facility_id is None else r.facility_id}" for r in df.collect() for c in names)


def test_helpers_ignore_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Shard int, other int, aside_other int")
    assert without(df, "shard").columns == ["other", "aside_other"]
    moved, back = set_aside(df, "OTHER")
    assert "other" not in moved.columns and back(moved).columns == df.columns and back(moved).first() == (1, 2, 3)


def test_shards(spark):
    df = records(spark, "shard_mark", "shard_bits", "mark").withColumnRenamed("facility_id", "course_id").withColumns({"size_bytes": F.lit(100), "shard": F.lit("mine")})
    got = shards.shard_courses(df, 400)
    assert sorted(got.columns) == sorted(df.columns) and got.count() == 14 and got.where("shard = 'mine'").count() == 0
    assert kept(got.withColumnRenamed("course_id", "facility_id"), "shard_mark", "shard_bits", "mark")
    assert shards.shard_courses(df.limit(0), 400).collect() == []


def test_groups(spark):
    prints = edits.prints_with_next(records(spark, "group_id", "copy")).withColumn("group_id", F.lit("mine"))
    got = edits.with_groups(prints)
    assert got.columns.count("group_id") == 1 and got.schema["group_id"].dataType.simpleString() == "bigint" and got.count() == 14
    marks = simhash.shingle_fingerprints(records(spark)).withColumn("component_id", F.lit("mine"))
    near = simhash.near_groups(marks)
    assert near.columns.count("component_id") == 1 and near.schema["component_id"].dataType.simpleString() == "bigint" and near.count() == 14


def test_repeats(spark):
    inner = ("repeat_id", "repeat_of", "repeat_copy", "repeat_ranges", "copy")
    df = records(spark, "repeat_bytes", *inner)
    got = repeats.cut_repeats(df)
    assert got.columns.count("repeat_bytes") == 1 and got.where("repeat_bytes = octet_length(coalesce(name, ''))").count() == 14 and kept(got, *inner)
    text = repeats.without_repeats(df)
    assert text.columns == df.columns and kept(text, "repeat_bytes", *inner)
    assert repeats.without_repeats(df.limit(0)).collect() == []


def test_quality(spark):
    inner = ("judge_source", "judge_type", "judge_rate", "evidence", "quality")
    df = records(spark, *inner)
    verdicts = spark.createDataFrame([(i, i % 2) for i in range(12)], "facility_id long, good int")
    got = quality.keep_good(df, verdicts, 0.0)
    assert got.columns == df.columns and got.count() == 14 and kept(got, *inner)
    assert quality.keep_good(df.limit(0), verdicts).collect() == []


def test_pipeline_stages_keep_further_columns(spark, tmp_path):
    own = ("judge_rate", "judge_source", "private_spans", "repeat_bytes", "facility_id", "name", "copy", "group_id", "shard", "item")
    rows = [(i, f"{TEXT}Number {i} is known as {'x' * i}. Write to a{i}@example.org.", "en", "web", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {c: F.concat(F.lit("own "), F.col("doc_id").cast("string")) for c in own})
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns), name
        assert all(r[c] == f"own {r.doc_id}" for r in out.collect() for c in own), name
