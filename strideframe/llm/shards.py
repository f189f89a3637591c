"""Shards of bounded size by extendible hashing.

Records: courses (course_id, size_bytes, any further columns), the stored size of
each course. A null or negative size counts as 0; a null id is hashed like a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.tables import set_aside, without
from strideframe.session import cut

LIMIT = 16 * 2**20
AHEAD = 6


def hash_bits(*keys: str) -> Column:
    """64 hash bits of a row's key as a string of 0 and 1, first bit first."""
    return F.lpad(F.bin(F.xxhash64(*keys)), 64, "0")


def _directory(rows: DataFrame, limit: int) -> DataFrame:
    """(bits, shard): rows (mark, size, salt) by enough hash bits to tell their shards apart.

    Starts from one bucket; only buckets over the limit are split on the next bit.
    AHEAD bits are counted per pass over the rows, and the splits in between are made
    on these counts.
    """
    done, depth, open_ = [], 0, None
    while True:
        deep = min(64, depth + AHEAD)
        part = rows if open_ is None else rows.withColumn("over", F.substr("mark", F.lit(1), F.lit(depth))).join(open_, "over", "left_semi")
        counts = cut(part.groupBy(F.substr("mark", F.lit(1), F.lit(deep)).alias("bits")).agg(F.sum("size").alias("size")))
        marked = counts
        for d in range(depth, deep + 1):
            w = Window.partitionBy(F.substr("bits", F.lit(1), F.lit(d)))
            marked = marked.withColumn(f"at_{d}", F.sum("size").over(w))
        fits = reduce(lambda rest, d: F.when(F.col(f"at_{d}") <= limit, F.lit(d)).otherwise(rest), range(deep, depth - 1, -1), F.lit(None).cast("int"))
        placed = cut(marked.select("bits", fits.alias("depth")))
        done.append(placed.where("depth IS NOT NULL").select("bits", F.substr("bits", F.lit(1), F.col("depth")).alias("shard")))
        open_ = placed.where("depth IS NULL").select(F.col("bits").alias("over"))
        if deep == 64 or open_.isEmpty():
            if deep == 64:
                done.append(open_.select(F.col("over").alias("bits"), F.col("over").alias("shard")))
            return reduce(DataFrame.unionByName, done)
        depth = deep


def shard_courses(courses: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All columns of `courses` with shard: the hash prefix, as bits, of the shard that holds the row.

    The directory is indexed by the bits of a hash of course_id and size; a bucket
    over `limit` bytes is split on its next bit, the others stay. A shard stays over
    the limit only where one single row is larger than it, or rows with one hash
    (repeated rows), which are then dealt to numbered parts of it ("bits.part") whose
    sizes keep to the limit. The empty prefix is the shard of a table that fits whole.

    Null ids and sizes are hashed as such, a null or negative size counts 0. An empty
    table gives none. A column named shard is replaced; other columns stay, whatever
    their names.
    """
    courses, back = set_aside(without(courses, "shard"), "shard_mark", "shard_bits", "shard_size")
    size = F.greatest(F.coalesce(F.col("size_bytes").cast("long"), F.lit(0)), F.lit(0))
    keyed = courses.withColumn("shard_mark", hash_bits("course_id", "size_bytes"))
    slim = cut(keyed.select(F.col("shard_mark").alias("mark"), size.alias("size")))
    directory = cut(_directory(slim, limit))
    depths = [r[0] for r in directory.select(F.length("bits")).distinct().collect()]
    # One lookup per width of the directory; at most 64 / AHEAD of them, most tables have one or two.
    out = None
    for d in sorted(depths) or [0]:
        side = directory.where(F.length("bits") == d).withColumnRenamed("bits", "shard_bits")
        got = keyed.withColumn("shard_bits", F.substr("shard_mark", F.lit(1), F.lit(d))).join(side, "shard_bits").drop("shard_bits")
        out = got if out is None else out.unionByName(got)
    single = F.length("shard") == 64
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    number = F.floor(place / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), size))))
    part = F.when(single, F.concat_ws(".", "shard", F.spark_partition_id().cast("string"), number.cast("string"))).otherwise(F.col("shard"))
    return back(out.withColumn("shard", part).drop("shard_mark"))


def shard_sizes(sharded: DataFrame) -> DataFrame:
    """(shard, n, size): what each shard holds."""
    size = F.greatest(F.coalesce(F.col("size_bytes").cast("long"), F.lit(0)), F.lit(0))
    return sharded.groupBy("shard").agg(F.count("*").alias("n"), F.sum(size).alias("size"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard under `path`."""
    sharded.withColumn("folder", F.concat(F.lit("s"), F.col("shard"))).repartition("folder").write.partitionBy("folder").parquet(path)
