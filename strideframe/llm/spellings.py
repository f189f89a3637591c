"""Spelling variants among the words of facility names.

Records: facilities (facility_id, name). Words of one edit's distance are found by
pivotal bigrams. Bigrams are ranked by how many words hold them, rarest first. A
word's prefix is its three first bigrams by rank; one edit touches at most two of
them, and of two disjoint bigrams (the pivots) it leaves one whole. So if the prefix
of one word reaches as far as that of a near one, it holds one of that word's pivots,
at most one place off, and all on one side of it is equal in both.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.session import cut

#: Letters of a run: A-Z, a-z and the signs from U+00C0 to U+00FF.
RUN = r"[A-Za-zÀ-ÿ]"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def name_runs(facilities: DataFrame, least_length: int = 1) -> DataFrame:
    """(facility_id, run): the maximal runs of letters of every whole name, A-Z lower-cased; shorter runs are left out. Null names have none."""
    runs = F.regexp_extract_all(F.col("name"), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    return facilities.select("facility_id", F.explode(runs).alias("run")).withColumn("run", lower_ascii(F.col("run")))


def word_counts(words: DataFrame, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n): how often each word of at least `least_length` code points occurs, if at least `least_n` times."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def best_pivots(places: list[int], costs: list[int]) -> tuple[int, int]:
    """Indices of the two disjoint bigrams of least total cost; places ascend.

    Dynamic programming by place: `one` is the cheapest bigram that ends before the
    present one begins, `two` the cheapest pair so far. Ties go to the earlier pair.
    """
    one, two, seen = None, None, 0
    for i, at in enumerate(places):
        while places[seen] <= at - 2:
            if one is None or costs[seen] < costs[one]:
                one = seen
            seen += 1
        if one is not None and (two is None or costs[one] + costs[i] < costs[two[0]] + costs[two[1]]):
            two = one, i
    return two


_GRAMS = pa.schema([("word", pa.string()), ("length", pa.int32()), ("last_n", pa.int64()), ("last_gram", pa.string()), ("place", pa.int32()), ("pivot", pa.bool_())])


def _mark_pivots(batches):
    """Rows (word, length, three, prefix; arrays of struct<n, gram, place> in rank order) to one row a bigram of the prefix, pivots marked."""
    for batch in batches:
        three, prefix = batch.column("three").flatten(), batch.column("prefix")
        costs, places, grams = (three.field(c).to_pylist() for c in ("n", "place", "gram"))
        counts = np.diff(prefix.offsets.to_numpy())
        inner = prefix.flatten().field("place").to_numpy(zero_copy_only=False)
        pivots = []
        for k in range(batch.num_rows):
            order = sorted(range(3 * k, 3 * k + 3), key=places.__getitem__)
            pivots.append([places[order[i]] for i in best_pivots([places[i] for i in order], [costs[i] for i in order])])
        pair = np.repeat(np.array(pivots, np.int64).reshape(-1, 2), counts, axis=0)
        at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        yield pa.RecordBatch.from_arrays([
            batch.column("word").take(at), batch.column("length").take(at), pa.array(costs[2::3], pa.int64()).take(at), pa.array(grams[2::3], pa.string()).take(at),
            pa.array(inner, pa.int32()), pa.array((inner == pair[:, 0]) | (inner == pair[:, 1]))], schema=_GRAMS)


def prefix_grams(counts: DataFrame) -> DataFrame:
    """(word, length, last_n, last_gram, place, pivot): the prefix bigrams of every word by their place, and which of them are its two pivots.

    The rank of a bigram is the number of its places in all words, then the bigram;
    `last_n` and `last_gram` are the third one's. Further places of bigrams up to
    that rank belong to the prefix, so that repeated bigrams have no tie to break.
    """
    signs = F.split("word", "")
    two = F.transform(F.slice(F.col("signs"), 1, F.size("signs") - 1), lambda x, i: F.concat(x, F.get("signs", i + 1)))
    grams = counts.select("word", signs.alias("signs")).select("word", F.posexplode(two).alias("place", "gram"))
    n_words = cut(grams.groupBy("gram").agg(F.count("*").alias("n")))
    ranked = grams.join(n_words, "gram").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "place"))).alias("ranked"))
    three = ranked.select("word", (F.size("ranked") + 1).cast("int").alias("length"), F.slice("ranked", 1, 3).alias("three"), "ranked")
    last = F.struct(F.col("three")[2]["n"], F.col("three")[2]["gram"])
    prefix = F.filter("ranked", lambda g: F.struct(g["n"], g["gram"]) <= last)
    return three.select("word", "length", "three", prefix.alias("prefix")).mapInArrow(
        _mark_pivots, "word string, length int, last_n long, last_gram string, place int, pivot boolean")


def near_words(counts: DataFrame) -> DataFrame:
    """(word, other): all pairs of words that differ by one inserted, deleted or replaced code point, in both directions.

    Words need at least four code points. The bigram that both words hold splits them:
    the one edit lies before or behind it, and all on the other side is equal. So
    pivots meet the prefixes of other words by length and by the text up to the
    bigram's end, which fixes its place, or by the text from its start, which moves
    it by as much as the lengths differ.
    """
    grams = cut(prefix_grams(counts))
    start, end = F.substr("word", F.lit(1), F.col("place") + 2), F.substr("word", F.col("place") + 1)

    def keyed(rows: DataFrame, length: Column) -> DataFrame:
        key = F.explode(F.array(F.xxhash64(F.lit("start"), length, start), F.xxhash64(F.lit("end"), length, end))).alias("key")
        return rows.select("word", "last_n", "last_gram", key)

    held = keyed(grams, F.col("length"))
    moved = grams.where("pivot").withColumn("other_length", F.explode(F.array(*[F.col("length") + d for d in (-1, 0, 1)])))
    pivots = keyed(moved, F.col("other_length")).select(F.col("word").alias("other"), F.struct("last_n", "last_gram").alias("other_last"), "key")
    # exploded rows: Spark takes them for as few as their table has and would broadcast them, so the way of the join is named
    met = held.join(pivots.hint("merge"), "key").where("struct(last_n, last_gram) >= other_last AND word <> other")
    near = met.where(F.levenshtein("word", "other", 1) == 1).select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct()
    return near.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")),
                                         F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*")


def spelling_forms(counts: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the commoner spelling of each word of counts (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point
    order), if that n is at least `factor` (over 1) times its own; else form and
    form_n are null. root follows forms to the last; it is the word itself where
    there is none. n_near counts near words.

    Words are taken as they stand and must be different; null words, and those under
    four code points, are left out. An empty table gives none. Very long words are
    taken whole. Further columns are dropped.
    """
    own = cut(counts.where(F.length("word") >= 4).select("word", "n"))
    # words are far larger in memory than in their files, which Spark would go by to broadcast them
    pairs = near_words(own).join(own.select(F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), "other")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    judged = own.join(best.hint("merge"), "word", "left").withColumn("form_n", -F.col("best.less"))
    commoner = F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False))
    judged = cut(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(commoner, F.col("best.other")).alias("form"), F.when(commoner, F.col("form_n")).alias("form_n")))
    step = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # n grows by the factor with every step, so a chain of 27 forms needs more words than a long can count; five doublings reach 32.
    jumps = int(np.ceil(np.log2(np.log(2.0**63) / np.log(factor)))) if factor > 1 else 0
    for _ in range(jumps):
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = step.join(ahead.hint("merge"), "root", "left")
        step = cut(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            break
        step = step.select("word", "root")
    roots = step.select("word", "root")
    return judged.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
