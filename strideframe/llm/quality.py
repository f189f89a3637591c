"""Quality of place notes: text evidence with hierarchical empirical Bayes over source and type.

Records: facilities (facility_id, name, source, type, any further columns) and
verdicts (facility_id, good 0/1). A null name counts as empty, a null source or
type is a group of its own.

1. A logistic model on text features is fitted on a bounded sample of verdicts.
2. Its probabilities are summed over all facilities by (source, type). The rate of a
   source is shrunk toward the global rate and that of a type toward its source, by
   strengths estimated from the spread of the groups (method of moments).
3. A facility's log-odds are its own evidence plus what its group's rate adds over
   the global one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.tables import set_aside
from strideframe.session import cut

SAMPLE = 20_000
BROADCAST_GROUPS = 100_000
KEEP = 0.5
FEATURES = ("symbols", "marks", "capitals", "digits", "same_next", "word_repeats", "line_repeats", "word_length", "length")
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
CAPITALS, DIGITS, SPACE = bytes(range(65, 91)), b"0123456789", b" \t\n\r\x0b\x0c"
PUNCTUATION = b".,;:'\"()?-"


def text_features(name: str | None) -> list[float]:
    """Shares of odd characters, capitals and repeats of one text."""
    b = (name or "").encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    words = b.split()
    m = max(1, len(words))
    lines = b.split(b"\n")
    letters = len(b) - len(b.translate(None, LETTERS))
    plain = len(b.translate(None, LETTERS + DIGITS + SPACE + PUNCTUATION))
    return [plain / n, b.count(b"!") / m, (len(b) - len(b.translate(None, CAPITALS))) / max(1, letters), (len(b) - len(b.translate(None, DIGITS))) / n,
            sum(map(eq, words, words[1:])) / m, 1 - len(set(words)) / m, 1 - len(set(lines)) / len(lines), min(len(b) / m, 40) / 10, math.log1p(m) / 10]


def fit(features: np.ndarray, good: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> dict:
    """Logistic regression on standardised features by damped Newton steps. Without both verdicts it tells nothing."""
    if not len(good) or good.min() == good.max():
        k = len(FEATURES)
        return {"mean": [0.0] * k, "scale": [1.0] * k, "weight": [0.0] * k, "bias": 0.0 if not len(good) else 4.0 * (2 * float(good[0]) - 1), "blind": True}
    mean, scale = features.mean(0), features.std(0)
    scale[scale < 1e-9] = 1.0
    x = np.c_[np.clip((features - mean) / scale, -8, 8), np.ones(len(good))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (good - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weight": w[:-1].tolist(), "bias": float(w[-1]), "blind": False}


def evidence(facilities: DataFrame, model: dict | None) -> DataFrame:
    """(facility_id, source, type, evidence): the model's log-odds; without a model `features` instead."""
    kind = "features array<double>" if model is None else "evidence double"
    if model is not None:
        mean, scale, weight = (np.array(model[k]) for k in ("mean", "scale", "weight"))
        bias = model["bias"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([text_features(t) for t in b.column("name").to_pylist()], float).reshape(-1, len(FEATURES))
            last = pa.array(f.tolist(), pa.list_(pa.float64())) if model is None else pa.array(np.clip((f - mean) / scale, -8, 8) @ weight + bias)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in b.schema.names if c != "name"] + [last],
                                             names=[c for c in b.schema.names if c != "name"] + [kind.split()[0]])

    rest = facilities.drop("name")
    fields = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)
    return facilities.select(*rest.columns, "name").mapInArrow(run, f"{fields}, {kind}")


def learn(facilities: DataFrame, verdicts: DataFrame, sample: int = SAMPLE) -> dict:
    """The text model, fitted on at most `sample` verdicts, those whose ids hash lowest.

    An id with several verdicts counts once, as good if most are. Null verdicts do not count.
    """
    judged = verdicts.where("facility_id IS NOT NULL AND good IS NOT NULL").groupBy("facility_id").agg(F.avg(F.col("good").cast("double")).alias("good"))
    some = judged.orderBy(F.xxhash64("facility_id"), "facility_id").limit(sample)
    rows = evidence(facilities.select("facility_id", "name").join(F.broadcast(some), "facility_id"), None)
    got = rows.groupBy("facility_id").agg(F.min("good").alias("good"), F.min("features").alias("features")).orderBy("facility_id").collect()
    return fit(np.array([r["features"] for r in got], float).reshape(-1, len(FEATURES)), np.array([float(r["good"] >= 0.5) for r in got]))


def _strength(groups: DataFrame, rate: str) -> float:
    """How many facilities a prior is worth: from the spread of group rates around `rate` beyond chance."""
    p = F.col("total") / F.col("n")
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"),
                   F.sum(F.col("n") * (p - F.col(rate)) ** 2).alias("spread"), F.sum(F.col("n") * F.col(rate) * (1 - F.col(rate))).alias("chance")).first()
    if not r["n"] or r["k"] < 2 or r["chance"] <= 0:
        return 1e6
    within = r["chance"] / r["n"]
    between = (r["spread"] - (r["k"] - 1) * within) / max(1e-9, r["n"] - r["nn"] / r["n"])
    return 1e6 if between <= 0 else float(min(1e6, max(1.0, within / between - 1)))


def judge_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """((judge_source, judge_type, judge_rate), global rate) from rows (source, type, evidence)."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    types = cut(scored.groupBy(F.coalesce("source", F.lit("")).alias("judge_source"), F.coalesce("type", F.lit("")).alias("judge_type")).agg(
        F.count("*").alias("n"), F.sum(p).alias("total")))
    whole = types.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    rate = (whole["total"] or 0.0) / whole["n"] if whole["n"] else 0.5
    rate = min(1 - 1e-4, max(1e-4, rate))
    sources = types.groupBy("judge_source").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("rate", F.lit(rate))
    k = _strength(sources, "rate")
    sources = sources.select("judge_source", ((F.lit(k * rate) + F.col("total")) / (F.lit(k) + F.col("n"))).alias("source_rate"))
    types = types.join(sources, "judge_source")
    k = _strength(types, "source_rate")
    return cut(types.select("judge_source", "judge_type", ((F.lit(k) * F.col("source_rate") + F.col("total")) / (F.lit(k) + F.col("n"))).alias("judge_rate"))), rate


def quality_scores(scored: DataFrame) -> DataFrame:
    """rows (source, type, evidence, ...) with judge_rate and quality, the posterior probability of being good.

    The group table is broadcast only if it has at most BROADCAST_GROUPS rows; a larger
    one is joined by shuffle, where adaptive execution splits a hot source.
    """
    rates, rate = judge_rates(scored)
    side = F.broadcast(rates) if rates.count() <= BROADCAST_GROUPS else rates
    keyed = scored.withColumns({"judge_source": F.coalesce("source", F.lit("")), "judge_type": F.coalesce("type", F.lit(""))})
    odds = F.col("evidence") + F.log(F.col("judge_rate") / (1 - F.col("judge_rate"))) - F.lit(math.log(rate / (1 - rate)))
    return keyed.join(side, ["judge_source", "judge_type"]).drop("judge_source", "judge_type").withColumn("quality", 1 / (1 + F.exp(-odds)))


def judge(facilities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(facility_id, source, type, evidence, judge_rate, quality) for every row of `facilities`.

    An empty table gives no rows; without verdicts of both kinds the evidence is the
    same for all and nothing is told apart.
    """
    rows = facilities.select("facility_id", "name", "source", "type")
    return quality_scores(cut(evidence(rows, learn(rows, verdicts))))


def keep_good(facilities: DataFrame, verdicts: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of `facilities`, all columns, whose quality is `least` or more; without verdicts of both kinds all rows.

    Null names count as empty; an empty table gives none; repeated rows are judged
    alike. Columns may have any further names.
    """
    facilities, back = set_aside(facilities, "judge_source", "judge_type", "judge_rate")
    model = learn(facilities, verdicts)
    if model["blind"]:
        return back(facilities)
    rates, rate = judge_rates(evidence(facilities.select("facility_id", "name", "source", "type"), model))
    side = F.broadcast(rates) if rates.count() <= BROADCAST_GROUPS else rates
    mean, scale, weight, bias = np.array(model["mean"]), np.array(model["scale"]), np.array(model["weight"]), model["bias"]
    names = facilities.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([text_features(t) for t in b.column("name").to_pylist()], float).reshape(-1, len(FEATURES))
            site = b.column("judge_rate").to_numpy()
            odds = np.clip((f - mean) / scale, -8, 8) @ weight + bias + np.log(site / (1 - site)) - math.log(rate / (1 - rate))
            yield b.select(names).filter(pa.array(1 / (1 + np.exp(-odds)) >= least))

    keyed = facilities.withColumns({"judge_source": F.coalesce("source", F.lit("")), "judge_type": F.coalesce("type", F.lit(""))})
    kept = keyed.join(side, ["judge_source", "judge_type"]).select(*names, "judge_rate").mapInArrow(run, facilities.schema)
    return back(kept)
