"""Toxic passages by maximum-scoring segments over token log-odds.

Token scores are log-odds under hierarchical Dirichlet priors: the prior of a word is its five-letter beginning,
whose prior is its four-letter beginning, whose prior is the corpus. All maximal scoring segments of a text are
found in linear time (Ruzzo and Tompa, 1999). Segment scores are put on the extreme-value scale of Karlin and
Altschul, with parameters from clean documents; the significant ones are summed and calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.runtime import arrow_batches

FIT_DOCS = 12_000  # labelled rows that are fitted on, least id hash first
TABLE_ENTRIES = 20_000  # scores kept for each of words, five- and four-letter beginnings
CACHE_ENTRIES = 200_000
DRIFT = 0.8  # taken off each token's score: neutral text must score below zero
PRIOR = 4.0  # tokens that a prior counts for
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    five: dict[str, float] = field(default_factory=dict)
    four: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = -2.0

    def token_score(self, word: str) -> float:
        s = self.words.get(word)
        if s is None:
            s = self.five.get(word[:5])
        if s is None:
            s = self.four.get(word[:4], 0.0)
        return s - DRIFT


class _Scores(dict):
    """A bounded worker cache of token scores."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        s = self[word] = self.model.token_score(word)
        return s


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, end exclusive, in order: one pass over the positives."""
    total = np.cumsum(scores)
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    for i in np.nonzero(scores > 0)[0].tolist():
        start, end, left, right = i, i + 1, float(total[i] - scores[i]), float(total[i])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r in stack]


def evidence(segments: list[tuple[int, int, float]], n: int, lam: float, k: float) -> float:
    """Minus the log of the summed segments' p-value: the best number of top segments, each one more costing ln 2."""
    xs = sorted((lam * s - math.log(max(k * n, 1e-9)) for _, _, s in segments), reverse=True)
    best = total = 0.0
    for r, x in enumerate(xs, 1):
        if x <= 0:
            break
        total += x
        if r == 1:
            z = -math.log(-math.expm1(-math.exp(-total))) if total < 30 else total
        else:
            z = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
        best = max(best, z)
    return best


def score_text(text: str, model: ToxicityModel, scores: _Scores) -> tuple[float, list[tuple[int, int, float]], int]:
    words = WORD.findall(text.lower())
    if not words:
        return 0.0, [], 0
    values = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    segments = maximal_segments(values)
    return evidence(segments, len(words), model.lam, model.k), segments, len(words)


def probability(z: float, model: ToxicityModel) -> float:
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, model.offset + model.slope * math.log1p(z)))))


def _token_tables(sample: DataFrame) -> tuple[dict, dict, dict]:
    """Log-odds tables from ``sample(text, toxic)``; only rows far from their prior are kept, ``TABLE_ENTRIES`` each."""
    tokens = sample.select("toxic", F.explode(F.split(F.lower("text"), r"(?U)\W+")).alias("w")).where("w <> ''")
    counts = tokens.groupBy("w").agg(F.sum("toxic").cast("double").alias("y1"), F.count("*").cast("double").alias("y"))
    counts = counts.where("y1 is not null").withColumn("p5", F.substring("w", 1, 5)).withColumn("p4", F.substring("w", 1, 4))
    counts = counts.persist()
    try:
        total = counts.agg(F.sum("y1"), F.sum("y")).first()
        base = (total[0] or 0.0) / total[1] if total[1] else 0.0
        if not 0 < base < 1:
            return {}, {}, {}
        prior = math.log(base / (1 - base))
        rate = lambda parent: (F.col("y1") + PRIOR * parent) / (F.col("y") + PRIOR)
        odds = F.log(F.col("r") / (1 - F.col("r"))) - prior
        sums = (F.sum("y1").alias("y1"), F.sum("y").alias("y"))
        four = counts.groupBy("p4").agg(*sums).withColumn("r", rate(F.lit(base))).select("p4", "r")
        five = counts.groupBy("p4", "p5").agg(*sums).join(four.withColumnRenamed("r", "up"), "p4")
        five = five.withColumn("r", rate(F.col("up"))).select("p5", "r", "up")
        word = counts.join(five.select("p5", F.col("r").alias("up")), "p5").withColumn("r", rate(F.col("up")))

        def kept(df: DataFrame, key: str) -> dict[str, float]:
            far = df.select(F.col(key).alias("k"), odds.alias("s")).orderBy(F.desc(F.abs("s")), "k")
            return {r["k"]: r["s"] for r in far.limit(TABLE_ENTRIES).collect()}

        return kept(word, "w"), kept(five, "p5"), kept(four, "p4")
    finally:
        counts.unpersist()


def karlin_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1 for the background's token scores."""
    p = weights / weights.sum()
    if not (values > 0).any() or (p * values).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while (p * np.exp(np.minimum(hi * values, 700))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (lo, mid)
    return hi


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, both already limited to rows that may be seen.

    Null texts are empty ones; null ids and labels teach nothing; of rows that repeat an id one text is taken.
    At most ``fit_docs`` labelled rows are used (the bounded sample of a classifier): two thirds give the token
    tables, one third the extreme-value and the final calibration.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    picked = (
        labels.where("doc_id is not null and toxic is not null")
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "doc_id")
        .limit(fit_docs)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", "h")
    # rows that repeat an id count once, or the sample would have no bound
    sample = rows.groupBy("doc_id", "toxic", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    part = F.pmod(F.col("h"), F.lit(3))
    model = ToxicityModel(*_token_tables(sample.where(part < 2)))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("n long, top double, low array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _Scores(shared.value)
        for texts in batches:
            rows = []
            for t in texts:
                _, segments, n = score_text(t, shared.value, own)
                values = np.array([own[w] for w in WORD.findall(t.lower())])
                cells = np.histogram(values, 40, (-8.0, 8.0))[0] if n else np.zeros(40)
                rows.append((n, max((s for _, _, s in segments), default=0.0), cells.astype(float).tolist()))
            yield pd.DataFrame(rows, columns=["n", "top", "low"])

    held = sample.where(part == 2).select("toxic", measured("text").alias("m")).select("toxic", "m.*").collect()
    clean = [r for r in held if not r["toxic"] and r["n"]]
    if not clean or len(clean) == len(held):
        return model
    grid = (np.arange(40) + 0.5) * 0.4 - 8.0
    model.lam = karlin_lambda(grid, np.sum([r["low"] for r in clean], axis=0) + 1e-3)
    # K: the median of the clean maxima on the extreme-value scale
    model.k = float(np.median([math.exp(min(50, model.lam * r["top"])) / r["n"] for r in clean])) * math.log(2)
    scaled = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _Scores(scaled.value)
        for texts in batches:
            yield pd.Series([score_text(t, scaled.value, own)[0] for t in texts], dtype="float64")

    found = sample.where(part == 2).select("toxic", summed("text").alias("z")).collect()
    model.offset, model.slope = _logistic(np.log1p([r["z"] for r in found]), np.array([float(r["toxic"]) for r in found]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for a one-variable logistic regression with a weak prior on the slope."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - np.array([0.01, 0.01]) * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([0.01, 0.01])
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 1e-3))


def toxicity_column(text: Column, model: ToxicityModel, spark) -> Column:
    """Struct ``(score, predicted, passages)``: passages are the significant segments by character, end exclusive.

    Null, empty and wordless texts score as a text without evidence.
    """
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, predicted int, passages array<struct<start:int,end:int,score:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, m = _Scores(shared.value), shared.value
        for texts in batches:
            rows = []
            for t in texts:
                z, segments, n = score_text(t, m, own)
                p = probability(z, m)
                found = [s for s in segments if m.lam * s[2] > math.log(max(m.k * n, 1e-9))]
                if found:
                    spots = [x.span() for x in WORD.finditer(t.lower())]
                    found = [{"start": spots[a][0], "end": spots[b - 1][1], "score": s} for a, b, s in found]
                rows.append((p, int(p >= THRESHOLD), found))
            yield pd.DataFrame(rows, columns=["score", "predicted", "passages"])

    return scored(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = fit(docs, labels)
    out = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_column(F.col("text"), model, spark).alias("t")
    )
    return out.select("doc_id", "held_out", "t.score", "t.predicted", F.size("t.passages").alias("n_passages"))
