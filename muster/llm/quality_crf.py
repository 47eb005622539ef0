"""Quality rules with line labelling: a linear-chain conditional random field marks content and boilerplate.

Lines are labelled by Viterbi decoding; a document is kept if enough of its words lie in content lines and the base
rules pass. The field is trained here, on a bounded sample of documents with a quality label. All lines of a good document
are content. Which lines of a poor one are boilerplate is not given, only that one at least is: hard expectation
maximisation decodes them with the field so far and trains the field on what it decoded, by maximum likelihood with
forward-backward sums. So the field learns where documents change from content to boilerplate and back.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.runtime import arrow_batches

FIT_DOCS = 3_000  # labelled documents that the field is trained on, least id hash first
FIT_LINES = 100  # consecutive lines of each that it is trained on; a longer document's run is placed by its text's checksum
CONTENT_SHARE = 0.5  # of the words, where nothing else was learnt
ROUNDS = 4  # of decoding the poor documents and training on that
STEPS = 60  # of ascent a round
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
N_FEATURES = 10


def line_features(line: str, words: list[str], seen: bool) -> list[float]:
    n, size = len(words), max(1, len(line))
    symbols = sum(map(line.count, "#*$%&|<>!_=~{}"))
    letters = sum(map(len, words)) or 1
    upper = 0.0 if line == line.lower() else sum(map(str.isupper, line)) / letters
    return [
        1.0,
        min(1.0, math.log1p(n) / 5.0),
        min(1.0, 8.0 * symbols / size),
        upper,
        0.0 if line.isalpha() else sum(map(str.isdigit, line)) / letters,
        1.0 - len(set(words)) / n,
        1.0 if seen else 0.0,
        1.0 if words[-1][-1] in ".?!\"'" else 0.0,
        1.0 if n < 3 else 0.0,
        min(1.0, letters / n / 20.0),
    ]


@dataclass
class LineField:
    """Weights of the content state against the boilerplate state, of moves between lines (from, to), and the share of
    words in content lines that keeps a document."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    share: float = CONTENT_SHARE

    def decode(self, features: list[list[float]]) -> list[int]:
        """The most likely labels; ties go to content."""
        if not features:
            return []
        gain = (np.asarray(features) @ self.weights).tolist()
        (a, b), (c, d) = self.moves.tolist()
        low, high, back = 0.0, gain[0], []
        for g in gain[1:]:
            from_low, from_high = (0 if low + a > high + c else 1), (0 if low + b > high + d else 1)
            back.append((from_low, from_high))
            low, high = max(low + a, high + c), max(low + b, high + d) + g
        label = int(high >= low)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _ascend(x: np.ndarray, live: np.ndarray, labels: np.ndarray, each: np.ndarray, theta: np.ndarray, steps: int, chain: bool, rate: float = 0.15, ridge: float = 1e-3) -> np.ndarray:
    """Gradient ascent (Adam) on the likelihood of the line labels, over padded documents at once; without ``chain`` the moves
    stay as they are."""
    n, longest = live.shape
    both = live[:, 1:] & live[:, :-1]
    true_moves = np.zeros((n, 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            true_moves[:, i, j] = (both & (labels[:, :-1] == i) & (labels[:, 1:] == j)).sum(1)
    m, v = 0.0, 0.0
    for step in range(1, steps + 1):
        w, moves = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        gain = x @ w
        if chain:
            node = np.stack([np.zeros((n, longest)), gain], axis=2)
            alpha = np.empty((n, longest, 2))
            alpha[:, 0] = node[:, 0]
            for t in range(1, longest):
                nxt = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + node[:, t]
                alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            beta = np.zeros((n, longest, 2))
            for t in range(longest - 2, -1, -1):
                ahead = node[:, t + 1] + beta[:, t + 1]
                prev = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
                beta[:, t] = np.where(live[:, t + 1, None], prev, 0.0)
            p1 = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0.0))
            joint = alpha[:, :-1, :, None] + moves + (node + beta)[:, 1:, None, :] - z[:, None, None, None]
            expected = (np.exp(np.minimum(joint, 0.0)) * both[:, :, None, None]).sum(1)
            grad_m = np.einsum("n,nij->ij", each, true_moves - expected)
        else:
            p1, grad_m = 1 / (1 + np.exp(-np.clip(gain, -60, 60))), np.zeros((2, 2))
        grad_w = np.einsum("n,ntf,nt->f", each, x, (labels - p1) * live)
        grad = np.concatenate([grad_w, grad_m.ravel()]) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta


def _poor_labels(model: LineField, features: list[list[float]]) -> list[int]:
    """Decoded labels of a poor document: its least likely content line is boilerplate at the least."""
    labels = model.decode(features)
    if all(labels):
        labels[int(np.argmin(np.asarray(features) @ model.weights))] = 0
    return labels


def train(documents: list[tuple[list[list[float]], int]], words: list[list[int]] | None = None) -> LineField:
    """The field from ``(line features, quality)`` of documents; ``words`` has the word counts of their lines.

    The first weights take a document's label for all its lines and no neighbours; both classes count the same in all, and a
    line of a long document less.
    """
    words = words or [[1] * len(f) for f, _ in documents]
    kept = [(f, y, c) for (f, y), c in zip(documents, words) if f]
    if len({y for _, y, _ in kept}) < 2:
        return LineField(weights=np.eye(N_FEATURES)[0])
    longest, n = max(len(f) for f, _, _ in kept), len(kept)
    x, live, labels = np.zeros((n, longest, N_FEATURES)), np.zeros((n, longest), bool), np.zeros((n, longest), int)
    y = np.array([label for _, label, _ in kept])
    for i, (f, label, _) in enumerate(kept):
        x[i, : len(f)], live[i, : len(f)], labels[i, : len(f)] = f, True, label
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / live.sum(1)
    theta = _ascend(x, live, labels, each, np.zeros(N_FEATURES + 4), 2 * STEPS, chain=False)
    field_of = lambda t: LineField(t[:N_FEATURES], t[N_FEATURES:].reshape(2, 2))
    for _ in range(ROUNDS):
        before = labels.copy()
        for i, (f, label, _) in enumerate(kept):
            if not label:
                labels[i, : len(f)] = _poor_labels(field_of(theta), f)
        theta = _ascend(x, live, labels, each, theta, STEPS, chain=True)
        if (before == labels).all():
            break
    model = field_of(theta)
    shares = np.array([sum(c for c, s in zip(counts, model.decode(f)) if s) / max(1, sum(counts)) for f, _, counts in kept])
    # the share nearest the default of those that tell the classes apart best, or nearly so; midway between two that occur
    marks = np.unique(np.concatenate([[0.0, 1.0], shares]))
    cuts = (marks[1:] + marks[:-1]) / 2
    right = [((shares >= c) & (y == 1)).sum() / (y == 1).sum() + ((shares < c) & (y == 0)).sum() / (y == 0).sum() for c in cuts]
    best = np.nonzero(np.array(right) >= max(right) - 0.005)[0]
    model.share = float(cuts[best[np.argmin(np.abs(cuts[best] - CONTENT_SHARE))]])
    return model


def text_lines(text: str) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines with a word, and the number of lines equal to an earlier one."""
    seen: set[str] = set()
    features, counts, repeats = [], [], 0
    for line in text.split("\n"):
        words = [w.decode() for w in line.encode().split()]  # ASCII white space only
        if not words:
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        features.append(line_features(line, words, again))
        counts.append(len(words))
    return features, counts, repeats


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first included."""
    if len(words) <= width:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    windows = [joined[s:e] for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    mark = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if counts[w] > 1:
            mark[i] += 1
            mark[i + width] -= 1
    return int((np.cumsum(mark)[:-1] > 0).sum())


def judge(text: str, model: LineField) -> tuple:
    words = text.encode().split()
    n = len(words)
    features, counts, repeats = text_lines(text)
    labels = model.decode(features)
    content = sum(c for c, y in zip(counts, labels) if y)
    again = repeated_words(words)
    failed = n < 10 or 100 * again > 20 * n
    share = content / n if n else 0.0
    chars = len(text) - sum(map(text.count, BLANKS))
    return n, chars, sum(map(text.count, SYMBOLS)), repeats, again, share, failed, not failed and share >= model.share


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, "
    "base_failed boolean, kept boolean"
)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> LineField:
    """Train on at most ``fit_docs`` rows of ``labels(doc_id, quality)``, the bounded sample of a fitted model.

    Null texts are empty ones; null ids and labels teach nothing; of rows that repeat an id one text is taken; without both
    labels every line is content.
    """
    arrow_batches(docs.sparkSession)
    picked = (
        labels.where("doc_id is not null and quality is not null")
        .select("doc_id", F.col("quality").cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "doc_id").limit(fit_docs)
    )

    @F.pandas_udf("array<array<double>>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                found, counts, _ = text_lines(t)
                at = zlib.crc32(t.encode()) % max(1, len(found) - FIT_LINES + 1)
                out.append([[*f, float(c)] for f, c in zip(found[at : at + FIT_LINES], counts[at : at + FIT_LINES])])
            yield pd.Series(out, dtype=object)

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "h", "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    # rows that repeat an id count once, or the sample would have no bound
    once = rows.groupBy("doc_id", "y", "h").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    sample = once.select("y", "h", "doc_id", features("t").alias("f"))
    rows = sorted(sample.collect(), key=lambda r: (r["h"], r["doc_id"]))
    return train([([list(x)[:-1] for x in r["f"]], r["y"]) for r in rows], [[int(x[-1]) for x in r["f"]] for r in rows])


def quality_column(text: Column, model: LineField, spark) -> Column:
    """Struct of the base counts, ``content_share``, ``base_failed`` and ``kept``. A null text is an empty one, and
    fails as it has too few words."""
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for texts in batches:
            yield pd.DataFrame([judge(t, shared.value) for t in texts], columns=names)

    return judged(F.coalesce(text, F.lit("")))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", quality_column(F.col("text"), model, spark).alias("q")).select("doc_id", "q.*")
