"""Context-tree weighting against a version with dictionaries, one text and one bit at a time."""

import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from muster.llm import lm_ctw as L

TEXTS = ["Abc abd abc", None, "the cat sat. The cat sat on", "", "zz ä ö the", "abc abd", "the cat", "the cat"]
LEARN = [1, 1, 1, 1, 0, 1, 0, None]


def brute(texts, learn):
    counts = defaultdict(lambda: [0, 0])
    for t, use in zip(texts, learn):
        padded = b"\xfe" * 5 + L.fold(t or "") + b"\xff"
        for i in range(5, len(padded) if use else 0):
            for depth in range(6):
                for k in range(8):
                    counts[padded[i - depth : i], k, padded[i] >> (8 - k)][(padded[i] >> (7 - k)) & 1] += 1
    longer = defaultdict(set)
    for context, k, node in list(counts):
        if context:
            longer[context[1:], k, node].add(context)
    estimate = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    @lru_cache(None)
    def weighted(context, k, node):
        own = estimate(*counts[context, k, node])
        if len(context) == 5:
            return own
        below = sum(weighted(c, k, node) for c in longer[context, k, node])
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)

    def chance(padded, i, k, depth):
        node, bit, context = padded[i] >> (8 - k), (padded[i] >> (7 - k)) & 1, padded[i - depth : i]
        if (context, k, node) not in counts:
            return 0.5
        n = counts[context, k, node]
        kt = (n[bit] + 0.5) / (sum(n) + 1)
        if depth == 5:
            return kt
        odds = math.exp(estimate(*n) - sum(weighted(c, k, node) for c in longer[context, k, node]))
        return (odds * kt + chance(padded, i, k, depth + 1)) / (odds + 1)

    words = Counter(w for t, use in zip(texts, learn) if use for w in [*L.fold(t or "").split(), b""])
    total = sum(words.values()) + len(words) + 1
    out = []
    for t in texts:
        padded, tokens = b"\xfe" * 5 + L.fold(t or "") + b"\xff", [*L.fold(t or "").split(), b""]
        score = sum(math.log10(chance(padded, i, k, 0)) for i in range(5, len(padded)) for k in range(8))
        out.append((len(tokens), sum(words[w] > 0 for w in tokens), sum(words.values()), sum(math.log10((words[w] + 1) / total) for w in tokens), score))
    return out


@pytest.mark.parametrize("strings,words", [(L.HEAD_STRINGS, L.HEAD_WORDS), (5, 2), (0, 0)])
def test_scores_are_those_of_the_plain_version(spark, monkeypatch, strings, words):
    """Also where the commonest strings and words sent to the tasks are few, so that most are joined."""
    monkeypatch.setattr(L, "HEAD_STRINGS", strings)
    monkeypatch.setattr(L, "HEAD_WORDS", words)
    df = spark.createDataFrame(list(zip(range(8), TEXTS, LEARN)), "doc_id int, text string, l int").withColumn("__id", F.lit("x")).withColumn("code", F.lit(1))
    got = sorted(L.score_texts(df.drop("__id"), F.col("l") == 1).select("doc_id", "code", "__lm.*").collect())
    for row, want in zip(got, brute(TEXTS, LEARN), strict=True):
        assert tuple(row)[2:5] == want[:3]
        assert row["base_score"] == pytest.approx(want[3], abs=1e-9) and row["score"] == pytest.approx(want[4], abs=1e-9)


def test_chances_of_all_bytes_sum_to_one():
    codes = [c for c, _ in L.string_codes([L.fold(t or "") for t in TEXTS])][0]
    import numpy as np

    found, n = np.unique(codes, return_counts=True)
    levels = L.subtree(found, n)  # one stem's worth would do; a tree of all is one, too
    nodes = levels[L.TRUNK]
    assert all(len(x.keys) for x in nodes)
    none = L.Trunk([np.zeros(256), np.zeros(65536)], [np.zeros(256), np.zeros(65536)], [np.ones(256), np.ones(65536)])
    context = int(found[7]) & ~255
    total = np.exp(L.log_predictions(np.arange(256) + context, levels, none)).sum()
    assert total == pytest.approx(1.0, abs=1e-9)


def test_counts_beyond_the_table_go_on_smoothly():
    import numpy as np

    a = np.array([0, 5, L.EXACT - 1, L.EXACT, L.EXACT + 1, 10**6])
    want = [math.lgamma(x + 0.5) + math.lgamma(3.5) - 2 * math.lgamma(0.5) - math.lgamma(x + 4) for x in a.tolist()]
    assert np.allclose(L.log_estimate(a, np.full(len(a), 3)), want, rtol=1e-10)


def test_nothing_to_learn_from_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id int, text string")
    rows = sorted(L.score_texts(df, F.lit(False)).select("doc_id", "__lm.*").collect())
    assert [r["bits_per_byte"] for r in rows] == [8.0, 8.0] and [r["n_known"] for r in rows] == [0, 0]
    assert L.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_long_texts_are_cut_into_slices_without_a_trace(monkeypatch):
    import numpy as np

    text = [b"some bytes that repeat " * 40, b"", b"x"]
    whole = list(L.string_codes(text))
    monkeypatch.setattr(L, "SLICE", 64)
    parts = list(L.string_codes(text))
    assert len(parts) > 5
    for i in (0, 1):
        assert np.array_equal(np.concatenate([p[i] for p in parts]), whole[0][i])


def test_the_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    p = L.op11_lm(spark, sf).toPandas()
    assert p.columns.tolist()[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    out = docs["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    assert len(p) == len(docs) and p.set_index("doc_id")["held_out"].sort_index().tolist() == out.set_axis(docs["doc_id"]).sort_index().tolist()
    words = Counter(w for t, o in zip(docs["text"], out) if not o for w in [*L.fold(t).split(), b""])
    assert p["train_tokens"].unique().tolist() == [sum(words.values())]
    base = {i: sum(math.log10((words[w] + 1) / (sum(words.values()) + len(words) + 1)) for w in [*L.fold(t).split(), b""]) for i, t in zip(docs["doc_id"], docs["text"])}
    assert max(abs(base[i] - s) for i, s in zip(p["doc_id"], p["base_score"])) < 1e-6
    assert p[p["held_out"]]["bits_per_byte"].mean() < 4
