"""Collocations against counters over lists of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from muster.llm import phrases as P


def brute(rows, least=30, top=2000):
    out, counts, totals = set(), {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    for lang, c in counts.items():
        found = {p: n for p, n in c.items() if len(p) > 1 and n >= least}
        inside = {}
        for p, n in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside.get(p[i : i + k], 0), n)
        rows = []
        for p, a in found.items():
            if 100 * inside.get(p, 0) < 80 * a:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return out


def corpus(seed=4):
    rnd = random.Random(seed)
    words = ["the", "Old", "mill", "by", "river", "bank", "été", "x-y", "a b"] + [f"w{i}" for i in range(30)]
    rows = [(None, None), ("en", ""), ("en", ".,;"), ("und", "plain words"), ("de", "\tder  Fluss hier\x0bund dort\r")] * 2
    for _ in range(400):
        text = []
        for _ in range(rnd.randrange(1, 12)):
            text += rnd.choice([["the", "old", "mill"], ["by", "the", "river", "bank"], rnd.choices(words, k=3), ["Old mill. By"], ["one one one one"]])
        rows.append((rnd.choice(["en", "en", "de", None]), " ".join(text) + rnd.choice([".", "!", "\n", ""])))
    return rows


@pytest.mark.parametrize("words,phrases,bits", [(P.HEAD_WORDS, P.HEAD_PHRASES, P.DENSE), (6, 1000, 4), (1000, 5, 4), (0, 0, 4)])
def test_rows_are_those_of_plain_counters(spark, monkeypatch, words, phrases, bits):
    """Also with bounds that leave most words or phrases without a number, and tiles that are dense at once."""
    monkeypatch.setattr(P, "HEAD_WORDS", words)
    monkeypatch.setattr(P, "HEAD_PHRASES", phrases)
    rows = corpus()
    df = spark.createDataFrame([(g, t, 1, "x") for g, t in rows], "lang string, text string, c long, word string")
    want = brute(rows)
    assert {tuple(r) for r in P.collocations(df).collect()} == want and len(want) > 20


def test_tiles_count_as_unique_does(monkeypatch):
    rng = np.random.default_rng(1)
    left, last = rng.zipf(1.3, 20_000) % 3000, rng.zipf(1.2, 20_000) % 3000
    for dense in (1, 500, 10**9):
        monkeypatch.setattr(P, "DENSE", dense)
        a, b, c = P.tile_counts(left.astype(np.int64), last.astype(np.int64))
        assert {(x, y): n for x, y, n in zip(a.tolist(), b.tolist(), c.tolist())} == Counter(zip(left.tolist(), last.tolist())) and len(a) == len(set(zip(a.tolist(), b.tolist())))


def test_no_phrases(spark):
    df = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert P.collocations(df).count() == 0 and P.collocations(df.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    out = spark.sql(f"SELECT (cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) AS s FROM VALUES ({10**18}L, {10**18 + 1}L, {2 * 10**18}L) AS t(a, l, r)")
    assert out.first()["s"] == 2_000_000 * 10**18 // (3 * 10**18 + 1)
