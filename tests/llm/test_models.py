"""Learned and counting operators: exactness where there is one, held-out accuracy otherwise."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import decontam, langid, quality_crf, token_counts, toxicity

SF = "/root/testdata/sf0.01"


def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b", "", None, "  \n\n x   y\t\tz ", "it's 'sabc I'LL", "é\x85x \x1c y 日本語 😀 ½²", "don’t — “x” …", "x" * 30_000, "the the the"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    library = Tokenizer.from_file(path())
    got = {r["doc_id"]: r["tokens"] for r in token_counts.count_tokens(docs, path()).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((t or "").encode())
    own = token_counts.Counter(path(), {"the": 1}, bound=2)  # a full cache starts anew
    assert [own.count(t or "") for t in texts] == [got[i]["n_tokens"] for i in range(len(texts))]
    assert token_counts.count_tokens(docs.limit(0), path()).count() == 0


def plain_phrases(sample, text):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_phrases_are_greedy_longest_matches():
    rnd = random.Random(3)
    sample = "".join(rnd.choice("abc ") for _ in range(300))
    model = langid.Automaton(np.frombuffer(sample.encode("utf-32-le"), np.uint32).astype(np.int64))
    texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 200))) for _ in range(40)]
    for t in texts:
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
        assert model.phrases(codes[None, :], np.array([len(codes)]), np.array([False]), 0)[0] == plain_phrases(sample, t)


@pytest.mark.parametrize("block,group,piece", [(4, 3, 7), (16, 8, 64), (256, 4096, 1 << 18)])
def test_a_text_is_parsed_as_one_whatever_the_blocks(monkeypatch, block, group, piece):
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "GROUP", group)
    monkeypatch.setattr(langid, "PIECE", piece)
    rnd = random.Random(5)
    sample = "".join(rnd.choice("aab ") for _ in range(400)) + "\u4e00\u4e01ab"
    model = langid.Automaton(langid.normalise(sample))
    texts = ["", "aaa", "a" * 5000, sample * 3] + ["".join(rnd.choice("aabd \u4e00!") for _ in range(rnd.randrange(1, 900))) for _ in range(30)]
    bits = langid.entropies(texts, [model])[:, 0]
    known = "".join(map(chr, langid.normalise(sample)))
    for t, b in zip(texts, bits):
        folded = "".join(map(chr, langid.normalise(t)))
        if folded:
            assert b == pytest.approx(plain_phrases(known, folded) * model.bits / len(folded))
        else:
            assert np.isinf(b)


def test_memory_follows_the_sample_not_its_alphabet():
    rnd = random.Random(6)
    model = langid.Automaton(langid.normalise("".join(chr(0x4E00 + rnd.randrange(2500)) for _ in range(30_000))))
    assert len(model.alphabet) > 2400
    assert model.owner.nbytes + model.to.nbytes + model.base.nbytes < 4_000_000


def test_languages_with_nulls_repeats_ties_and_clashing_names(spark):
    rows = [("one and the other", "x"), ("one and the other", "y"), (None, "x"), ("und so weiter", None), ("", "x")] * 2
    docs = spark.createDataFrame([(None, t, lang, 1.0) for t, lang in rows], "doc_id long, text string, lang string, score double")
    samples = langid.learn_samples(docs)
    assert set(samples) == {"x", "y"}
    got = docs.select("text", langid.language_column(F.col("text"), samples, spark).alias("p")).collect()
    assert len(got) == 10 and {r["p"]["lang_pred"] for r in got if r["text"]} == {"x"}  # a tie goes to the first name
    none = langid.learn_samples(docs.limit(0))
    assert none == {} and {r["p"]["lang_pred"] for r in docs.select(langid.language_column(F.col("text"), none, spark).alias("p")).collect()} == {"und"}


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    samples = langid.learn_samples(docs.where(~held))
    odd = spark.createDataFrame([(None,), ("",), ("12 !",)], "text string")
    assert {r["p"]["lang_pred"] for r in odd.select(langid.language_column(F.col("text"), samples, spark).alias("p")).collect()} == {"und"}
    rows = docs.where(held).select("lang", langid.language_column(F.col("text"), samples, spark).alias("p")).collect()
    assert sum(r["lang"] == r["p"]["lang_pred"] for r in rows) / len(rows) > 0.97


def plain_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then go on left and right of it."""
    best = max(((sum(scores[a:b]), a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, a, b = max((s for s in ((sum(scores[x:y]), x - y, x, y) for x in range(len(scores)) for y in range(x + 1, len(scores) + 1)) if s[0] == best[0]), key=lambda s: (s[1], -s[2]))
    return plain_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in plain_segments(scores[b:])]


def test_segments_are_maximal():
    rnd = random.Random(6)
    for _ in range(200):
        scores = [rnd.choice((-3.0, -1.25, -0.5, 0.75, 2.0, 4.125)) + rnd.random() / 64 for _ in range(rnd.randrange(14))]
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(scores))] if scores else []
        assert got == plain_segments(scores)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    held = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    rows = held.select("toxic", toxicity.toxicity_column(F.col("text"), model, spark).alias("t")).collect()
    assert all(0 <= r["t"]["score"] <= 1 for r in rows)
    assert sum(r["toxic"] == r["t"]["predicted"] for r in rows) / len(rows) > 0.9
    odd = spark.createDataFrame([(None,), ("",), ("?!",)], "text string")
    assert {r["t"]["predicted"] for r in odd.select(toxicity.toxicity_column(F.col("text"), model, spark).alias("t")).collect()} == {0}
    assert zlib.crc32(b"7") % 4 == spark.range(1).select(F.crc32(F.lit("7").cast("binary")) % 4).first()[0]


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        field = quality_crf.LineField(rnd.normal(size=quality_crf.N_FEATURES), rnd.normal(size=(2, 2)))
        f = rnd.normal(size=(rnd.integers(1, 8), quality_crf.N_FEATURES))
        score = lambda y: sum((f[t] @ field.weights) * y[t] for t in range(len(f))) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
        paths = [[(k >> t) & 1 for t in range(len(f))] for k in range(2 ** len(f))]
        assert abs(score(field.decode(f.tolist())) - max(map(score, paths))) < 1e-9


def test_base_rules_against_plain_counts():
    rnd = random.Random(2)
    for _ in range(60):
        words = [rnd.choice("abcdef") for _ in range(rnd.randrange(60))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        marked = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        assert quality_crf.repeated_words([w.encode() for w in words]) == len(marked)
    n, chars, symbols, dups, *_ = quality_crf.judge("é# b\n\né# b\n |x y \n", quality_crf.LineField())
    assert (n, chars, symbols, dups) == (5, 10, 3, 1)
    assert quality_crf.judge("", quality_crf.LineField())[-2:] == (True, False)


ITEM = "If Ann drives 12 miles in 30 minutes and then rests at home for 10 minutes how far did Ann go today."
BENCH = [(5, ITEM), (6, "short item of few words here today ok yes"), (7, None)]


def test_leaks_by_both_ways(spark):
    again = ITEM.replace("Ann", "Bob").replace("12", "40").replace("30", "55")
    odd = ITEM.replace("did Ann", "did Zoe")
    texts = ["before words. " + ITEM + " after", again, odd, "nothing of the kind at all", None, "", ITEM.split(" in ")[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    items = decontam.benchmark_items(bench)
    rows = docs.select("doc_id", decontam.leak_column(F.col("text"), items, spark).alias("l")).collect()
    got = {(r["doc_id"], items[x["item"]][0], x["matched"]) for r in rows for x in r["l"]}
    assert {(d, i) for d, i, _ in got} >= {(0, 5), (1, 5)} and not {d for d, *_ in got} & {3, 4, 5, 6}
    exact = {r["doc_id"]: r["l"][0]["exact"] for r in rows if r["l"]}
    assert exact[0] and not exact[1]
    joined = decontam.leaks_by_join(docs.withColumnRenamed("doc_id", "id"), bench.withColumnRenamed("item_id", "id"))
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in joined.collect()} == got


def test_quality_is_learned_for_rows_that_were_not_fitted(spark):
    """Half of the labelled rows train, the other half is judged: both classes are told apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fitted = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = quality_crf.fit(docs, labels.where(fitted))
    rows = docs.join(labels.where(~fitted), "doc_id").select("quality", quality_crf.quality_column(F.col("text"), model, spark).alias("q")).collect()
    for label in (0, 1):
        own = [r["q"]["kept"] == bool(label) for r in rows if r["quality"] == label]
        assert len(own) > 20 and sum(own) / len(own) > 0.9, (label, sum(own), len(own))


def test_toxic_documents_that_were_not_fitted_are_caught(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, labels.where(~held))
    rows = docs.join(labels.where(held), "doc_id").select("toxic", toxicity.toxicity_column(F.col("text"), model, spark).alias("t")).collect()
    caught = [r["t"]["predicted"] for r in rows if r["toxic"]]
    clean = [r["t"]["predicted"] for r in rows if not r["toxic"]]
    assert sum(caught) / len(caught) > 0.85 and sum(clean) / len(clean) < 0.05, (sum(caught), len(caught), sum(clean), len(clean))


def test_models_on_odd_tables(spark):
    """Nulls anywhere, repeated ids, one class, empty tables and clashing names."""
    rows = [(None, "a b c"), (1, None), (1, "bad bad bad"), (1, "bad bad bad"), (2, ""), (3, "x " * 50_000)]
    docs = spark.createDataFrame([(i, t, "q", 0.5) for i, t in rows], "doc_id long, text string, y string, h double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1)], "doc_id long, toxic int, quality int")
    for some in (labels, labels.where("doc_id = 1"), labels.limit(0)):
        t = toxicity.fit(docs, some)
        out = docs.select(toxicity.toxicity_column(F.col("text"), t, spark).alias("t")).collect()
        assert len(out) == 6 and all(0.0 <= r["t"]["score"] <= 1.0 for r in out)
        q = quality_crf.fit(docs, some)
        kept = docs.select(quality_crf.quality_column(F.col("text"), q, spark).alias("q")).collect()
        assert len(kept) == 6 and all(r["q"]["base_failed"] and not r["q"]["kept"] for r in kept)
    assert docs.limit(0).select(toxicity.toxicity_column(F.col("text"), toxicity.fit(docs.limit(0), labels), spark)).count() == 0
