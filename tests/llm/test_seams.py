"""Line labels change inside documents."""

import numpy as np

from muster.llm import quality_crf as Q


def lines(rng, good):
    words = ["the", "river", "was", "quiet", "and", "boats", "came", "home", "before", "noon", "with", "bread"]
    out = []
    for _ in range(4):
        own = rng.choice(words, 9, replace=False).tolist()
        out.append(" ".join(own).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in own))
    return out


def made(seed=1, n=120):
    rng = np.random.default_rng(seed)
    docs = []
    for k in range(n):
        if k % 2:
            docs.append((lines(rng, True) + lines(rng, True), 1))
        else:
            halves = [lines(rng, True), lines(rng, False)]
            docs.append((halves[0] + halves[1] if k % 4 else halves[1] + halves[0], 0))
    return docs


def test_labels_change_at_the_seam():
    fitted = [(Q.text_lines("\n".join(x))[0], y) for x, y in made()]
    model = Q.train(fitted, [[9] * len(f) for f, _ in fitted])
    for x, y in made(seed=9, n=40):
        labels = model.decode(Q.text_lines("\n".join(x))[0])
        want = [0 if line.endswith("!!") else 1 for line in x]
        assert labels == want
        kept, share = Q.judge("\n".join(x), model)[7], Q.judge("\n".join(x), model)[5]
        assert kept == bool(y) and share == (1.0 if y else 0.5)


def test_a_share_lies_between_on_real_lines(spark):
    sf = "/root/testdata/sf0.01"
    p = Q.op3_quality(spark, sf).toPandas()
    assert ((p["content_share"] > 0) & (p["content_share"] < 1)).sum() > 5
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = p.merge(labels[labels["quality"].notna()], on="doc_id")
    assert both[both["quality"] == 0]["kept"].mean() < 0.1
    clean = both[(both["quality"] == 1) & ~both["base_failed"]]
    assert clean["kept"].mean() > 0.95
    assert p.columns.tolist()[:6] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert not (p["kept"] & p["base_failed"]).any()
