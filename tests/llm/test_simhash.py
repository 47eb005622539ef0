import random

import numpy as np
import xxhash

from muster.llm import simhash as H


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_plain_majority():
    for text in ("", " \n\t", "One", "a b c d", "É x y É x y É", "w " * 40_000 + "z"):
        assert H.fingerprint(text.encode()) & (2**64 - 1) == plain_fingerprint(text)
    assert H.fingerprint(None) == 0


def test_links_are_those_of_all_pairs(spark):
    rnd, fps = random.Random(2), set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(6)}
    hub = rnd.getrandbits(64)  # a crowded bucket
    fps |= {hub ^ sum(1 << b for b in rnd.sample(range(20), 2)) for _ in range(150)}
    fps = sorted(np.array(list(fps), np.uint64).view(np.int64).tolist())
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for crowded in (10_000, 8):
        labels = {r["node"]: r["component"] for r in H.connected_components(H.link_fingerprints(df, crowded=crowded)).collect()}
        assert {x: labels.get(x, x) for x in fps} == {x: find(x) for x in fps}


def test_near_dedup_against_all_pairs(spark):
    rnd, docs, n = random.Random(4), [], 0
    vocabulary = [f"w{i}" for i in range(3000)]
    for g in range(14):
        base = rnd.choices(vocabulary, k=rnd.choice((30, 80, 200)))
        for _ in range(60 if g == 0 else rnd.choice((1, 2, 4))):
            words = list(base)
            for _ in range(rnd.choice((0, 1, 2, 4))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            docs.append((n, " ".join(words), "x"))
            n += 1
    docs += [(n, None, "x"), (n + 1, "", None), (n + 2, "one", "x"), (None, docs[0][1], "x"), (3, docs[3][1], "again")]
    sets = [(i, H.shingle_set((t or "").encode(), 5)) for i, t, _ in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both >= 0.8 * (len(a) + len(b) - both):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    want = sorted({min((docs[i][0] for i in range(len(docs)) if find(i) == g and docs[i][0] is not None)) for g in {find(i) for i in range(len(docs))}})
    df = spark.createDataFrame(docs, "doc_id long, text string, component string")
    got = H.near_dedup(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert H.near_dedup(df.limit(0)).count() == 0


def test_slot_keys_and_chains_hold_all_pairs_within_the_budget():
    rng = np.random.default_rng(3)
    for similarity in (0.8, 0.9, 0.6):
        budget = H.slot_budget(similarity)
        keys = H.slot_keys(budget)
        a = rng.integers(0, 1 << 20, (3000, H.SLOTS))
        b, gaps = a.copy(), rng.integers(0, 2 * budget if budget < 32 else H.SLOTS, len(a))
        gaps[:1000] = budget  # the most that is still within, spread and in a run
        for i, n in enumerate(gaps):
            run = (np.arange(n) + rng.integers(H.SLOTS)) % H.SLOTS
            b[i, run if i % 3 == 0 else rng.permutation(H.SLOTS)[:n]] += 1
        even = np.arange(budget) * H.SLOTS // budget  # as evenly as can be, so that few segments are equal
        b[0], b[0, even] = a[0], a[0, even] + 1
        near = gaps <= budget
        assert near.any() and not near.all()
        assert (H.chains_hold(a, b, budget) == near).all()
        keyed = np.any([(a[:, k] == b[:, k]).all(axis=1) for k in keys], axis=0)
        assert keyed[near].all()
    assert len(H.slot_keys(H.slot_budget(0.8))) == 128 and {len(k) for k in H.slot_keys(H.slot_budget(0.8))} == {4}
    assert len(H.chains_hold(a[:0], b[:0], budget)) == 0
