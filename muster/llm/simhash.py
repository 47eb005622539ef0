"""SimHash near-duplicate detection with pigeonring candidate filtering.

A fingerprint has 64 bits. Two fingerprints link when they differ in at most ``tau`` bits. The bits are cut into
``m`` segments that form a ring. If the whole ring differs in at most ``tau`` bits, then some start exists from
which every chain of ``l`` consecutive segments differs in at most ``floor(l * tau / m)`` bits (the pigeonring
principle). The chain's leading zero budgets, and the segments that a budget forces to be equal, give join keys;
the other budgets prune the joined pairs before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.graph import connected_components
from muster.runtime import arrow_batches, materialize, packed

BITS = 64
SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every ``words``-word shingle, repeats included; a shorter text is one shingle, an empty one none."""
    parts = text.lower().split()  # bytes: folds A-Z only, splits at \x20 and \x09-\x0D only
    if not parts:
        return np.empty(0, np.uint64)
    words = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit number: a bit is set if it is set in over half of the hashes."""
    hashes = shingle_hashes(text or b"", words)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        block = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, words: int = 3) -> Column:
    @F.pandas_udf("long")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return apply(text.cast("binary"))


def _masks(segments: int) -> list[int]:
    edges = [round(j * BITS / segments) for j in range(segments + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_budgets(tau: int, segments: int) -> list[int]:
    return [length * tau // segments for length in range(1, segments + 1)]


def chain_keys(tau: int, segments: int) -> list[int]:
    """Bit masks of the join keys: every pair within ``tau`` agrees under at least one of them."""
    budgets = chain_budgets(tau, segments)
    lead = sum(b == 0 for b in budgets)
    longest = max(range(lead, segments + 1), key=lambda n: (n - lead - (budgets[n - 1] if n else 0), -n))
    forced = longest - lead - (budgets[longest - 1] if longest > lead else 0)
    masks, found = _masks(segments), set()
    for start in range(segments):
        head = [(start + t) % segments for t in range(lead)]
        for more in combinations(range(lead, longest), forced):
            used = {*head, *((start + t) % segments for t in more)}
            found.add(sum(masks[j] for j in used))
    return sorted(found)


def _chain_holds(a: Column, b: Column, tau: int, segments: int) -> Column:
    gap = a.bitwiseXOR(b)
    differ = [F.bit_count(gap.bitwiseAND(F.lit(_signed(m)))) for m in _masks(segments)]
    budgets, any_start = chain_budgets(tau, segments), F.lit(False)
    for start in range(segments):
        chain, so_far = F.lit(True), F.lit(0)
        for length, budget in enumerate(budgets):
            so_far = so_far + differ[(start + length) % segments]
            chain = chain & (so_far <= budget)
        any_start = any_start | chain
    return any_start


def link_fingerprints(fps: DataFrame, tau: int = 2, segments: int = 5, crowded: int = 64) -> DataFrame:
    """Distinct fingerprints ``fps(fp)`` -> links ``(a, b)`` that connect exactly the pairs within ``tau`` bits.

    Buckets of up to ``crowded`` fingerprints are joined with the chain and Hamming checks. A larger bucket would
    give pairs in the square of its size, so each of its members emits itself and its 64 one-bit neighbours
    instead: two fingerprints are within two bits if and only if they share one of those, and each group (65 members
    at most) links to its least member. That connects the same fingerprints with 65 rows each.
    """
    if tau not in (0, 2):
        raise ValueError("tau must be 0 or 2")
    fp = F.col("fp")
    keys = [
        F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(mask)))) for i, mask in enumerate(chain_keys(tau, segments))
    ]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, "k"), "ring")
    few = shared.where(F.col("n") <= crowded)
    a, b = few.select("k", fp.alias("a")), few.select("k", fp.alias("b"))
    close = (F.col("a") < F.col("b")) & _chain_holds(F.col("a"), F.col("b"), tau, segments)
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau) & close
    pairs = a.join(b, (a["k"] == b["k"]) & near).select("a", "b")
    around = F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)] if tau else [fp])
    spread = shared.where(F.col("n") > crowded).select("fp").distinct().select("fp", F.explode(around).alias("v"))
    least = spread.select("fp", F.min("fp").over(Window.partitionBy("v")).alias("b"))
    return pairs.unionByName(least.where("fp <> b").select(fp.alias("a"), "b")).distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tau: int = 2, segments: int = 5
) -> DataFrame:
    """``(id, text_hash, fp, component_id)`` for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Copies meet as one fingerprint before any
    pair is made. A repeated row gives a repeated result row; a null id takes part but can't name a component
    unless the whole component has null ids (then the component id is null). Other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), fingerprint_column(text, words).alias("fp")
        ),
        "fingerprints",
    )
    classes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    labels = connected_components(link_fingerprints(classes.select("fp"), tau, segments))
    named = labels.withColumnRenamed("node", "fp").join(classes, "fp")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    linked = named.join(least, "component").select("fp", "least")
    merged = materialize(
        classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "classes"
    )
    return rows.join(merged, "fp").select("id", "text_hash", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs, words=3, tau=2).select(
        F.col("id").alias("doc_id"), fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


# Near copies by similarity. The sign of a vote is a weak witness of a Jaccard similarity of 0.8: the measured distance of such
# pairs on 64 bits is up to 17, where no chain of segments is selective. The fingerprint of this form therefore has
# minima of hashed shingles as its symbols (each differs with the probability of one minus the similarity). Segments
# of the ring are join keys again, and chains of segments prune the pairs before their texts are compared.
SLOTS = 64


def slot_budget(similarity: float) -> int:
    """Differing slots that a pair at ``similarity`` stays within but for one case in about 30,000 (four deviations)."""
    miss = 1.0 - similarity
    return int(SLOTS * miss + 4.0 * (SLOTS * miss * (1.0 - miss)) ** 0.5)


def slot_ring(budget: int) -> int:
    """Segments of the ring of slots: few, but more than the budget, so that a chain's first segment has a budget of zero."""
    if budget >= SLOTS:
        raise ValueError("the similarity is too low for the ring of slots")
    return SLOTS // 2 if budget < SLOTS // 2 else SLOTS


def slot_keys(budget: int) -> list[list[int]]:
    """Slots of the join keys: every pair within ``budget`` agrees under at least one of them.

    By the pigeonring principle some start has all its chains within their budgets, so its first segment is equal, and so is
    another one of the shortest chain whose budget is less than the segments after the first.
    """
    ring = slot_ring(budget)
    width, found = SLOTS // ring, set()
    longest = next((n for n, most in enumerate(chain_budgets(budget, ring), 1) if n > 1 and most < n - 1), None)
    for start in range(ring):
        for t in range(1, longest) if longest else (0,):
            used = {start, (start + t) % ring}
            found.add(tuple(sorted(j * width + i for j in used for i in range(width))))
    return [list(x) for x in sorted(found)]


def chains_hold(a: np.ndarray, b: np.ndarray, budget: int) -> np.ndarray:
    """For each pair of rows of slots whether from some start every chain is within its budget; a pair without such a start left is dropped at once."""
    ring = slot_ring(budget)
    gaps = (a != b).reshape(len(a), ring, SLOTS // ring).sum(axis=2)
    rows, total, alive = np.arange(len(a)), np.zeros_like(gaps), np.ones(gaps.shape, bool)
    for length, most in enumerate(chain_budgets(budget, ring)):
        total = total + np.roll(gaps, -length, axis=1)
        alive &= total <= most
        some = alive.any(axis=1)
        if not some.all():
            rows, gaps, total, alive = rows[some], gaps[some], total[some], alive[some]
    out = np.zeros(len(a), bool)
    out[rows] = True
    return out


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def slot_fingerprint(text: bytes | None, words: int) -> np.ndarray:
    """``SLOTS`` minima of the hashed shingle set, 32 bits each; all zero for a text without words."""
    with np.errstate(over="ignore"):
        hashes = shingle_set(text or b"", words)
        if not len(hashes):
            return np.zeros(SLOTS, np.uint32)
        low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 1 << 12):
            mixed = (hashes[at : at + (1 << 12), None] ^ MIX_A[None, :]) * MIX_B[None, :]
            low = np.minimum(low, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
        return (low >> np.uint64(16)).astype(np.uint32)


_rng = np.random.default_rng(SEED)
MIX_A = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
MIX_B = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)


def _slot_column(text: Column, words: int) -> Column:
    @F.pandas_udf("array<int>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([slot_fingerprint(t, words).view(np.int32).tolist() for t in texts], dtype=object)

    return apply(text.cast("binary"))


def _similar(a: Column, b: Column, words: int, similarity: float) -> Column:
    """Exact Jaccard similarity of the two texts' shingle sets."""

    @F.pandas_udf("boolean")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                p, q = shingle_set(x or b"", words), shingle_set(y or b"", words)
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(bool(both >= similarity * (len(p) + len(q) - both)))
            yield pd.Series(out, dtype=bool)

    return apply(a.cast("binary"), b.cast("binary"))


def _chains_column(a: Column, b: Column, budget: int) -> Column:
    @F.pandas_udf("boolean")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            one, two = (np.array(list(x), np.int64).reshape(-1, SLOTS) for x in (left, right))
            yield pd.Series(chains_hold(one, two, budget), dtype=bool)

    return apply(a, b)


def _slots_close(a: Column, b: Column, budget: int) -> Column:
    """The whole ring's budget: within it some start has all its chains within theirs, and beyond it none has."""
    whole = sum((a[i] != b[i]).cast("int") for i in range(1, SLOTS)) + (a[0] != b[0]).cast("int")
    return whole <= budget


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, crowded: int = 40
) -> DataFrame:
    """``(id, text_hash, component)``: rows whose texts are connected by pairs at ``similarity`` or more.

    Equal slot fingerprints (exact copies, but for chance) form one class first. Classes that agree under a key of
    :func:`slot_keys` are candidates, so all pairs within the ring's budget are. Buckets of up to
    ``crowded`` classes give all pairs, which the chains prune. In a larger bucket every class is checked against the bucket's least class; then,
    exactly, each class that is still apart from it is paired with the whole bucket. All pairs are verified on the
    texts' exact shingle sets, so distinct texts below ``similarity`` never link.
    """
    arrow_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = materialize(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), _slot_column(text, words).alias("fp")),
        "slots",
    )
    key = F.xxhash64("fp")
    # a class is named by its least text hash, which also names the text that stands for it
    classes = materialize(
        rows.groupBy(key.alias("c")).agg(F.min("text_hash").alias("node"), F.first("fp").alias("fp")), "slot-classes"
    )
    budget = slot_budget(similarity)
    places = F.array(*[F.array(*[F.lit(i) for i in places]) for places in slot_keys(budget)])
    keys = F.transform(places, lambda x: F.xxhash64(x, F.transform(x, lambda i: F.get(F.col("fp"), i))))
    keyed = classes.select("node", F.explode(keys).alias("k"))
    bucket = Window.partitionBy("k")
    shared = keyed.withColumns({"n": F.count("*").over(bucket), "pivot": F.min("node").over(bucket)}).where("n > 1")
    shared = materialize(shared, "slot-buckets")
    # similar classes share many keys; buckets of the same classes are paired once
    few = shared.where(F.col("n") <= crowded).groupBy("k").agg(F.sort_array(F.collect_list("node")).alias("s")).select("s").distinct()
    pairs = few.select("s", F.explode("s").alias("a")).select("a", F.explode(F.filter("s", lambda x: x > F.col("a"))).alias("b")).distinct()
    side = lambda x: classes.select(F.col("node").alias(x), F.col("fp").alias(f"f{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(_chains_column(F.col("fa"), F.col("fb"), budget)).select("a", "b")
    many = shared.where(F.col("n") > crowded)
    pairs = pairs.unionByName(many.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))).distinct()
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("t"))
    linked = materialize(_verified(pairs, texts, words, similarity), "slot-links")
    labels = materialize(connected_components(linked), "slot-labels")
    # exact rest of the crowded buckets: classes not yet with their pivot meet the whole bucket
    placed = labels.withColumnRenamed("component", "l")
    named = many.select("k", "node", "pivot").join(placed, "node", "left").withColumn("l", F.coalesce("l", "node"))
    home = named.where("node = pivot").select("k", F.col("l").alias("home"))
    apart = named.join(home, "k").where("l <> home").select("k", F.col("node").alias("a"), F.col("l").alias("la"))
    whole = named.join(apart.select("k").distinct(), "k", "left_semi").select("k", F.col("node").alias("b"), F.col("l").alias("lb"))
    apart, whole = apart.join(side("a"), "a"), whole.join(side("b"), "b")
    rest = apart.join(whole, (apart["k"] == whole["k"]) & (F.col("la") != F.col("lb")) & _slots_close(F.col("fa"), F.col("fb"), budget))
    rest = materialize(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "slot-rest")
    if rest.limit(1).count():
        more = materialize(_verified(rest, texts, words, similarity), "slot-links")
        labels = connected_components(linked.unionByName(more))
    own = classes.join(labels, "node", "left").select("c", F.coalesce("component", "node").alias("component"))
    return rows.select("id", "text_hash", key.alias("c")).join(own, "c").select("id", "text_hash", "component")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs of text hashes whose texts are similar; only texts that some pair needs move."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    held = materialize(texts.join(needed, "h", "left_semi").dropDuplicates(["h"]), "pair-texts")
    one = held.select(F.col("h").alias("a"), F.col("t").alias("ta"))
    two = held.select(F.col("h").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(one, "a").join(two, "b")
    return both.where(_similar(F.col("ta"), F.col("tb"), words, similarity)).select("a", "b")


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with all its columns, one document of each group of near copies: the one with the least doc_id.

    Rows with a null doc_id are compared like any other but only stay if no member of their group has an id; then the rows of
    one text stay, that of the least hash, with its repeats. Rows that repeat both doc_id and text are one document. Null
    and empty texts are one group.
    """
    groups = similar_components(docs.select("doc_id", "text"), words=words, similarity=similarity)
    first = groups.groupBy("component").agg(F.min("id").alias("least"))
    keep = groups.join(first, "component").where(F.col("id").eqNullSafe(F.col("least"))).select(
        F.col("id").alias("__id"), F.col("text_hash").alias("__th"), "component"
    )
    # rows that repeat a doc_id with other texts may share the group: one text stays
    keep = keep.groupBy("component", "__id").agg(F.min("__th").alias("__th")).drop("component")
    rows = docs.select(packed(docs), F.xxhash64("text").alias("__h"))
    kept = rows.join(keep, F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left_semi")
    turn = Window.partitionBy(F.col("__row.doc_id"), "__h").orderBy(F.lit(0))
    again = kept.withColumn("__n", F.when(F.col("__row.doc_id").isNull(), 1).otherwise(F.row_number().over(turn)))
    return again.where("__n = 1").select("__row.*")
