"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary choices, each at a node of the tree of bit prefixes; every node keeps zeros and ones in each
context of 0 to ``DEPTH`` preceding bytes. Krichevsky-Trofimov estimates of all these contexts are mixed: a context's
weighted probability is half its own estimate, half the product of its longer contexts', over the whole training corpus.
A text's code length follows from the resulting predictions, end of text included.

All counts are a table of byte strings (``DEPTH`` bytes of context and the next byte) summed over the corpus by a shuffle.
Contexts that end in the same two bytes are one subtree, worked out by one task; the few contexts above are worked out
from those. The tables of strings and words grow with the corpus and stay distributed: the commonest of them, up to a
fixed number, are sent to the tasks that score texts, and what those lack is joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.runtime import arrow_batches, materialize

DEPTH = 5  # bytes of context
TRUNK = 2  # contexts that share so many of their last bytes are one subtree
START, END = b"\xfe" * DEPTH, b"\xff"  # neither byte occurs in UTF-8
HEAD_STRINGS = 1 << 21  # commonest strings sent to scoring tasks, 16 bytes each
HEAD_WORDS = 300_000
SLICE = 1 << 21  # bytes worked on at once
COUNTER_WORDS = 300_000  # distinct words held by a task
EXACT = 4096  # log-gamma values from a table below, by Stirling's series from there on
CODE_BITS = 8 * (DEPTH + 1)
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_HALVES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(EXACT) + 0.5))))
_WHOLES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(EXACT) + 1.0))))


def fold(text: str) -> bytes:
    return text.encode().translate(_FOLD)


def words_of(data: bytes) -> list[bytes]:
    """Words, then the end of the text as the empty word."""
    return [*data.split(), b""]


# -- strings of bytes ----------------------------------------------------------------------------------------------


def string_codes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(codes, text numbers)`` of all positions of all texts, a slice at a time, whatever a text's length.

    A code holds the last byte before the position in its highest byte, the one before that next, and the position's own
    byte in its lowest.
    """
    pieces, numbers, held = [], [], 0

    def out():
        a = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        code = a[DEPTH:].copy()
        for k in range(1, DEPTH + 1):
            code |= a[DEPTH - k : len(a) - k] << (CODE_BITS - 8 * k)
        sizes = np.array([len(p) - DEPTH for p in pieces])
        starts = np.cumsum([0, *(sizes[:-1] + DEPTH)])
        keep = np.ones(len(code), bool)
        for s in starts[1:].tolist():
            keep[s - DEPTH : s] = False
        return code[keep], np.repeat(np.array(numbers), sizes)

    for i, t in enumerate(texts):
        padded = START + t + END
        for at in range(0, len(padded) - DEPTH, SLICE):
            piece = padded[at : at + SLICE + DEPTH]
            pieces.append(piece)
            numbers.append(i)
            held += len(piece)
            if held >= SLICE:
                yield out()
                pieces, numbers, held = [], [], 0
    if pieces:
        yield out()


def string_counts(texts: DataFrame) -> DataFrame:
    """``(code, learnt, c)`` over ``texts(text, learn)``: occurrences in texts to learn from, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[bytes]] = {True: [], False: []}
        size = 0

        def out():
            for learn, rows in held.items():
                for codes, _ in string_codes(rows):
                    found, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n if learn else np.zeros_like(n)), pa.array(n)], ["code", "learnt", "c"])
                rows.clear()

        for b in batches:
            for text, learn in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[learn].append(fold(text))
                size += len(text)
                if size >= 4 * SLICE:
                    yield from out()
                    size = 0
        yield from out()

    parts = texts.select("text", "learn").mapInArrow(count, "code long, learnt long, c long")
    return parts.groupBy("code").agg(F.sum("learnt").alias("learnt"), F.sum("c").alias("c"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over ``texts(text)``, ends of texts as the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return rows

        for b in batches:
            for text in b.column(0).to_pylist():
                held.update(words_of(fold(text)))
                if len(held) > COUNTER_WORDS:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


# -- the tree ------------------------------------------------------------------------------------------------------


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _log_halves(n: np.ndarray) -> np.ndarray:
    """log of 1/2 * 3/2 * ... with ``n`` factors."""
    far = np.maximum(n, EXACT) + 0.5
    return np.where(n <= EXACT, _HALVES[np.minimum(n, EXACT)], _stirling(far) - 0.5 * math.log(math.pi))


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    n = zeros + ones
    whole = np.where(n <= EXACT, _WHOLES[np.minimum(n, EXACT)], _stirling(np.maximum(n, EXACT) + 1.0))
    return _log_halves(zeros) + _log_halves(ones) - whole


@dataclass
class Nodes:
    """Nodes of one depth and bit: sorted keys (context, bit prefix), counts, log estimates, and how the mix weighs them."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    estimate: np.ndarray
    weighted: np.ndarray | None = None
    own: np.ndarray | None = None  # share of the node's own estimate in its prediction

    def mix(self, below: np.ndarray | None) -> None:
        """``below``: summed log weighted probabilities of the longer contexts; None at full depth."""
        if below is None:
            self.weighted, self.own = self.estimate, np.ones(len(self.keys))
        else:
            self.weighted = np.logaddexp(self.estimate, below) - math.log(2)
            self.own = 1 / (1 + np.exp(np.clip(below - self.estimate, -700, 700)))


def bit_nodes(context: np.ndarray, byte: np.ndarray, counts: np.ndarray) -> list[Nodes]:
    """The eight bits' nodes of one depth, from rows sorted by context and byte."""
    out = []
    for k in range(8):
        keys = (context << 8) | (1 << k) | (byte >> (8 - k))
        first = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1))
        total = np.add.reduceat(counts, first)
        ones = np.add.reduceat(counts * ((byte >> (7 - k)) & 1), first)
        out.append(Nodes(keys[first], total - ones, ones, log_estimate(total - ones, ones)))
    return out


def subtree(codes: np.ndarray, counts: np.ndarray) -> dict[int, list[Nodes]]:
    """Mixed nodes of all depths from ``TRUNK`` down, of contexts that share their last ``TRUNK`` bytes."""
    levels: dict[int, list[Nodes]] = {}
    for depth in range(DEPTH, TRUNK - 1, -1):
        rows, at = np.unique(((codes >> (CODE_BITS - 8 * depth)) << 8) | (codes & 255), return_inverse=True)
        total = np.bincount(at, counts, len(rows)).astype(np.int64)
        levels[depth] = bit_nodes(rows >> 8, rows & 255, total)
        for k, nodes in enumerate(levels[depth]):
            below = None
            if depth < DEPTH:
                longer = levels[depth + 1][k]
                up = np.searchsorted(nodes.keys, ((longer.keys >> 16) << 8) | (longer.keys & 255))
                below = np.bincount(up, longer.weighted, len(nodes.keys))
            nodes.mix(below)
    return levels


@dataclass
class Trunk:
    """Shares and estimates of the contexts of fewer than ``TRUNK`` bytes: at most 256 x 256 nodes."""

    own: list[np.ndarray]  # by depth: context x node
    one: list[np.ndarray]
    seen: list[np.ndarray]


def trunk_of(top: DataFrame) -> Trunk:
    """From ``top(key, zeros, ones, weighted)`` of depth ``TRUNK``; sums of one-byte contexts are 65,280 rows at most."""
    parent = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    up = top.groupBy(parent.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    rows = up.toArrow().to_pandas()
    trunk = Trunk([], [], [])
    key, zeros, ones, below = (rows[c].to_numpy() for c in ("key", "zeros", "ones", "below"))
    for depth in (1, 0):
        if depth == 0:
            flat = key & 255
            zeros, ones = (np.bincount(flat, v, 256).astype(np.int64) for v in (zeros, ones))
            below, key = np.bincount(flat, weighted, 256), np.arange(256)
        nodes = Nodes(key, zeros, ones, log_estimate(zeros, ones))
        nodes.mix(below)
        weighted = nodes.weighted
        grid = [np.zeros(256 if depth == 0 else 65536) for _ in range(3)]
        for g, v in zip(grid, (nodes.own, (ones + 0.5) / (zeros + ones + 1.0), (zeros + ones > 0).astype(float))):
            g[key] = v
        for kept, g in zip((trunk.own, trunk.one, trunk.seen), grid):
            kept.insert(0, g)
    return trunk


def log_predictions(codes: np.ndarray, levels: dict[int, list[Nodes]], trunk: Trunk) -> np.ndarray:
    """Log probability of each code's byte after its context, mixed over all depths."""
    byte, out = codes & 255, np.zeros(len(codes))
    for k in range(8):
        node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
        total, weight = np.zeros(len(codes)), np.ones(len(codes))
        for depth in range(DEPTH + 1):
            keys = ((codes >> (CODE_BITS - 8 * depth)) << 8) | node
            if depth < TRUNK:
                own, one, seen = trunk.own[depth][keys], trunk.one[depth][keys], trunk.seen[depth][keys] > 0
            elif levels:
                n = levels[depth][k]
                at = np.minimum(np.searchsorted(n.keys, keys), len(n.keys) - 1)
                seen = n.keys[at] == keys
                own, one = n.own[at], (n.ones[at] + 0.5) / (n.zeros[at] + n.ones[at] + 1.0)
            else:
                own = one = np.zeros(len(codes))
                seen = np.zeros(len(codes), bool)
            # a context never seen has an even chance, and so have all longer ones
            share, p = np.where(seen, own, 1.0), np.where(seen, np.where(bit == 1, one, 1 - one), 0.5)
            total += weight * share * p
            weight = weight * (1 - share)
        out += np.log(total)
    return out


def predictions(strings: DataFrame) -> DataFrame:
    """``(code, c, logp)`` of every string of ``strings(code, learnt, c)``, from those learnt."""
    spark = strings.sparkSession
    stem = F.shiftright("code", CODE_BITS - 8 * TRUNK).alias("stem")

    def arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
        code, learnt, c = (table.column(n).to_numpy() for n in ("code", "learnt", "c"))
        order = np.argsort(code)
        return code[order], learnt[order], c[order]

    def tops(table: pa.Table) -> pa.Table:
        code, learnt, _ = arrays(table)
        found = subtree(code[learnt > 0], learnt[learnt > 0])[TRUNK] if (learnt > 0).any() else []
        columns = [np.concatenate([getattr(n, a) for n in found]) if found else np.zeros(0) for a in ("keys", "zeros", "ones", "weighted")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["key", "zeros", "ones", "weighted"])

    groups = strings.groupBy(stem)
    trunk = spark.sparkContext.broadcast(trunk_of(groups.applyInArrow(tops, "key long, zeros long, ones long, weighted double")))

    def predict(table: pa.Table) -> pa.Table:
        code, learnt, c = arrays(table)
        levels = subtree(code[learnt > 0], learnt[learnt > 0]) if (learnt > 0).any() else {}
        return pa.Table.from_arrays([pa.array(code), pa.array(c), pa.array(log_predictions(code, levels, trunk.value))], ["code", "c", "logp"])

    return groups.applyInArrow(predict, "code long, c long, logp double")


# -- scores --------------------------------------------------------------------------------------------------------


def commonest(table: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Rows of ``table(c)`` with the largest counts, ``most`` at the most, by a power of two as threshold; and whether that is all."""
    sizes = table.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["b"]):
        if total + r["n"] > most:
            break
        total, least = total + r["n"], r["b"]
    if least is None:
        return table.limit(0), not sizes
    return table.where(F.col("c") >= (1 << least)), total == sum(r["n"] for r in sizes)


MEASURED = (
    "n_tokens long, n_known long, base double, logp double, words array<struct<word:string,n:long>>, strings array<struct<code:long,n:long>>"
)


def score_texts(df: DataFrame, learn: Column, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if None) with a struct ``__lm``: n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte.

    The model learns from the rows of ``df`` where ``learn`` holds (null: not). A null text is an empty one: one end.
    Repeated rows are learnt as often as they stand. Without anything to learn from every choice is even. ``score`` is the
    log10 probability of the lower-cased bytes and the end; ``bits_per_byte`` the code length over their number.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    rows = df.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn("__learn", F.coalesce(learn, F.lit(False)))
    texts = rows.select(F.col("__text").alias("text"), F.col("__learn").alias("learn"))
    strings = materialize(predictions(materialize(string_counts(texts), "strings")), "predictions")
    words = materialize(word_counts(texts.where("learn")), "words")
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, floor = size["n"], size["n"] + size["v"] + 1

    head, all_strings = commonest(strings, HEAD_STRINGS)
    table = head.select("code", "logp").toArrow()
    codes, logs = (table.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(codes)
    head, all_words = commonest(words, HEAD_WORDS)
    known = head.toArrow()
    known = dict(zip((w.encode() for w in known.column("word").to_pylist()), known.column("c").to_pylist()))
    shared = spark.sparkContext.broadcast((codes[order], logs[order], known))

    @F.pandas_udf(MEASURED)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes, logs, known = shared.value
        for series in batches:
            data = [fold(t) for t in series]
            logp, lacking = np.zeros(len(data)), [[] for _ in data]
            for found, which in string_codes(data):
                distinct, back = np.unique(found, return_inverse=True)
                at = np.minimum(np.searchsorted(codes, distinct), max(len(codes) - 1, 0))
                here = codes[at] == distinct if len(codes) else np.zeros(len(distinct), bool)
                value = np.where(here, logs[at], 0.0) if len(codes) else np.zeros(len(distinct))
                logp += np.bincount(which, value[back], len(data))
                if not here.all():
                    miss = ~here[back]
                    pairs, times = np.unique(np.stack([which[miss], found[miss]], axis=1), axis=0, return_counts=True)
                    for (i, code), k in zip(pairs.tolist(), times.tolist()):
                        lacking[i].append({"code": code, "n": k})
            out = []
            for i, d in enumerate(data):
                tokens = words_of(d)
                base, hits, rest = 0.0, 0, Counter()
                for w in tokens:
                    c = known.get(w)
                    if c is None:
                        rest[w] += 1
                    else:
                        hits += 1
                        base += math.log10((c + 1) / floor)
                if all_words:  # the others were never learnt
                    base += sum(rest.values()) * math.log10(1 / floor)
                    rest.clear()
                out.append((len(tokens), hits, base, logp[i], [{"word": w.decode(), "n": k} for w, k in rest.items()], lacking[i]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MEASURED.split(", ")])

    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    done = rows.select(*kept, F.octet_length("__text").alias("__size"), measured("__text").alias("__m"))
    hits, base, logp = F.col("__m.n_known"), F.col("__m.base"), F.col("__m.logp")
    if not (all_strings and all_words):
        done = materialize(done.withColumn("__id", F.monotonically_increasing_id()), "measured")
        more = done.select("__id", F.explode("__m.words").alias("x")).select("__id", "x.word", "x.n")
        more = more.join(words, "word", "left").groupBy("__id").agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("__hits"),
            F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(floor))).alias("__base"),
        )
        far = done.select("__id", F.explode("__m.strings").alias("x")).select("__id", "x.code", "x.n")
        far = far.join(strings.select("code", F.col("logp").alias("__p")), "code").groupBy("__id").agg(F.sum(F.col("n") * F.col("__p")).alias("__logp"))
        done = done.join(more, "__id", "left").join(far, "__id", "left")
        hits, base = hits + F.coalesce("__hits", F.lit(0)), base + F.coalesce("__base", F.lit(0.0))
        logp = logp + F.coalesce("__logp", F.lit(0.0))
    bits = -logp / math.log(2) / (F.col("__size") + 1)
    result = F.struct(
        F.col("__m.n_tokens").alias("n_tokens"), hits.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"),
        (logp / math.log(10)).alias("score"), bits.alias("bits_per_byte"),
    )
    return done.select(*kept, result.alias("__lm"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op11_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, ~held_out(F.col("doc_id")), keep=("doc_id",)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__lm.*")
