"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose slots were filled anew has the same
template. Windows of template tokens are hashed and joined with the benchmark's. Along each alignment the slots must
be consistent: one benchmark value stands for one document value throughout.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.runtime import arrow_batches

WINDOW = 8  # template tokens; an item with fewer is one window of its own
LITERALS = 4  # that a window must have beside its placeholders; an item without such a window is plain and must match verbatim
RUN = 13  # consecutive aligned tokens that make a leak; an item with fewer must match whole
BROADCAST_WINDOWS = 2_000_000  # 8 bytes each on every executor
CACHE_ENTRIES = 300_000
MARK_BITS = 20  # of a table that tells most windows from the benchmark's
TRIM = ".,;:!?\"'()[]{}<>*#%&$|"
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr ms hz khz mhz w kw v a c f mph kmh usd eur gbp dollars euros "
    "meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres seconds minutes hours days "
    "weeks months years percent degrees".split()
)
GLUED = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)([A-Za-z]+)")  # a number and its unit in one word
KINDS = ("num", "unit", "name")
PLACE = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>", 7)) for k in KINDS}
STEP = np.uint64(0x9E3779B97F4A7C15)


class _Forms(dict):
    """Words -> forms; a new word is learnt."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> int:
        return self.learn(word)


class Lexer:
    """Words -> hashes, kinds and values; facts about a word form are cached, within a bound.

    Kinds: 0 literal, 1 number, 2 unit, 3 capitalised, 4 capitalised at the start of a sentence or line.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known = _Forms(self.learn)
        self.core: list[str] = []
        self.hash = np.empty(1 << 12, np.uint64)
        self.kind = np.empty(1 << 12, np.int8)
        self.stop = np.empty(1 << 12, bool)  # ends a sentence
        self.worded = np.empty(1 << 12, bool)  # a number in words, which goes on with the number before it
        self.tail = np.empty(1 << 12, np.int64)  # the unit that is glued to this number, or -1
        self.solid = np.empty(1 << 12, bool)

    def learn(self, word: str) -> int:
        bare = word.strip(TRIM)
        low, glued = bare.lower(), GLUED.fullmatch(bare)
        tail, kind = -1, 3 if bare[:1].isupper() and not bare.isupper() else 0
        worded = low in NUMBER_WORDS or ("-" in low and all(w in NUMBER_WORDS for w in low.split("-")))
        if NUMBER.fullmatch(bare) or worded:
            kind = 1
        elif bare in UNITS or low in UNITS and len(low) > 2:
            kind = 2
        elif glued and (glued[2] in UNITS or glued[2].lower() in UNITS and len(glued[2]) > 2):
            kind, low = 1, glued[1].rstrip(".,:/")
            tail = self.store(glued[2].lower(), 2, word)
        self.known[word] = self.store(low, kind, word, worded, tail)
        return self.known[word]

    def store(self, core: str, kind: int, word: str, worded: bool = False, tail: int = -1) -> int:
        i = len(self.core)
        if i == len(self.hash):
            for name in ("hash", "kind", "stop", "worded", "tail", "solid"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.empty_like(old)]))
        self.core.append(core)
        self.hash[i], self.kind[i], self.worded[i], self.tail[i] = xxhash.xxh64_intdigest(core, 7), kind, worded, tail
        self.stop[i] = word.rstrip("\"')]}!?.:;|*#%&$") != word
        self.solid[i] = bool(core)
        return i

    def joined(self, words: list[int]) -> int:
        """The form of a number of several words."""
        core = " ".join(self.core[i] for i in words)
        if core not in self.known:
            self.known[core] = self.store(core, 1, core)
        return self.known[core]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own hash, kind and form of every token."""
        if len(self.core) > CACHE_ENTRIES:
            self.clear()
        words, starts = [], []
        for line in text.split("\n"):
            own = line.split()
            if own:
                starts.append(len(words))
                words += own
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if not len(ids):
            return np.empty(0, np.uint64), np.empty(0, np.int8), ids
        first = np.zeros(len(ids), bool)
        first[1:] = self.stop[ids[:-1]]
        first[starts] = True
        solid = self.solid[ids]
        ids, first = ids[solid], first[solid]
        glued = np.nonzero(self.tail[ids] >= 0)[0]
        if len(glued):
            ids, first = np.insert(ids, glued + 1, self.tail[ids[glued]]), np.insert(first, glued + 1, False)
        more = self.worded[ids[1:]] & (self.kind[ids[:-1]] == 1) & ~first[1:]
        if more.any():
            keep = np.concatenate(([True], ~more))
            heads = np.nonzero(keep)[0]
            ends = np.append(heads[1:], len(ids))
            ids = ids.copy()
            for a, b in zip(heads.tolist(), ends.tolist()):
                if b - a > 1:
                    ids[a] = self.joined(ids[a:b].tolist())
            ids, first = ids[keep], first[keep]
        kind = self.kind[ids]
        return self.hash[ids], np.where((kind == 3) & first, np.int8(4), kind), ids


def readings(own: np.ndarray, kind: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(hashes, whether literal)`` of the tokens with capitals as names inside sentences, everywhere, and nowhere."""
    fixed = own
    for k in (1, 2):
        fixed = np.where(kind == k, PLACE[KINDS[k - 1]], fixed)
    plain, inside, start = (kind == 0) | (kind > 2), kind == 3, kind == 4
    out = [(np.where(inside, PLACE["name"], fixed), plain & ~inside)]
    if start.any():
        out.append((np.where(inside | start, PLACE["name"], fixed), kind == 0))
    if inside.any():
        out.append((fixed, plain))
    return out


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(CHUNK + 2 * WINDOW, np.uint64(base)))))


CHUNK = 1 << 16  # tokens whose windows are hashed at once
POWERS, INVERSES = _powers(int(STEP)), _powers(pow(int(STEP), -1, 1 << 64))  # of an odd number, modulo 2^64


def windows(h: np.ndarray, width: int = WINDOW, plain: bool = False) -> np.ndarray:
    """Hash of each window, a polynomial from prefix sums; windows of different widths don't meet, nor plain and others."""
    n = len(h) - width + 1
    if n <= 0 or width < LITERALS and not plain:
        return np.empty(0, np.uint64)
    if n > CHUNK:
        return np.concatenate([windows(h[i : i + CHUNK + width - 1], width, plain) for i in range(0, n, CHUNK)])
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * POWERS[: len(h)])))
        return (sums[width:] - sums[:-width]) * INVERSES[:n] + np.uint64((WINDOW - width + plain * 2 * WINDOW) * 0x632BE59BD9B4E019 % (1 << 64))


def enough(literal: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows at ``places`` have enough literals."""
    return literal[places[:, None] + np.arange(width)].sum(1) >= LITERALS


def all_windows(own: np.ndarray, kind: np.ndarray, width: int, plain: bool) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """The windows of every reading with its literals, or the plain ones, which need none."""
    if plain:
        return [(windows(own, width, plain=True), None)]
    return [(windows(h, width), literal) for h, literal in readings(own, kind)]


def item_windows(own: np.ndarray, kind: np.ndarray) -> tuple[list[tuple[int, int]], tuple[int, bool]]:
    """An item's ``(place, hash)`` of the windows that count, and their ``(width, plain)``.

    An item none of whose template windows has enough literals is plain: its windows hold the words themselves.
    """
    width = min(WINDOW, len(own))
    for plain in (False, True):
        found = set()
        for wh, literal in all_windows(own, kind, width, plain):
            places = np.arange(len(wh))
            places = places if literal is None or not len(wh) else places[enough(literal, places, width)]
            found |= {(a, int(wh[a])) for a in places.tolist()}
        if found or not width:
            break
    return sorted(found), (width, plain)


def is_leak(length: int, size: int, words: int) -> bool:
    """Whether a run of ``length`` makes a leak; an item below ``LITERALS`` tokens must be the text's only words."""
    return length >= min(RUN, size) and (size >= LITERALS or words == size)


@dataclass
class Item:
    item_id: object
    kinds: list[int]
    cores: list[str]


class Index:
    """The benchmark's windows: hash -> places; built from items that passed the size check."""

    def __init__(self, items: list[tuple[object, str]]):
        lexer, self.items, places, widths = Lexer(), [], defaultdict(list), set()
        for item_id, text in items:
            own, kind, ids = lexer.tokens(text)
            found, width = item_windows(own, kind)
            for at, h in found:
                places[h].append((len(self.items), at))
                widths.add(width)
            self.items.append(Item(item_id, kind.tolist(), [lexer.core[i] for i in ids]))
        self.places, self.widths = dict(places), sorted(widths)
        self.sorted = np.sort(np.fromiter(self.places, np.uint64, len(self.places)))
        self.marks = np.zeros(1 << MARK_BITS, bool)  # spares most windows the search
        self.marks[self.sorted >> np.uint64(64 - MARK_BITS)] = True

    def hits(self, wh: np.ndarray, literal: np.ndarray | None, width: int) -> list[int]:
        """Places of the windows that count and that the benchmark has."""
        maybe = np.nonzero(self.marks[wh >> np.uint64(64 - MARK_BITS)])[0]
        if not len(maybe):
            return []
        at = np.searchsorted(self.sorted, wh[maybe])
        at[at == len(self.sorted)] = 0
        maybe = maybe[self.sorted[at] == wh[maybe]]
        return (maybe if literal is None else maybe[enough(literal, maybe, width)]).tolist()


def agree(a: tuple[int, str], b: tuple[int, str] | None) -> bool:
    """Whether two tokens ``(kind, core)`` can stand at the same place of a template."""
    return b is not None and (a[1] == b[1] or (a[0] > 2 and b[0] > 2) or (a[0] in (1, 2) and a[0] == b[0]))


def matched_run(starts: set[int], width: int, item: dict[int, tuple[int, str]], doc: dict[int, tuple[int, str]], offset: int) -> tuple[int, int]:
    """Longest run of aligned tokens ``(start, length)`` on one alignment whose slots are consistent.

    ``starts`` are the item's matched window places; ``item`` and ``doc`` have kinds and values by place. A matched window
    covers its tokens and, on either side, up to ``WINDOW`` more as far as they agree: windows of too few literals have no
    hash. Where a slot's value contradicts an earlier one, the run goes on from just after the last place of that
    earlier value.
    """
    covered = {t for s in starts for t in range(s, s + width)}
    for s in starts:
        for side in (range(s - 1, s - 1 - WINDOW, -1), range(s + width, s + width + WINDOW)):
            for t in side:
                if t not in item or not agree(item[t], doc.get(t + offset)):
                    break
                covered.add(t)
    best, begin, seen, last = (0, 0), None, {}, None
    for t in sorted(covered):
        kind, core = item[t]
        value = (min(kind, 3), core)
        if begin is None or t != last + 1:
            begin, seen = t, {}
        if kind:
            other = doc[t + offset][1]
            was, at = seen.get(value, (other, t))
            if was != other:
                begin = max(begin, at + 1)
            seen[value] = (other, t)
        last = t
        best = max(best, (t - begin + 1, -begin))
    return -best[1], best[0]


def near(starts: set[int], width: int) -> set[int]:
    """The places that :func:`matched_run` may look at."""
    return {t for s in starts for t in range(s - WINDOW, s + width + WINDOW)}


def leaks(text: str, index: Index, lexer: Lexer) -> list[tuple]:
    """``(item, item_words, matched, coverage, first_word, exact)`` of every benchmark item the text leaks."""
    own, kind, ids = lexer.tokens(text)
    lines: dict[tuple[int, int], set[int]] = defaultdict(set)
    for width, plain in index.widths:
        for wh, literal in all_windows(own, kind, width, plain):
            for d in index.hits(wh, literal, width) if len(wh) else []:
                for item, b in index.places[int(wh[d])]:
                    lines[item, d - b].add(b)
    found: dict[int, tuple] = {}
    for (i, offset), starts in lines.items():
        item = index.items[i]
        size, width = len(item.cores), min(WINDOW, len(item.cores))
        reach = near(starts, width)
        here = {t: (item.kinds[t], item.cores[t]) for t in reach if 0 <= t < size}
        doc = {t + offset: (int(kind[t + offset]), lexer.core[ids[t + offset]]) for t in here if 0 <= t + offset < len(ids)}
        start, length = matched_run(starts, width, here, doc, offset)
        if is_leak(length, size, len(ids)):
            exact = all(doc[t + offset][1] == item.cores[t] for t in range(start, start + length))
            found[i] = max(found.get(i, (-1,)), (length, -(start + offset), exact))
    return [
        (i, len(index.items[i].cores), n, n / len(index.items[i].cores), -first, exact)
        for i, (n, first, exact) in sorted(found.items())
    ]


LEAK = "array<struct<item:int,item_words:int,matched:int,coverage:double,first_word:int,exact:boolean>>"


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[tuple[object, str]] | None:
    """The items, if their words are few enough to broadcast; else None. Null texts leak nothing."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    words = rows.agg(F.sum(F.regexp_count(text_col, F.lit(r"\S+")))).first()[0] or 0
    if words > BROADCAST_WINDOWS:
        return None
    return sorted(((r[0], r[1]) for r in rows.collect()), key=lambda r: (str(r[0]), r[1]))


def leak_column(text: Column, items: list[tuple[object, str]], spark) -> Column:
    """Array of leaks of each text, by place in ``items``; empty for null, empty and clean texts."""
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf(LEAK)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, lexer = Index(shared.value), Lexer()
        names = ("item", "item_words", "matched", "coverage", "first_word", "exact")
        for texts in batches:
            yield pd.Series([[dict(zip(names, x)) for x in leaks(t, index, lexer)] for t in texts], dtype=object)

    return found(F.coalesce(text, F.lit("")))


FILTER_BITS = 27  # a filter of 16 MB at any benchmark size; it only spares windows that can't meet the benchmark


def window_table(docs: DataFrame, name: str, words: np.ndarray | None = None, widths: list[tuple[int, bool]] | None = None) -> DataFrame:
    """``(name_id, name_h, at, v, size, width, plain, lo, kinds, cores)``: windows of every text, for benchmarks too large to
    broadcast; ``kinds`` and ``cores`` hold the window and up to ``WINDOW`` tokens on either side, from place ``lo`` on.

    Without ``widths``, texts are items (see :func:`item_windows`). With a filter's ``words``, only windows that may be the benchmark's; repeated rows repeat their windows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<struct<at:int,v:long,size:int,width:int,plain:boolean,lo:int,kinds:array<int>,cores:array<string>>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexer, bits = Lexer(), shared.value
        for texts in batches:
            out = []
            for t in texts:
                own, kind, ids = lexer.tokens(t)
                cores, found = [lexer.core[i] for i in ids], set()
                if widths is None:
                    places, (width, plain) = item_windows(own, kind)
                    found = {(a, h, width, plain) for a, h in places}
                else:
                    for width, plain in widths:
                        for wh, literal in all_windows(own, kind, width, plain):
                            good = np.ones(len(wh), bool)
                            if bits is not None and len(wh):
                                for bit in filter_places(wh):
                                    good &= (bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
                            places = np.nonzero(good)[0]
                            if literal is not None and len(places):
                                places = places[enough(literal, places, width)]
                            found |= {(a, int(wh[a]), width, plain) for a in places.tolist()}
                rows = []
                for a, h, width, plain in sorted(found):
                    lo, hi = max(0, a - WINDOW), min(len(ids), a + width + WINDOW)
                    v = h - (1 << 64) if h >= 1 << 63 else h
                    rows.append({"at": a, "v": v, "size": len(ids), "width": width, "plain": plain, "lo": lo, "kinds": kind[lo:hi].tolist(), "cores": cores[lo:hi]})
                out.append(rows)
            yield pd.Series(out, dtype=object)

    rows = docs.select(F.col("id").alias(f"{name}_id"), F.xxhash64("text").alias(f"{name}_h"), F.coalesce("text", F.lit("")).alias("t"))
    return rows.select(f"{name}_id", f"{name}_h", F.explode(cut("t")).alias("w")).select(f"{name}_id", f"{name}_h", "w.*")


def filter_places(wh: np.ndarray) -> list[np.ndarray]:
    """The two bits of each window hash in the filter."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return [(x & mask).astype(np.int64) for x in (wh, wh >> np.uint64(32))]


def window_filter(table: DataFrame) -> np.ndarray:
    """A fixed-size Bloom filter of the table's window hashes, gathered as its non-zero words."""
    mask = (1 << FILTER_BITS) - 1
    bits = F.array(F.col("v").bitwiseAND(mask), F.shiftrightunsigned("v", 32).bitwiseAND(mask))
    places = table.select(F.explode(bits).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 AS int))")
    rows = places.groupBy(F.shiftright("bit", 6).alias("k")).agg(F.bit_or(one).alias("w")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows["k"].to_numpy()] = rows["w"].to_numpy().view(np.uint64)
    return out


def leaks_by_join(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The shuffle form: windows of both sides meet by hash, alignments are checked one by one.

    ``docs(id, text)`` and ``benchmark(id, text)`` -> the rows of the broadcast form: ``(doc_id, item_id, item_words,
    matched, coverage, first_word, exact)`` for each pair of rows. Rows that repeat an id and a text are aligned once
    and counted; an alignment has at most as many distinct windows as its item has words, so no group is unbounded.
    """
    items = benchmark.where(F.col("text").isNotNull()).groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    b = window_table(items, "item")
    widths = sorted((r[0], r[1]) for r in b.select("width", "plain").distinct().collect())  # WINDOW and shorter: a handful
    a = window_table(docs, "doc", window_filter(b), widths).drop("plain", "width")
    a = a.withColumnsRenamed({"at": "d", "size": "words", "lo": "dl", "kinds": "dk", "cores": "dc"})
    b = b.drop("plain").withColumnsRenamed({"at": "b", "lo": "bl", "kinds": "bk", "cores": "bc"})
    pairs = a.join(b, "v").groupBy("doc_id", "doc_h", "item_id", "item_h", (F.col("d") - F.col("b")).alias("offset"), "size", "width", "words")
    lines = pairs.agg(F.collect_set(F.struct("b", "bl", "bk", "bc", "dl", "dk", "dc")).alias("w"))

    @F.pandas_udf("struct<matched:int,start:int,exact:boolean>")
    def verify(w: pd.Series, offset: pd.Series, size: pd.Series, width: pd.Series, words: pd.Series) -> pd.DataFrame:
        out = []
        for rows, at, n, wide, m in zip(w, offset, size, width, words):
            item, doc = {}, {}
            for r in rows:
                item.update({r["bl"] + j: (k, c) for j, (k, c) in enumerate(zip(r["bk"], r["bc"]))})
                doc.update({r["dl"] + j: (k, c) for j, (k, c) in enumerate(zip(r["dk"], r["dc"]))})
            start, length = matched_run({r["b"] for r in rows}, wide, item, doc, at)
            exact = all(doc[t + at][1] == item[t][1] for t in range(start, start + length))
            out.append((length, start, exact) if is_leak(length, n, m) else (0, 0, False))
        return pd.DataFrame(out, columns=["matched", "start", "exact"])

    found = lines.withColumn("r", verify("w", "offset", "size", "width", "words")).where("r.matched > 0")
    best = F.max(F.struct("r.matched", (-(F.col("r.start") + F.col("offset"))).alias("back"), "r.exact")).alias("r")
    found = found.groupBy("doc_id", "doc_h", "item_id", "item_h", "size").agg(best)
    times = docs.groupBy(F.col("id").alias("x"), F.xxhash64("text").alias("doc_h")).agg(F.count("*").alias("n"))
    per = items.select(F.col("id").alias("y"), F.col("h").alias("item_h"), F.col("n").alias("m"))
    found = found.join(times, (found["doc_h"] == times["doc_h"]) & found["doc_id"].eqNullSafe(times["x"]))
    found = found.join(per, (found["item_h"] == per["item_h"]) & found["item_id"].eqNullSafe(per["y"]))
    words = F.col("size").alias("item_words")
    rows = found.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") * F.col("m"))))
    return rows.select("doc_id", "item_id", words, "r.matched", (F.col("r.matched") / F.col("size")).alias("coverage"), (-F.col("r.back")).alias("first_word"), "r.exact")


def op6_decontam(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = benchmark_items(benchmark)
    if items is None:
        return leaks_by_join(docs.withColumnRenamed("doc_id", "id"), benchmark.select(F.col("item_id").alias("id"), "text"))
    leaked = docs.select("doc_id", leak_column(F.col("text"), items, spark).alias("l"))
    rows = leaked.select("doc_id", F.explode("l").alias("l")).select("doc_id", "l.*")
    named = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], f"item int, item_id {dict(benchmark.dtypes)['item_id']}")
    return rows.join(F.broadcast(named), "item").select("doc_id", "item_id", "item_words", "matched", "coverage", "first_word", "exact")
