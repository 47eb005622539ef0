"""Collocations of two to four words by direct-address tiling.

Words are numbered by falling frequency, so frequent pairs of numbers lie close together. Each task cuts the plane of
pairs into square tiles: a tile with many of a buffer's pairs is counted by bincount into a dense array, all others
together as sorted coordinates. Frequent pairs are numbered by falling frequency in turn and paired with the next word
for phrases of three, and those again for four. The numberings sent to the tasks have fixed bounds; a phrase beyond them
is counted by its words' keys instead, which gives the same counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.runtime import arrow_batches, broadcast_if_small, materialize, ranked

LEAST = 30  # occurrences that make a candidate
LONGEST = 4
COVERED = 80  # percent of a phrase's occurrences inside one longer candidate that drop it
TOP = 2000
HEAD_WORDS = 300_000  # most frequent words, numbered in every task
HEAD_PHRASES = 1_000_000  # most frequent pairs, and as many triples, numbered in every task: 16 bytes each
TILE_BITS = 9  # a tile is 512 x 512
DENSE = 1 << (2 * TILE_BITS - 3)  # pairs in a buffer that make a tile dense
BUFFER = 1 << 19  # positions counted at once
BATCH = 1 << 16  # counts sent on at once
COUNTER_WORDS = 100_000  # distinct words held by a task
ROW_TOKENS = 1 << 12  # numbers stored in a row, and the rest of the text that passes them
BREAK = -1
SALTS = 64

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_STOPS = b",;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _STOPS + b"\t", _LOWER + b"." * len(_STOPS) + b" ")


def tokens(text: str) -> list[bytes]:
    """Lower-cased words in order; ``b"."`` stands where a piece ends."""
    return text.encode().translate(_TABLE).replace(b".", b" . ").split()


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, word, c)`` over ``texts(lang, text)``: counted in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out():
            rows = [(g, w.decode(), n) for g, c in held.items() for w, n in c.items() if w != b"."]
            held.clear()
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "c"])

        for b in batches:
            for lang, text in _columns(b):
                held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) > COUNTER_WORDS:
                yield out()
        yield out()

    return texts.mapInArrow(count, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def word_key(lang: Column, word: Column, salt: int) -> Column:
    """The key of a word beyond the numbered ones: below -1, from XXH64."""
    return F.lit(-2) - F.xxhash64(F.concat_ws("\x1f", F.lit(str(salt)), lang, word)).bitwiseAND(F.lit((1 << 61) - 1))


def _word_key(lang: str, word: bytes, salt: int) -> int:
    return -2 - (xxhash.xxh64_intdigest(b"\x1f".join((str(salt).encode(), lang.encode(), word)), 42) & ((1 << 61) - 1))


class _Numbers(dict):
    """Words of one language -> numbers; others a break if every frequent word is numbered, else their key."""

    def __init__(self, known: dict[bytes, int], lang: str, salt: int | None):
        super().__init__(known)
        self[b"."] = BREAK
        self.lang, self.salt = lang, salt

    def __missing__(self, word: bytes) -> int:
        return BREAK if self.salt is None else _word_key(self.lang, word, self.salt)


def encode(texts: DataFrame, head: dict[str, dict[bytes, int]], salt: int | None) -> DataFrame:
    """Texts as rows of word numbers, ``BREAK`` between pieces and texts."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {g: _Numbers(known, g, salt) for g, known in shared.value.items()}
        for b in batches:
            row: list[int] = []
            rows = []
            for lang, text in _columns(b):
                if lang not in own:
                    own[lang] = _Numbers({}, lang, salt)
                row.extend(map(own[lang].__getitem__, tokens(text)))
                row.append(BREAK)
                if len(row) >= ROW_TOKENS:
                    rows.append(np.array(row, np.int64))
                    row = []
            rows.append(np.array(row, np.int64))
            ends = np.cumsum([0, *map(len, rows)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([ids], ["ids"])

    return materialize(texts.mapInArrow(number, "ids array<long>"), "numbered")


@dataclass
class Numbering:
    """Numbered phrases of one length: sorted codes (left number, word) and their numbers."""

    codes: np.ndarray
    numbers: np.ndarray
    complete: bool  # every frequent phrase of this length is numbered

    def find(self, left: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(left), -1, np.int64)
        code = left * HEAD_LIMIT + last
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((left >= 0) & (last >= 0) & (self.codes[at] == code), self.numbers[at], -1)


HEAD_LIMIT = np.int64(1 << 24)  # above any number of a word


def tile_counts(left: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and their counts: dense tiles by bincount, the rest as sorted coordinates."""
    if not len(left):
        return left, last, left
    side, mask = np.int64(1 << TILE_BITS), np.int64((1 << TILE_BITS) - 1)
    tile = (left >> TILE_BITS) * (HEAD_LIMIT >> TILE_BITS) + (last >> TILE_BITS)
    lefts, lasts, counts = [], [], []
    busy, sizes = np.unique(tile, return_counts=True)
    busy = busy[sizes >= DENSE]
    sparse = np.ones(len(tile), bool)
    for t in busy.tolist():
        here = np.nonzero(tile == t)[0]
        sparse[here] = False
        cells = np.bincount((left[here] & mask) * side + (last[here] & mask), minlength=int(side * side))
        cell = np.nonzero(cells)[0]
        base_left, base_last = divmod(t, int(HEAD_LIMIT >> TILE_BITS))
        lefts.append(base_left * side + (cell >> TILE_BITS))
        lasts.append(base_last * side + (cell & mask))
        counts.append(cells[cell])
    codes, n = np.unique(left[sparse] * HEAD_LIMIT + last[sparse], return_counts=True)
    lefts.append(codes // HEAD_LIMIT)
    lasts.append(codes % HEAD_LIMIT)
    counts.append(n)
    return np.concatenate(lefts), np.concatenate(lasts), np.concatenate(counts)


def phrase_counts(ids: np.ndarray, size: int, tables: dict[int, Numbering], words_complete: bool) -> tuple[np.ndarray, ...]:
    """Codes and counts of the phrases of ``size`` words in ``ids`` that have a code, words and counts of the others; some that
    are surely infrequent are left out."""
    n = len(ids) - size + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros((0, size), np.int64), none
    one = np.where(ids >= 0, ids, -1)
    number = {1: one}
    for k in range(2, size):
        number[k] = tables[k].find(number[k - 1][:-1], one[k - 1 :])
    left, last, right = number[size - 1][:n], one[size - 1 :][:n], number[size - 1][1 : n + 1]
    complete = words_complete and all(tables[k].complete for k in range(2, size))
    direct = (left >= 0) & (last >= 0)
    if size > 2 and complete:
        direct &= right >= 0  # its last words are no frequent phrase, so it is none
    a, b, counts = tile_counts(left[direct], last[direct])
    rest, more = np.zeros((0, size), np.int64), none
    if not complete:
        whole = np.all(np.stack([ids[k : k + n] != BREAK for k in range(size)]), axis=0) & ~direct
        rest = np.stack([ids[k : k + n][whole] for k in range(size)], axis=1)
        if len(rest):
            rest, more = np.unique(rest, axis=0, return_counts=True)
    return a * HEAD_LIMIT + b, counts, rest, more


def count_phrases(encoded: DataFrame, size: int, tables: dict[int, Numbering], words_complete: bool, stems: DataFrame | None) -> DataFrame:
    """``(w1 .. wn, c)`` of the phrases of ``size`` words with ``LEAST`` occurrences or more.

    ``stems(number, w1 ..)`` has the numbered phrases that are one word shorter; those of one word are their own numbers.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(tables)
    names = [f"w{i}" for i in range(1, size + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            ids = np.concatenate(held)
            held.clear()
            for start in range(0, len(ids), BUFFER):  # a part has the starts of BUFFER phrases
                yield from counted(ids[start : start + BUFFER + size - 1])

        def counted(ids: np.ndarray):
            codes, counts, rest, more = phrase_counts(ids, size, shared.value, words_complete)
            for at in range(0, len(codes), BATCH):
                here = slice(at, at + BATCH)
                blank = pa.nulls(len(codes[here]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(codes[here]), blank, pa.array(counts[here].astype(np.int64))], ["code", "words", "c"])
            for at in range(0, len(rest), BATCH):
                part = np.ascontiguousarray(rest[at : at + BATCH])
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * size), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), words, pa.array(more[at : at + BATCH].astype(np.int64))], ["code", "words", "c"])

        for b in batches:
            ids = b.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(ids):
                held.append(ids)
            if sum(map(len, held)) >= BUFFER:
                yield from out()
        if held:
            yield from out()

    parts = encoded.mapInArrow(count, "code long, words array<long>, c long").groupBy("code", "words").agg(F.sum("c").alias("c"))
    parts = materialize(parts.where(F.col("c") >= LEAST), "counted")
    named = parts.where("words is not null").select(*[F.get("words", F.lit(i)).alias(w) for i, w in enumerate(names)], "c")
    limit = F.lit(int(HEAD_LIMIT))
    coded = parts.where("code is not null").select(F.shiftright("code", 24).alias("number"), F.col("code").bitwiseAND(limit - 1).alias(names[-1]), "c")
    coded = coded.withColumnRenamed("number", "w1") if stems is None else coded.join(stems, "number")
    return named.unionByName(coded.select(*names, "c"))


def number_phrases(phrases: DataFrame, size: int, tables: dict[int, Numbering], words_complete: bool) -> tuple[Numbering, DataFrame]:
    """The most frequent of ``phrases``, numbered by falling frequency; the table has them as ``(number, w1 ..)``."""
    names = [f"w{i}" for i in range(1, size + 1)]
    rows = ranked(phrases, [F.desc("c"), *map(F.col, names)], "number", "pairs")
    numbered = rows.where(F.col("number") < HEAD_PHRASES).select("number", *names)
    head = numbered.toArrow().to_pandas().sort_values("number")
    words = head[names].to_numpy(np.int64).reshape(-1, size)
    left = words[:, 0]
    for k in range(2, size):
        left = tables[k].find(left, words[:, k - 1])
    whole = (left >= 0) & np.all(words >= 0, axis=1)  # others are counted by their words
    codes = left[whole] * HEAD_LIMIT + words[whole, -1]
    order = np.argsort(codes)
    complete = words_complete and bool(whole.all()) and phrases.limit(HEAD_PHRASES + 1).count() <= HEAD_PHRASES
    complete = complete and all(tables[k].complete for k in range(2, size))
    return Numbering(codes[order], np.nonzero(whole)[0][order], complete), numbered


@dataclass
class Counts:
    """Frequent words with their numbers, frequent phrases by length, and all words per language."""

    words: DataFrame  # lang, word, c, number
    phrases: dict[int, DataFrame] = field(default_factory=dict)
    totals: DataFrame | None = None


def count_all(texts: DataFrame) -> Counts:
    """Counts over ``texts(lang, text)``, both without nulls."""
    arrow_batches(texts.sparkSession)
    every = materialize(word_counts(texts), "words")
    frequent = every.where(F.col("c") >= LEAST)
    words = materialize(ranked(frequent, [F.desc("c"), F.col("lang"), F.col("word")], "number"), "vocabulary")
    head: dict[str, dict[bytes, int]] = {}
    for r in words.where(F.col("number") < HEAD_WORDS).toLocalIterator():
        head.setdefault(r["lang"], {})[r["word"].encode()] = r["number"]
    complete = words.where(F.col("number") >= HEAD_WORDS).limit(1).count() == 0
    salt = None
    if not complete:
        salt = 0
        rest = every.join(words.where(F.col("number") < HEAD_WORDS).select("lang", "word"), ["lang", "word"], "left_anti")
        while rest.groupBy(word_key(F.col("lang"), F.col("word"), salt).alias("k")).count().where("count > 1").limit(1).count():
            salt += 1  # two words share a key: other keys
        key = word_key(F.col("lang"), F.col("word"), salt)
        words = words.withColumn("number", F.when(F.col("number") < HEAD_WORDS, F.col("number")).otherwise(key))
    encoded = encode(texts, head, salt)
    stems: DataFrame | None = None
    found, tables = Counts(words, {}, every.groupBy("lang").agg(F.sum("c").alias("n"))), {}
    for size in range(2, LONGEST + 1):
        found.phrases[size] = materialize(count_phrases(encoded, size, tables, complete, stems), f"phrases-{size}")
        if size < LONGEST:
            tables[size], stems = number_phrases(found.phrases[size], size, tables, complete)
    return found


def _ids(size: int, start: int = 1) -> Column:
    return F.array(*[F.col(f"w{i}") for i in range(start, start + size)])


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A null text is an empty one, a null language ``und``. Repeated rows count as often as they stand. An empty table, or
    one without a frequent phrase, gives no rows. Other columns play no part.
    """
    texts = df.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    counts = count_all(texts)
    words = materialize(counts.words.select(F.col("number").alias("key"), "lang", "word", "c"), "keys")
    phrases = None
    for size, rows in counts.phrases.items():
        part = rows.select(F.lit(size).alias("size"), _ids(size).alias("p"), F.col("c").alias("a"))
        phrases = part if phrases is None else phrases.unionByName(part)
    phrases = materialize(phrases, "candidates")
    known = phrases.select(F.col("p").alias("q"), F.col("a").alias("f")).unionByName(words.select(F.array("key").alias("q"), F.col("c").alias("f")))
    known = broadcast_if_small(known, 200_000)

    inner = phrases.where("size > 2").select(
        F.explode(F.expr(
            "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> slice(p, i, k))))"
        )).alias("p"), F.col("a").alias("outer"))
    inner = inner.groupBy("p").agg(F.max("outer").alias("outer"))
    kept = phrases.join(inner, "p", "left").where(
        F.coalesce(F.lit(100).cast("decimal(38,0)") * F.col("outer") < F.lit(COVERED).cast("decimal(38,0)") * F.col("a"), F.lit(True))
    ).select("size", "p", "a")

    cuts = kept.select("p", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("p", "a", "k", F.expr("slice(p, 1, k)").alias("first"), F.expr("slice(p, k + 1, size - k)").alias("rest"))
    cuts = cuts.join(known.select(F.col("q").alias("first"), F.col("f").alias("l")), "first")
    cuts = cuts.join(known.select(F.col("q").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    scored = scored.select("p", "a", "s.l", "s.r", "s.score")

    named = broadcast_if_small(words.select("key", "lang", "word"), 200_000)
    for i in range(LONGEST):
        own = named.select(F.col("key").alias(f"k{i}"), F.col("word").alias(f"t{i}"), *([F.col("lang")] if i == 0 else []))
        scored = scored.withColumn(f"k{i}", F.get("p", F.lit(i))).join(own, f"k{i}", "left")
    scored = scored.select("lang", F.concat_ws(" ", *[f"t{i}" for i in range(LONGEST)]).alias("phrase"), "a", "l", "r", "score")

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))  # first the best of each of many parts, then of those
    part = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    part = part.where(F.col("rank") <= top).drop("salt", "rank")
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(counts.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS pid, piece FROM pieces),
split AS (
  SELECT lang, pid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS spot
  FROM (SELECT lang, pid, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM numbered)),
runs AS (
  SELECT lang, w, lead(w, 1) OVER (PARTITION BY pid ORDER BY spot) AS w2, lead(w, 2) OVER (PARTITION BY pid ORDER BY spot) AS w3,
         lead(w, 3) OVER (PARTITION BY pid ORDER BY spot) AS w4 FROM split),
grams AS (
  SELECT lang, [w] AS p FROM runs
  UNION ALL SELECT lang, [w, w2] FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w, w2, w3] FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, [w, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL),
f AS (SELECT lang, p, count(*) AS a FROM grams GROUP BY lang, p HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM split GROUP BY lang),
inner_runs AS (
  SELECT lang, list_slice(p, i, i + k - 1) AS p, max(a) AS longer
  FROM (SELECT lang, p, a, unnest(range(2, len(p))) AS k FROM f WHERE len(p) > 2) x, LATERAL (SELECT unnest(range(1, len(x.p) - x.k + 2)) AS i) y
  GROUP BY ALL),
kept AS (
  SELECT f.lang, f.p, f.a FROM f LEFT JOIN inner_runs i ON i.lang = f.lang AND i.p = f.p
  WHERE len(f.p) > 1 AND (i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * f.a)),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, c.k)
  JOIN f r ON r.lang = c.lang AND r.p = list_slice(c.p, c.k + 1, len(c.p))),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
placed AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN n USING (lang) WHERE rank <= 2000
"""
