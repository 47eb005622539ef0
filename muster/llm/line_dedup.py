"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line's words (split at ASCII white space, lower-cased) are what is compared. A line is dropped if an equal line
occurs earlier, or, for lines of at least ``NEAR_WORDS`` words, one within an edit distance of one word. The edit
bound is thus one word in ten: a shorter line has the bound zero, where equal lines are the whole neighbourhood.
"Earlier" is a smaller doc_id, then a smaller line number. Every line emits its words without the i-th one, for each i, as a
hashed key with the place i; equal keys mean one word replaced at i, and a key that equals another line's whole
words means one word inserted there. The earliest line of each key is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from muster.runtime import broadcast_if_small, materialize, packed, release

MIN_WORDS = 3  # shorter lines are never dropped
NEAR_WORDS = 10
LONG_WORDS = 32
BROADCAST_LINES = 500_000  # hashes, 8 bytes each
BLANKS = ("  ", "\t", "\x0b", "\x0c", "\r")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _folded(text: Column) -> Column:
    """Lower-cased text whose blanks within a line are single spaces; line breaks stay. Most texts need no regex."""
    odd = F.lit(False)
    for blank in BLANKS:
        odd = odd | F.contains(text, F.lit(blank))
    tidy = F.regexp_replace(text, r"[\t\x0B-\x0D][\x20\t\x0B-\x0D]*|\x20[\x20\t\x0B-\x0D]+", " ")
    return F.lower(F.when(odd, tidy).otherwise(F.coalesce(text, F.lit(""))))


def _over(words: int) -> Column:
    """Whether ``line`` has more than so many words; reads no further than that."""
    return F.substring_index("line", " ", words) != F.col("line")


def line_table(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` -> one row a line of at least ``words`` words: its place and folded words."""
    lines = F.transform(F.split(_folded(F.col("text")), "\n", -1), lambda x: F.trim(x))
    row = docs.select("doc_id", F.xxhash64("text").alias("th"), lines.alias("l"))
    return row.select("doc_id", "th", F.posexplode("l").alias("pos", "line")).where(_over(words - 1))


def _ends() -> list[Column]:
    """Hashes of a near line's first and last words; two lines within one word of each other share one of them.

    The edited place lies behind the first ``k`` words or before the last ``k`` of both lines if both have ``2 k`` words or more.
    ``k`` is 5, and 16 for lines of ``LONG_WORDS`` words; a line of exactly so many can meet one word less, so it has both.
    """
    sides = lambda k: [F.xxhash64(F.lit(j), F.substring_index("line", " ", j)) for j in (k, -k)]
    near, long = _over(NEAR_WORDS - 1), _over(LONG_WORDS - 1)
    few, many = sides(NEAR_WORDS // 2), sides(LONG_WORDS // 2)
    own = [F.when(near, F.when(long, m).otherwise(f)) for f, m in zip(few, many)]
    return own + [F.when(long & ~_over(LONG_WORDS), f) for f in few]


def _placed(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.xxhash64(w, i))


def _without_one(words: Column) -> Column:
    """For each place the hash of all words and places but that one: the exclusive or of the others' hashes."""
    bound = F.transform(F.array(_placed(words)), lambda x: F.struct(x.alias("x"), F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s.bitwiseXOR(y)).alias("all")))
    return F.flatten(F.transform(bound, lambda b: F.transform(b["x"], lambda y: y.bitwiseXOR(b["all"]))))


def _bags(words: Column) -> Column:
    return F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 24))  # 40 bits: sums of millions stay in range


def _bag(words: Column) -> Column:
    return F.aggregate(_bags(words), F.lit(0).cast("long"), lambda s, y: s + y)


def _bag_without_one(words: Column) -> Column:
    bound = F.transform(F.array(_bags(words)), lambda x: F.struct(x.alias("x"), F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y).alias("all")))
    return F.flatten(F.transform(bound, lambda b: F.transform(b["x"], lambda y: b["all"] - y)))


def _one_more(longer: Column, shorter: Column) -> Column:
    """Whether ``longer`` is ``shorter`` with one more word: it goes on as before after the first place that differs."""
    first = F.array_position(F.zip_with(shorter, longer, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    rest = F.concat(F.slice(longer, F.lit(1), first - 1), F.slice(longer, first + 1, F.size(longer)))
    return (F.size(longer) == F.size(shorter) + 1) & (rest == shorter)


def _near_classes(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Hashes of lines that an earlier line lies within one word of, and the tables that hold them.

    Only lines that share their first or last words with another distinct line emit variants. A variant's key takes one word out
    of a sum of hashes, so all variants of a line take time linear in its length, however long it is. Variants move as a
    hash and a line's hash, and beyond that only those that another line shares.
    """
    ends = rows.where("x1 is not null").select("h", F.explode(F.array_compact(F.array("x1", "x2", "x3", "x4"))).alias("x"))
    crowded = materialize(ends.groupBy("x").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("x"), "crowded")
    alive = materialize(ends.join(broadcast_if_small(crowded, BROADCAST_LINES), "x", "left_semi").select("h").distinct(), "alive")
    again = line_table(docs, NEAR_WORDS).select("doc_id", "pos", "line", F.xxhash64("line").alias("h"))
    mine = again.join(broadcast_if_small(alive, BROADCAST_LINES), "h", "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("k"), F.col("doc_id").alias("d"), F.col("pos").alias("q"))).alias("o")
    lines = mine.groupBy("h").agg(F.first("line").alias("line"), first)
    known = materialize(lines.withColumn("n", F.size(F.split("line", " "))), "near-lines")
    def variants(emit) -> DataFrame:
        """``(h, n, i, v)``: ``emit(words)`` gives the hashed key of the line without its i-th word, for each i."""
        return known.select("h", "n", F.posexplode(emit(F.split("line", " "))).alias("i", "v")).withColumn("i", F.col("i") + 1)

    # one word replaced at i: the words of all other places are hashed with their places
    swap = variants(_without_one).select("h", "i", F.xxhash64("v", "n", "i").alias("v"))
    shared = swap.groupBy("v").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("v")
    shared = materialize(shared, "shared-variants")
    met = swap.join(broadcast_if_small(shared, BROADCAST_LINES), "v", "left_semi").join(known.select("h", "o"), "h")
    # all lines of a key are within one word of each other; the earliest is enough
    first = F.first("h").over(Window.partitionBy("v").orderBy("o", "h"))
    pairs = met.select("h", first.alias("p"), "i", F.lit("swap").alias("how")).where("p <> h")
    # one word inserted at i: the longer line's key is the sum over the shorter line's words, whatever their places
    sums = known.select(F.xxhash64(_bag(F.split("line", " ")), F.col("n") + 1).alias("v"), F.col("h").alias("sh"), F.col("o").alias("so"))
    sums = materialize(sums, "sums")
    cut = variants(_bag_without_one).select("h", "i", F.xxhash64("v", "n").alias("v"))
    cut = cut.join(broadcast_if_small(sums.select("v").distinct(), BROADCAST_LINES), "v", "left_semi").dropDuplicates(["h", "v"])
    grown = cut.join(sums, "v").join(known.select("h", "o"), "h").where("o <> so")
    late = F.col("so") < F.col("o")
    pairs = pairs.unionByName(grown.select(
        F.when(late, F.col("h")).otherwise(F.col("sh")).alias("h"), F.when(late, F.col("sh")).otherwise(F.col("h")).alias("p"), "i",
        F.when(late, "cut").otherwise("add").alias("how"),
    ))
    a = known.select("h", F.split("line", " ").alias("a"))
    b = known.select(F.col("h").alias("p"), F.split("line", " ").alias("b"))
    drop = lambda x: F.concat(F.slice(x, F.lit(1), F.col("i") - 1), F.slice(x, F.col("i") + 1, F.size(x)))
    same = (
        F.when(F.col("how") == "swap", drop(F.col("a")) == drop(F.col("b")))
        .when(F.col("how") == "cut", _one_more(F.col("a"), F.col("b")))
        .otherwise(_one_more(F.col("b"), F.col("a")))
    )
    # a line of many places is verified once for each partner and place, in one pass over the words
    return pairs.distinct().join(a, "h").join(b, "p").where(same).select("h").distinct(), (crowded, alive, known, shared, sums)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, th, dropped)``: sorted numbers of each text's dropped lines, where any."""
    x = [c.alias(f"x{j}") for j, c in enumerate(_ends(), 1)]
    rows = materialize(line_table(docs).select("doc_id", "th", "pos", F.xxhash64("line").alias("h"), *x), "lines")
    near, used = _near_classes(docs, rows)
    near = materialize(near, "near")
    for done in used:
        release(done)
    classes = rows.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("c"))
    near = near.withColumn("near", F.lit(True))
    marked = materialize(
        classes.join(near, "h", "left").where("c > 1 or near").select("h", "first_doc", F.coalesce("near", F.lit(False)).alias("near")),
        "marked",
    )
    fixed = isinstance(docs.schema["doc_id"].dataType, NumericType)  # rows of a known size
    hits = rows.select("doc_id", "th", "pos", "h").join(broadcast_if_small(marked, BROADCAST_LINES) if fixed else marked, "h")
    # the first place of a line within its own text; narrow rows, and only of lines that occur more than once
    own = hits.groupBy("doc_id", "th", "h").agg(
        F.collect_set("pos").alias("at"), F.first("first_doc").alias("f"), F.first("near").alias("near")
    )
    all_go = F.col("near") | (F.col("f") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("f").isNotNull())
    at = F.array_sort("at")
    gone = F.when(all_go, at).otherwise(F.slice(at, F.lit(2), F.size(at)))
    out = materialize(
        own.select("doc_id", "th", F.explode(gone).alias("pos"))
        .groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("dropped")),
        "dropped",
    )
    for done in (rows, near, marked):  # only the places are needed from here on
        release(done)
    return out


def _without(lines: Column, dropped: Column) -> Column:
    """The lines between the dropped places, joined: linear in their number."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    ends = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, ``text`` without the dropped lines, and a struct ``__lines(n, dropped)``.

    Null and empty texts stay as they are. Lines below ``MIN_WORDS`` words, blank ones included, always stay. A row
    with a null doc_id comes after all others; several such rows don't drop each other's lines. Rows that repeat a
    doc_id don't drop each other's lines either, as neither is earlier. Other columns may have any name.
    """
    narrow = docs.select("doc_id", "text")
    gone = dropped_lines(narrow).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "dropped")
    rows = docs.select(packed(docs), F.xxhash64("text").alias("__h"))
    joined = rows.join(gone, F.col("__row.doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")), "left")
    lines = _lines(F.col("__row.text"))
    text = F.when(F.col("dropped").isNull(), F.col("__row.text")).otherwise(F.array_join(_without(lines, F.col("dropped")), "\n"))
    stats = F.struct(F.size(lines).alias("n"), F.coalesce(F.size("dropped"), F.lit(0)).alias("dropped")).alias("__lines")
    return joined.select(F.col("__row").withField("text", text).alias("__row"), stats).select("__row.*", "__lines")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("__lines.n").cast("long").alias("n_lines"),
        F.greatest("__lines.dropped", F.lit(0)).cast("long").alias("n_dropped"), "text",
    )


def line_sql(table: str = "documents") -> str:
    """DuckDB: the same decisions, with words compared as strings; ends in ``deduped(rid, n_lines, n_dropped, new_text)``."""
    return rf"""docs_r AS (SELECT *, row_number() OVER () AS rid FROM {table}),
l AS (SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM docs_r),
lw AS (SELECT *, list_filter(string_split_regex(lower(line), '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS w FROM l),
lk AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS h FROM lw),
ok AS (SELECT * FROM lk WHERE n >= {MIN_WORDS}),
o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, pos) AS turn FROM ok),
cls AS (SELECT h, w, n, doc_id AS fd, pos AS fp FROM o WHERE turn = 1),
var AS (SELECT h, n, fd, fp, i, array_to_string(list_concat(w[:i-1], w[i+1:]), ' ') AS v FROM
  (SELECT *, unnest(range(1, n + 1)) AS i FROM cls WHERE n >= {NEAR_WORDS})),
sw AS (SELECT h, row_number() OVER (PARTITION BY v, i, n ORDER BY fd NULLS LAST, fp, h) AS r FROM var),
ins AS (SELECT var.h AS lh, cls.h AS sh, coalesce(cls.fd < var.fd, cls.fd IS NOT NULL AND var.fd IS NULL) OR (cls.fd IS NOT DISTINCT FROM var.fd AND cls.fp < var.fp) AS short_first FROM var JOIN cls
  ON var.v = cls.h AND cls.n >= {NEAR_WORDS}),
near AS (SELECT h FROM sw WHERE r > 1 UNION SELECT lh FROM ins WHERE short_first UNION SELECT sh FROM ins WHERE NOT short_first),
seen AS (SELECT ok.rid, ok.pos, ok.h, cls.fd, ok.doc_id,
  row_number() OVER (PARTITION BY ok.rid, ok.h ORDER BY ok.pos) AS k,
  ok.h IN (SELECT h FROM near) AS near FROM ok JOIN cls ON ok.h = cls.h),
gone AS (SELECT rid, pos FROM seen WHERE near OR k > 1 OR fd < doc_id OR (doc_id IS NULL AND fd IS NOT NULL)),
kept AS (SELECT l.rid, count(*)::BIGINT AS n_lines, count(gone.pos)::BIGINT AS n_dropped,
  string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS t
  FROM l LEFT JOIN gone ON l.rid = gone.rid AND l.pos = gone.pos GROUP BY l.rid),
deduped AS (SELECT docs_r.*, n_lines, n_dropped,
  CASE WHEN n_dropped = 0 THEN text ELSE coalesce(t, '') END AS new_text FROM docs_r JOIN kept USING (rid))"""


OP9_SQL = f"WITH {line_sql()} SELECT doc_id, n_lines, n_dropped, new_text AS text FROM deduped"
