"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.runtime import broadcast_if_small, materialize, packed

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def draw(doc_id: Column, text: Column, turn: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed, the id, the text's :func:`text_key` and the row's number among equal ones
    only: 52 bits of an MD5. Rows without an id, or that repeat one, thus draw apart."""
    parts = [F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), text, turn.cast("string")]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes(source, size)`` -> ``(source, source_size, target)``.

    Sources by code point, null last, weigh ``weights`` over and over. A target stops at ``cap`` times its source's
    size and the excess is shared anew by weight. Filling sources in the order of cap by weight makes that one pass:
    a source is capped exactly if its own ratio is at most the level that is left when all lower ratios are capped.
    The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = per.withColumn("w", weight).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    level = (
        F.sum("source_size").over(total).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / (F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    turn = F.row_number().over(by_ratio)
    rows = rows.withColumn("level", level).withColumn("at", turn)
    # the level at the first source that isn't capped there holds for it and all after it
    free = F.when(F.col("limit") > F.col("w") * F.col("level"), F.col("at"))
    rows = rows.withColumn("final", F.min_by("level", free).over(total))
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("w") * F.col("final")))
    return rows.select("source", "source_size", target.alias("target"))


def copies(source_size: Column, target: Column, u: Column) -> Column:
    """floor(rate) copies, plus one with the probability of the fraction."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _numbered(groups: DataFrame) -> DataFrame:
    """``groups`` with a count ``m`` -> one row for each ``turn`` of 1 to ``m``, in chunks, so that no long array is made."""
    chunk = 4096
    some = groups.withColumn("__a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / chunk))))
    upto = F.least(F.col("m"), (F.col("__a") + 1) * chunk)
    return some.withColumn("turn", F.explode(F.sequence(F.col("__a") * chunk + 1, upto))).drop("__a")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` for every row; narrow, no text moves.

    Null texts and texts without a word have size zero; null is a source of its own, last. A source whose size is
    zero has target zero. Rows that agree in id, text and source are counted map-side and numbered, and each draws
    for itself; which of them has which number makes no difference.
    """
    text = F.col("text")
    narrow = docs.select("doc_id", "source", text_key(text).alias("t"), text_size(text).alias("size"))
    rows = materialize(narrow.groupBy("doc_id", "source", "t", "size").agg(F.count("*").alias("m")), "sizes")
    sizes = rows.select("source", (F.col("size") * F.col("m")).alias("size"))
    targets = broadcast_if_small(materialize(source_targets(sizes, weights, cap), "targets"))
    own = targets.withColumnRenamed("source", "s")
    joined = rows.join(own, rows["source"].eqNullSafe(own["s"])).drop("s")
    u = draw(F.col("doc_id"), F.col("t"), F.col("turn"), seed)
    return _numbered(joined).withColumn("copies", copies(F.col("source_size"), F.col("target"), u)).drop("m", "t", "turn")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` with all its columns, as often as the plan says.

    Sizes are counted once for the targets; the rows are then repeated in place, without a shuffle when the sources
    fit a checked broadcast. Only rows that agree in id and text with another move, to be numbered. Extra columns may have
    any name.
    """
    text = F.col("text")
    narrow = materialize(docs.select("doc_id", "source", text_key(text).alias("t"), text_size(text).alias("size")), "sizes")
    targets = broadcast_if_small(materialize(source_targets(narrow.select("source", "size"), weights, cap), "targets"))
    again = materialize(narrow.groupBy("doc_id", "t").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias("__d"), F.col("t").alias("__k")), "equal-rows")
    own = targets.select(F.col("source").alias("__s"), F.col("source_size").alias("__n"), F.col("target").alias("__t"))
    rows = docs.select(packed(docs), text_key(text).alias("__h"))
    if again.limit(1).count():
        some = broadcast_if_small(again)
        same = F.col("__row.doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__k"))
        turn = F.row_number().over(Window.partitionBy(F.col("__row.doc_id"), "__h", F.col("__row.source")).orderBy("__h"))
        rows = rows.join(some, same, "left_anti").withColumn("__i", F.lit(1)).unionByName(rows.join(some, same, "left_semi").withColumn("__i", turn))
    else:
        rows = rows.withColumn("__i", F.lit(1))
    joined = rows.join(own, F.col("__row.source").eqNullSafe(F.col("__s")))
    n = copies(F.col("__n"), F.col("__t"), draw(F.col("__row.doc_id"), F.col("__h"), F.col("__i"), seed))
    taken = joined.withColumn("__c", n).where("__c > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__c").cast("int")))).select("__row.*")


def op7_mix(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mix_sql(table: str = "documents") -> str:
    """DuckDB: ``docs``-level plan as a chain of common table expressions ending in ``planned``."""
    weights = ", ".join(f"{w}.0" for w in WEIGHTS)
    return f"""sized AS (SELECT *, CASE WHEN text IS NULL THEN 0
    ELSE len(regexp_extract_all(text, '{WORDS}')) END::BIGINT AS size FROM {table}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([{weights}]::DOUBLE[])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w,
  (source_size * {CAP})::DOUBLE AS lim FROM per),
levels AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER b, 0)) /
  (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM weighed
  WINDOW b AS (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
finals AS (SELECT arg_min(level, lim / w) AS final FROM levels WHERE lim > w * level),
targets AS (SELECT source, source_size, least(lim, w * final) AS target FROM levels, finals),
rated AS (SELECT sized.*, source_size, target,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null') || ':' ||
    row_number() OVER (PARTITION BY doc_id, text, sized.source))[1:13])::BIGINT::DOUBLE / {float(1 << 52)!r} AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
planned AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)"""


OP7_SQL = f"""WITH {mix_sql()}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM planned"""
