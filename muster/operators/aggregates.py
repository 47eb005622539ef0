"""Counts, roll-ups and profiles; every one is a partial and a final hash aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.config import DEFAULT, PRECISIONS, RESPONSES, URGENCIES, Config
from muster.functions import scalars as S


def queue_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("priority_level") == "CRITICAL").alias("critical"))


def bucket_counts(df: DataFrame) -> DataFrame:
    """Exclusive buckets: review first, then the level."""
    bucket = F.when(F.col("status") == "NEEDS_REVIEW", "NEEDS_REVIEW").otherwise(F.col("priority_level"))
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def feed_counts(feed: DataFrame) -> DataFrame:
    category = F.when(F.col("event").startswith("INCIDENT"), "INCIDENT").otherwise("STATUS")
    return feed.groupBy("event", category.alias("category")).agg(F.count("*").alias("n"))


def run_counts(tables: dict[str, tuple[DataFrame, str]], prefix: str) -> DataFrame:
    """Rows of each table whose id starts with the run's prefix, and how many ids they have."""
    parts = [
        df.where(F.col(key).startswith(prefix)).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_ids"))
        .select(F.lit(name).alias("table_name"), "n", "n_ids")
        for name, (df, key) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rollup(links: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    out = links.groupBy("incident_id").agg(
        F.count("*").alias("report_count"),
        (1 + F.count_if(F.col("relationship_type") == "CORROBORATING")).cast("int").alias("independent_source_count"),
        F.min("fused_at").alias("first_at"),
        F.max("fused_at").alias("last_at"),
    )
    return out.withColumn("corroboration_score", S.corroboration(F.col("independent_source_count"), cfg))


def rank_in(col: Column, order: tuple[str, ...]) -> Column:
    """Place in a fixed order, from 1; 0 for others and null."""
    return F.array_position(F.array(*map(F.lit, order)), F.coalesce(col, F.lit(""))).cast("int")


def fuse_fields(fused: DataFrame) -> DataFrame:
    """Fields of an incident from its reports in fusion order (``seq``): the worst urgency, most people, first type, the
    place, all responses in canonical order.

    The place follows the fold of ``fusion.fuse_pair``: the first report gives it; after it only reports with both
    coordinates count, first the earliest of them, then the earliest of each better precision, so the earliest of the best
    stays. If the first report has coordinates, a later one must beat its precision. The text is that of the last report
    in this chain that had one, else the first report's.
    """
    urgent, precise = rank_in(F.col("urgency"), URGENCIES), F.greatest(F.lit(1), rank_in(F.upper("location_precision"), PRECISIONS))
    typed = F.when(F.col("incident_type").isNotNull(), F.col("seq"))
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    spot = F.struct("seq", "latitude", "longitude", "location_precision", "location_text")
    steps = [F.min(F.when(placed & (precise == k), spot)).alias(f"s{k}") for k in (1, 2, 3)]  # the earliest located report of each precision
    whole = fused.groupBy("incident_id").agg(
        F.max(urgent).alias("u"),
        F.max("people_count").alias("people_at_risk_count"),
        F.min_by("incident_type", typed).alias("incident_type"),
        (F.count_distinct("incident_type") > 1).alias("type_conflict"),
        F.min(spot).alias("first"), *steps,
    )
    # responses are few distinct values: they meet as such, not as one list a report
    responses = fused.select("incident_id", F.explode("responses").alias("r")).groupBy("incident_id").agg(F.collect_set("r").alias("r"))
    # a precision's earliest report takes part if no earlier or equal one was as precise: its place in the chain
    chain = F.array_compact(F.array(
        F.when(_earlier("s1", "s2", "s3"), F.col("s1")), F.when(_earlier("s2", "s3"), F.col("s2")), F.col("s3"),
    ))
    out = whole.join(responses, "incident_id", "left").withColumn("chain", chain)
    last = F.element_at(F.col("chain"), F.lit(-1))
    texts = F.filter(F.transform("chain", lambda x: x["location_text"]), lambda t: t.isNotNull())
    urgency = F.when(F.col("u") > 0, F.element_at(F.array(*map(F.lit, URGENCIES)), F.greatest("u", F.lit(1))))
    spots = F.size("chain") > 0
    return out.select(
        "incident_id", urgency.alias("urgency"), "people_at_risk_count", "incident_type", "type_conflict",
        F.coalesce(F.get(texts, F.size(texts) - 1), F.col("first.location_text")).alias("location_text"),
        F.when(spots, last["latitude"]).otherwise(F.col("first.latitude")).alias("latitude"),
        F.when(spots, last["longitude"]).otherwise(F.col("first.longitude")).alias("longitude"),
        F.when(spots, last["location_precision"]).otherwise(F.col("first.location_precision")).alias("location_precision"),
        canonical_responses(F.coalesce("r", F.array().cast("array<string>"))).alias("responses"),
    )


def _earlier(own: str, *better: str) -> Column:
    """``own`` is there and comes before all of ``better`` that are."""
    here = F.col(own).isNotNull()
    for b in better:
        here = here & F.coalesce(F.col(f"{own}.seq") < F.col(f"{b}.seq"), F.lit(True))
    return here


def canonical_responses(responses: Column) -> Column:
    known = F.filter(F.array(*map(F.lit, RESPONSES)), lambda r: F.array_contains(responses, r))
    rest = F.array_sort(F.filter(responses, lambda r: ~r.isin(*RESPONSES)))
    return F.concat(known, rest)


def mean_confidence(*parts: Column) -> Column:
    """Mean of the parts that are not null; null if none is."""
    some = F.filter(F.array(*parts), lambda x: x.isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(some) > 0, total / F.size(some))


def harmonic_confidence(parts: list[Column], cfg: Config = DEFAULT) -> Column:
    """Weighted harmonic mean of what is there: a zero gives zero, nothing gives null."""
    pairs = list(zip(parts, cfg.confidence_weights))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in pairs), F.lit(0.0))
    inverse = sum((F.coalesce(w / c, F.lit(0.0)) for c, w in pairs), F.lit(0.0))
    zero = F.lit(False)
    for c, _ in pairs:
        zero = zero | F.coalesce(c <= 0, F.lit(False))
    return F.when(weight == 0, None).when(zero, 0.0).otherwise(F.round(weight / inverse, 4))


def vector_contract(df: DataFrame, col: str, dim: int) -> DataFrame:
    v = F.col(col)
    why = S.bad_vector(v, dim)
    norm = F.when(why.isNull(), F.sqrt(S._dot(v, v)))
    return df.select(why.alias("why"), norm.alias("norm")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("why") == "MISSING").alias("missing"),
        F.count_if(F.col("why") == "WRONG_DIMENSION").alias("wrong_dimension"),
        F.count_if(F.col("why") == "NOT_FINITE").alias("not_finite"),
        F.round(F.min("norm"), 4).alias("norm_min"),
        F.round(F.avg("norm"), 4).alias("norm_mean"),
        F.round(F.max("norm"), 4).alias("norm_max"),
    )


PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def latency_profile(df: DataFrame, by: str, col: str) -> DataFrame:
    """Nearest-rank percentiles with mean and extremes, per key."""
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})").alias(f"p{int(p * 100)}") for p in PERCENTILES]
    return df.groupBy(by).agg(
        F.count(col).alias("n"), *ranks, F.round(F.avg(col), 4).alias("mean"), F.min(col).alias("low"), F.max(col).alias("high"),
        (F.count(col) > 0).alias("is_measured"),
    )


def latency_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Linear percentiles, population deviation and rows a second."""
    return df.groupBy(by).agg(
        *[F.round(F.percentile(col, p), 4).alias(f"p{int(p * 100)}") for p in PERCENTILES],
        F.round(F.stddev_pop(col), 4).alias("std"),
        F.round(F.count(col) * 1000.0 / F.sum(col), 4).alias("per_second"),
    )


def cold_warm(df: DataFrame, by: str, order: str, col: str) -> DataFrame:
    """The first call of each key apart from the rest."""
    first = df.groupBy(by).agg(F.min(order).alias("_first"))
    flagged = df.join(first, by).withColumn("phase", F.when(F.col(order) == F.col("_first"), "cold").otherwise("warm"))
    return flagged.groupBy(by, "phase").agg(F.count("*").alias("n"), F.round(F.avg(col), 4).alias("mean"), F.max(col).alias("high"))


def group_severity(df: DataFrame) -> DataFrame:
    """Worst urgency of each true group, and the best score that any of its predicted groups reaches."""
    best = df.groupBy("pred_group").agg(F.max("score").alias("best"))
    pairs = df.groupBy("true_group", "pred_group").agg(F.max(rank_in(F.col("true_urgency"), URGENCIES)).alias("u"))
    return pairs.join(best, "pred_group").groupBy("true_group").agg(F.max("u").alias("severity"), F.max("best").alias("best_score"))


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("processing_status").agg(F.count("*").alias("n"))


def multi_report_groups(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n >= 2")


def pulse_counts(df: DataFrame, ts: str, width: str = "1 hour") -> DataFrame:
    """Arrivals in each pulse and the running total; the window runs over pulses, not over rows."""
    n = df.groupBy(F.window(ts, width).getField("start").alias("pulse")).agg(F.count("*").alias("injected"))
    return n.withColumn("total", F.sum("injected").over(Window.orderBy("pulse").rowsBetween(Window.unboundedPreceding, 0)))


def health_ratios(preds: DataFrame, links: DataFrame, audits: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    a = preds.agg(
        share(F.col("type_confidence") >= cfg.review_confidence).alias("confident"),
        share(F.col("processing_status") == "FAILED").alias("fallback"),
        share(F.col("processing_status") == "NEEDS_REVIEW").alias("review"),
    )
    b = links.agg(share(F.col("relationship_type") == "DUPLICATE").alias("duplicate"), F.count_distinct("incident_id").alias("incidents"))
    c = audits.agg(F.count("*").alias("overrides"))
    one = a.crossJoin(b).crossJoin(c)  # one row each
    return one.withColumn("overrides_per_incident", F.round(F.col("overrides") / F.col("incidents"), 4)).drop("incidents", "overrides")
