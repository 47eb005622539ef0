"""Windows, sorts and top-k over incidents, ledgers and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.config import DEFAULT, Config
from muster.functions import scalars as S
from muster.runtime import running_sums


def latest_per(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def scored(incidents: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    points = (
        S.urgency_points(F.col("urgency"), cfg),
        S.people_points(F.col("people_at_risk_count")),
        S.corroboration_points(F.col("independent_source_count"), cfg),
        S.hazard_points(F.col("incident_type"), cfg),
    )
    out = incidents.withColumn("priority_score", S.priority_score(*points, F.col("status"), F.col("confidence"), cfg))
    return out.withColumn("priority_level", S.priority_level(F.col("priority_score"), cfg))


def queue_page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of the queue: score, then latest update, then id. The limit is the feature."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset 0 or more")
    return df.orderBy(F.desc("priority_score"), F.desc("updated_at"), "incident_id").offset(offset).limit(limit)


def top_incident(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("priority_score"), F.coalesce("updated_at", "created_at").desc(), "incident_id").limit(1)


def recent_feed(df: DataFrame, n: int = 50) -> DataFrame:
    return df.orderBy(F.desc("event_at"), F.desc("event_id")).limit(n)


def source_ids(links: DataFrame) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("fused_at", "report_id")))
    return links.groupBy("incident_id").agg(F.transform(order, lambda x: x["report_id"]).alias("report_ids"))


def running_corroboration(links: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    w = Window.partitionBy("incident_id").orderBy("fused_at", "link_id").rowsBetween(Window.unboundedPreceding, 0)
    n = 1 + F.sum(F.when(F.col("relationship_type") == "CORROBORATING", 1).otherwise(0)).over(w)
    return links.withColumn("independent_sources", n.cast("int")).withColumn(
        "corroboration", S.corroboration(F.col("independent_sources"), cfg)
    )


def priority_delta(ledger: DataFrame) -> DataFrame:
    w = Window.partitionBy("incident_id").orderBy("calculated_at", "calc_id")
    before = F.lag("priority_score").over(w)
    return ledger.withColumn("previous", before).withColumn("delta", F.round(F.col("priority_score") - before, 2))


def avg_rank(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Average ranks with ties, NaN last: from counts per value, summed up along ranges of values."""
    counts = df.groupBy(*by, col).agg(F.count("*").alias("_n"))
    ranks = running_sums(counts, [F.col(col).asc_nulls_last()], ["_n"], by).withColumn("avg_rank", F.col("upto__n") - (F.col("_n") - 1) / 2.0)
    renamed = ranks.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, col)], "avg_rank")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*by, col)]
    return df.join(renamed, same).drop(*[f"_k_{c}" for c in (*by, col)])


def rank1_check(df: DataFrame, focal: Column, tolerance: float = 0.01) -> DataFrame:
    """Is the focal row's score the highest, alone or tied within the tolerance?"""
    best = df.agg(
        F.max(F.when(focal, F.col("priority_score"))).alias("focal_score"),
        F.max(F.when(~focal, F.col("priority_score"))).alias("best_other"),
    )
    gap = F.col("focal_score") - F.col("best_other")
    verdict = F.when(F.col("focal_score").isNull(), "MISSING").when(F.abs(gap) <= tolerance, "TIED").when(gap > 0, "FIRST").otherwise("NOT_FIRST")
    return best.withColumn("verdict", verdict)


def top_classes(scores: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("report_id").orderBy(F.desc("score"), "class_rank")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def replay_offsets(df: DataFrame, by: str, order: str, delay: str, speed: float) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("offset_seconds", F.sum(F.col(delay) / speed).over(w))


def activity_gaps(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    return df.withColumn("gap_hours", F.round(S.hours_between(F.col(ts), before), 6))
