"""Fusion of reports to incidents: order-free components and the rules on one row; the replay one by one is in ``replay``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.config import DEFAULT, Config
from muster.functions import scalars as S
from muster.graph import connected_components
from muster.operators.aggregates import canonical_responses, rank_in
from muster.operators.replay import LINK_SCHEMA, Fuser, fuse_replay, region_block, replay_blocks, session_blocks  # noqa: F401


def fuse_components(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """Every report with the least report id of its component of matched pairs; deterministic and order-free."""
    edges = pairs.where("matched").select(F.col("a_report_id").alias("a"), F.col("b_report_id").alias("b"))
    return with_components(reports, connected_components(edges))


def with_components(reports: DataFrame, components: DataFrame) -> DataFrame:
    """Every report with its ``(node, component)``; one that is not among them is its own."""
    out = reports.select("report_id").join(components.withColumnRenamed("node", "report_id"), "report_id", "left")
    return out.select("report_id", F.coalesce("component", "report_id").alias("component"))


# -- rules on one row --------------------------------------------------------------------------------------------


def open_incident(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A new incident's status and counts from its first report's analysis."""
    doubtful = F.col("processing_status").isin("FAILED", "PARTIAL", "NEEDS_REVIEW") | F.coalesce(F.col("confidence") < cfg.review_confidence, F.lit(False))
    return df.select(
        F.concat(F.lit("inc-"), F.col("report_id")).alias("incident_id"),
        F.when(doubtful, "NEEDS_REVIEW").otherwise("ACTIVE").alias("status"),
        F.lit(1).alias("report_count"), F.lit(1).alias("independent_source_count"),
        S.corroboration(F.lit(1), cfg).alias("corroboration_score"),
    )


def route_review(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Status after a fuse: doubts go to review unless a human or a confirmed status stands."""
    doubt = (
        (F.col("relationship_type") == "UNCERTAIN") | F.col("processing_status").isin("FAILED", "PARTIAL")
        | F.coalesce(F.col("confidence") < cfg.review_confidence, F.lit(False)) | F.col("type_conflict") | F.col("location_conflict")
    )
    firm = F.col("status").isin("VERIFIED", "ESCALATED") | F.col("overridden")
    return df.withColumn("new_status", F.when(doubt & ~firm, "NEEDS_REVIEW").otherwise(F.col("status")))


def protect(df: DataFrame, fields: tuple[str, ...], override: str = "overridden") -> DataFrame:
    """An overridden incident keeps its own fields; otherwise the fused ones (``new_`` columns) apply."""
    return df.select(
        *[c for c in df.columns if c not in fields and not c.startswith("new_")],
        *[F.when(F.col(override), F.col(f)).otherwise(F.col(f"new_{f}")).alias(f) for f in fields],
    )


def recover_failed(preds: DataFrame) -> DataFrame:
    """Every failed analysis still opens an incident for review, at 50 and MEDIUM."""
    return preds.where("processing_status = 'FAILED'").select(
        F.concat(F.lit("inc-"), F.col("report_id")).alias("incident_id"), "report_id", F.lit("NEEDS_REVIEW").alias("status"),
        F.lit(50.0).alias("priority_score"), F.lit("MEDIUM").alias("priority_level"),
    )


def fuse_pair(df: DataFrame, conflict: str | None = None) -> DataFrame:
    """Fields of an incident (``i_``) and a report (``r_``) fused on one row.

    The place is refined only by a report with both coordinates: an incident without coordinates takes them, another one
    if the report is more precise. A report's missing place text leaves the incident's. ``conflict`` names a boolean column:
    where it holds, the incident keeps its place.
    """
    from muster.config import PRECISIONS, URGENCIES

    urgent = lambda c: rank_in(F.col(c), URGENCIES)
    precise = lambda c: F.greatest(F.lit(1), rank_in(F.upper(c), PRECISIONS))
    placed = lambda s: F.col(f"{s}_latitude").isNotNull() & F.col(f"{s}_longitude").isNotNull()
    better = placed("r") & (~placed("i") | (precise("r_location_precision") > precise("i_location_precision")))
    if conflict is not None:
        better = better & ~F.coalesce(F.col(conflict), F.lit(False))
    pick = lambda f: F.when(better, F.col(f"r_{f}")).otherwise(F.col(f"i_{f}")).alias(f)
    text = F.when(better, F.coalesce("r_location_text", "i_location_text")).otherwise(F.col("i_location_text")).alias("location_text")
    return df.withColumns({
        "urgency": F.when(urgent("r_urgency") > urgent("i_urgency"), F.col("r_urgency")).otherwise(F.coalesce("i_urgency", "r_urgency")),
        "people_count": F.greatest("i_people_count", "r_people_count"),
        "incident_type": F.coalesce("i_incident_type", "r_incident_type"),
        "type_conflict": F.coalesce(F.col("i_incident_type") != F.col("r_incident_type"), F.lit(False)),
    }).select("*", text, pick("latitude"), pick("longitude"), pick("location_precision"))


def fuse_responses(a: Column, b: Column) -> Column:
    return canonical_responses(F.array_union(a, b))


def fusion_outputs(links: DataFrame, reports: DataFrame, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """Link rows, incident states and ledger rows of a replay."""
    known = links.join(reports.select("report_id", "reported_at", "urgency", "people_count"), "report_id")
    stamped = known.withColumnRenamed("reported_at", "fused_at")
    from muster.operators.aggregates import rollup
    from muster.config import URGENCIES

    worst = stamped.groupBy("incident_id").agg(F.max(rank_in(F.col("urgency"), URGENCIES)).alias("u"), F.max("people_count").alias("people_at_risk_count"))
    urgency = F.when(F.col("u") > 0, F.element_at(F.array(*map(F.lit, URGENCIES)), F.greatest("u", F.lit(1))))
    states = rollup(stamped, cfg).join(worst.select("incident_id", urgency.alias("urgency"), "people_at_risk_count"), "incident_id")
    score = S.priority_score(
        S.urgency_points(F.col("urgency"), cfg), S.people_points(F.col("people_at_risk_count")),
        S.corroboration_points(F.col("independent_source_count"), cfg), F.lit(cfg.hazard_default), F.lit("ACTIVE"), F.lit(None).cast("double"), cfg,
    )
    ledger = states.select("incident_id", score.alias("priority_score"), F.col("last_at").alias("calculated_at"))
    ledger = ledger.withColumn("priority_level", S.priority_level(F.col("priority_score"), cfg))
    return {"links": stamped, "states": states, "ledger": ledger}
