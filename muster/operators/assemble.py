"""Equi, semi, anti, as-of and theta joins that put incidents, links, ledgers and predictions together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.queue import latest_per


def source_reports(links: DataFrame, reports: DataFrame) -> DataFrame:
    w = Window.partitionBy("incident_id").orderBy("fused_at", "link_id")
    return links.withColumn("seq", F.row_number().over(w)).join(reports, "report_id").select("incident_id", "seq", "report_id", "reported_at", "urgency")


def latest_prediction(links: DataFrame, preds: DataFrame) -> DataFrame:
    """The prediction of each incident's last fused report that has one."""
    return latest_per(links.select("incident_id", "report_id", "fused_at", "link_id").join(preds, "report_id"), "incident_id", "fused_at", "link_id")


def assemble(incidents: DataFrame, links: DataFrame, calcs: DataFrame, preds: DataFrame) -> DataFrame:
    """The full view of an incident; each side is reduced to one row an incident before it joins."""
    per = links.groupBy("incident_id").agg(F.count("*").alias("report_count"), F.array_sort(F.collect_set("report_id")).alias("report_ids"))
    calc = latest_per(calcs, "incident_id", "calculated_at", "calc_id").select("incident_id", "priority_score", "priority_level", "explanation")
    pred = latest_prediction(links, preds).select("incident_id", "type_confidence", "urgency_confidence", "location_confidence")
    out = incidents.join(per, "incident_id", "left").join(calc, "incident_id", "left").join(pred, "incident_id", "left")
    return out.select(
        "incident_id", "status", F.coalesce("report_count", F.lit(0)).alias("report_count"),
        F.coalesce("report_ids", F.array().cast("array<string>")).alias("report_ids"),
        F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"), F.coalesce("priority_level", F.lit("LOW")).alias("priority_level"),
        F.coalesce("explanation", F.lit("Not scored yet.")).alias("explanation"), "type_confidence", "urgency_confidence", "location_confidence",
    )


def incident_detail(view: DataFrame, links: DataFrame, reports: DataFrame, audits: DataFrame) -> DataFrame:
    """The view with its reports in fusion order and its audit trail, newest first."""
    src = source_reports(links, reports).groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("seq", "report_id", "reported_at"))).alias("reports"))
    trail = audits.groupBy("incident_id").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "override_id", "operator_id", "field", "reason")))).alias("audit_trail")
    )
    return view.join(src, "incident_id", "left").join(trail, "incident_id", "left")


def incidents_of_run(incidents: DataFrame, links: DataFrame, reports: DataFrame, prefix: str) -> DataFrame:
    mine = links.join(reports.where(F.col("report_id").startswith(prefix)), "report_id", "left_semi")
    return incidents.join(mine, "incident_id", "left_semi")


def orphans(links: DataFrame, incidents: DataFrame) -> DataFrame:
    return links.join(incidents, "incident_id", "left_anti")


def pending(reports: DataFrame, links: DataFrame) -> DataFrame:
    return reports.join(links, "report_id", "left_anti")


def missing(sent: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return sent.select(key).join(stored, key, "left_anti")


def with_labels(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Every label with its prediction; a missing one gets defaults and counts as invalid."""
    return labels.join(preds, "doc_id", "left").select(
        "doc_id", "y_true", F.coalesce("y_pred", F.lit(-1)).alias("y_pred"), F.coalesce("p", F.lit(0.0)).alias("p"), F.col("y_pred").isNotNull().alias("valid")
    )


def priority_as_of(probes: DataFrame, ledger: DataFrame) -> DataFrame:
    """``probes(incident_id, at, probe_id)`` with the last score at or before ``at``: a union and one running window."""
    marks = ledger.select("incident_id", F.col("calculated_at").alias("at"), F.lit(None).cast("string").alias("probe_id"), F.col("calc_id").alias("tie"), "priority_score")
    asks = probes.select("incident_id", "at", "probe_id", F.lit("~").alias("tie"), F.lit(None).cast("double").alias("priority_score"))
    w = Window.partitionBy("incident_id").orderBy("at", F.col("probe_id").isNotNull(), "tie").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asks).withColumn("score", F.last("priority_score", ignorenulls=True).over(w))
    return both.where("probe_id is not null").select("probe_id", "incident_id", "at", "score")


def timeline(links: DataFrame, calcs: DataFrame, audits: DataFrame) -> DataFrame:
    """One row an event of the three ledgers, typed and summarised; sorted by time and id."""
    a = links.select("incident_id", F.col("link_id").alias("event_id"), F.col("fused_at").alias("event_at"), F.lit("REPORT_FUSED").alias("event_type"),
                     F.concat(F.lit("Report "), "report_id", F.lit(" fused as "), "relationship_type").alias("summary"))
    b = calcs.select("incident_id", F.col("calc_id").alias("event_id"), F.col("calculated_at").alias("event_at"), F.lit("PRIORITY_CALCULATED").alias("event_type"),
                     F.concat(F.lit("Priority "), "priority_level").alias("summary"))
    c = audits.select("incident_id", F.col("override_id").alias("event_id"), F.col("created_at").alias("event_at"), F.lit("HUMAN_ACTION").alias("event_type"),
                      F.concat("operator_id", F.lit(" set "), "field", F.lit(" to "), "new_value").alias("summary"))
    return a.unionByName(b).unionByName(c).orderBy("incident_id", "event_at", "event_id")
