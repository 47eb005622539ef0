"""Queries over incidents, links, ledgers and feeds: queue, windows, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.functions import scalars as S
from muster.operators import aggregates as A
from muster.operators import queue as Q
from muster.plans.registry import query
from muster.plans.views import view

SCORE_SQL = """scored AS (SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM (SELECT *, CASE WHEN status = 'RESOLVED' THEN 0.0 ELSE round(greatest(0.0, least(100.0,
  round(u * 0.35, 2) + round(p * 0.3, 2) + round(c * 0.2, 2) + round(h * 0.15, 2)
  - CASE WHEN confidence < 0.5 THEN 10.0 ELSE 0.0 END
  + CASE status WHEN 'ESCALATED' THEN 15.0 WHEN 'VERIFIED' THEN 10.0 ELSE 0.0 END)), 2) END AS score
FROM (SELECT *, CASE urgency WHEN 'CRITICAL' THEN 100.0 WHEN 'HIGH' THEN 75.0 WHEN 'MEDIUM' THEN 40.0 WHEN 'LOW' THEN 15.0 ELSE 30.0 END::DOUBLE AS u,
  CASE WHEN people_at_risk_count > 0 THEN least(100.0, 40.0 + 12.0 * people_at_risk_count) ELSE 10.0 END::DOUBLE AS p,
  round(1.0 - exp(-0.45 * independent_source_count), 2) * 100.0 AS c,
  CASE incident_type WHEN 'STRUCTURAL_COLLAPSE' THEN 100.0 WHEN 'FIRE_WILDFIRE_EXPLOSION' THEN 90.0 WHEN 'FLOOD_FLASH_FLOOD' THEN 85.0
   WHEN 'CIVIL_UNREST_ACTIVE_THREAT' THEN 80.0 WHEN 'EARTHQUAKE_LANDSLIDE' THEN 75.0 WHEN 'MEDICAL_EMERGENCY' THEN 70.0
   WHEN 'UTILITY_INFRASTRUCTURE_FAILURE' THEN 45.0 ELSE 25.0 END::DOUBLE AS h FROM incident)))"""


def scored(spark, d):
    return Q.scored(view(spark, d, "incident")).withColumn("updated_at", F.col("created_at"))


@query("priority_queue", f"WITH {SCORE_SQL} SELECT incident_id, score AS priority_score, level AS priority_level, created_at AS updated_at FROM scored ORDER BY score DESC, created_at DESC, incident_id LIMIT 200")
def _(spark, d):
    return Q.queue_page(scored(spark, d), 200).select("incident_id", "priority_score", "priority_level", "updated_at")


@query("priority_score", f"WITH {SCORE_SQL} SELECT incident_id, score AS priority_score FROM scored")
def _(spark, d):
    return scored(spark, d).select("incident_id", "priority_score")


@query("priority_level", f"WITH {SCORE_SQL} SELECT level AS priority_level, count(*) AS n FROM scored GROUP BY level")
def _(spark, d):
    return scored(spark, d).groupBy("priority_level").agg(F.count("*").alias("n"))


@query("priority_factors", f"WITH {SCORE_SQL} SELECT incident_id, u, p, c, h FROM scored")
def _(spark, d):
    i = view(spark, d, "incident")
    return i.select(
        "incident_id", S.urgency_points(F.col("urgency")).alias("u"), S.people_points(F.col("people_at_risk_count")).alias("p"),
        S.corroboration_points(F.col("independent_source_count")).alias("c"), S.hazard_points(F.col("incident_type")).alias("h"),
    )


@query("queue_page", f"WITH {SCORE_SQL} SELECT incident_id, score AS priority_score FROM scored ORDER BY score DESC, created_at DESC, incident_id LIMIT 50 OFFSET 100")
def _(spark, d):
    return Q.queue_page(scored(spark, d), 50, 100).select("incident_id", "priority_score")


@query("queue_counts", f"WITH {SCORE_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE level = 'CRITICAL') AS critical FROM scored")
def _(spark, d):
    return A.queue_counts(scored(spark, d))


@query("bucket_counts", f"WITH {SCORE_SQL} SELECT CASE WHEN status = 'NEEDS_REVIEW' THEN status ELSE level END AS bucket, count(*) AS n FROM scored GROUP BY 1")
def _(spark, d):
    return A.bucket_counts(scored(spark, d))


@query("top_incident", f"WITH {SCORE_SQL} SELECT incident_id, score AS priority_score FROM scored ORDER BY score DESC, created_at DESC, incident_id LIMIT 1")
def _(spark, d):
    return Q.top_incident(scored(spark, d)).select("incident_id", "priority_score")


@query("rank1_check", f"WITH {SCORE_SQL}, b AS (SELECT max(score) FILTER (WHERE o_orderkey = 17) AS focal_score, max(score) FILTER (WHERE o_orderkey <> 17) AS best_other FROM scored) SELECT *, CASE WHEN focal_score IS NULL THEN 'MISSING' WHEN abs(focal_score - best_other) <= 0.01 THEN 'TIED' WHEN focal_score > best_other THEN 'FIRST' ELSE 'NOT_FIRST' END AS verdict FROM b")
def _(spark, d):
    return Q.rank1_check(scored(spark, d), F.col("o_orderkey") == 17)


@query("recent_feed", "SELECT event_id, incident_id, event, event_at FROM feed ORDER BY event_at DESC, event_id DESC LIMIT 50")
def _(spark, d):
    return Q.recent_feed(view(spark, d, "feed")).select("event_id", "incident_id", "event", "event_at")


@query("source_ids", "SELECT incident_id, list(report_id ORDER BY fused_at, report_id) AS report_ids FROM link GROUP BY incident_id")
def _(spark, d):
    return Q.source_ids(view(spark, d, "link"))


@query("running_corroboration", """SELECT link_id, independent_sources, round(1.0 - exp(-0.45 * independent_sources), 2) AS corroboration FROM (
 SELECT link_id, (1 + sum((relationship_type = 'CORROBORATING')::INT) OVER (PARTITION BY incident_id ORDER BY fused_at, link_id ROWS UNBOUNDED PRECEDING))::INT AS independent_sources FROM link)""")
def _(spark, d):
    return Q.running_corroboration(view(spark, d, "link")).select("link_id", "independent_sources", "corroboration")


@query("priority_delta", "SELECT calc_id, lag(priority_score) OVER w AS previous, round(priority_score - lag(priority_score) OVER w, 2) AS delta FROM calc WINDOW w AS (PARTITION BY incident_id ORDER BY calculated_at, calc_id)")
def _(spark, d):
    return Q.priority_delta(view(spark, d, "calc")).select("calc_id", "previous", "delta")


@query("latest_calc", "SELECT incident_id, calc_id, priority_score FROM calc QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY calculated_at DESC, calc_id DESC) = 1")
def _(spark, d):
    return Q.latest_per(view(spark, d, "calc"), "incident_id", "calculated_at", "calc_id").select("incident_id", "calc_id", "priority_score")


@query("avg_rank", "SELECT doc_id, (rank() OVER (ORDER BY score))::DOUBLE + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS avg_rank FROM label")
def _(spark, d):
    return Q.avg_rank(view(spark, d, "label").select("doc_id", "score"), "score").select("doc_id", "avg_rank")


@query("replay_offsets", "SELECT event_id, sum(event_id % 7 / 2.0) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS offset_seconds FROM latency")
def _(spark, d):
    e = view(spark, d, "latency").withColumn("delay", (F.col("event_id") % 7).cast("double"))
    return Q.replay_offsets(e, "event_type", "event_id", "delay", 2.0).select("event_id", "offset_seconds")


@query("activity_gaps", "SELECT report_id, round(abs(epoch_us(reported_at) - epoch_us(lag(reported_at) OVER w)) / 3600000000.0, 6) AS gap_hours FROM report WINDOW w AS (PARTITION BY user_id ORDER BY reported_at, report_id)")
def _(spark, d):
    return Q.activity_gaps(view(spark, d, "report"), "user_id", "reported_at", "report_id").select("report_id", "gap_hours")


@query("feed_counts", "SELECT event, CASE WHEN event LIKE 'INCIDENT%' THEN 'INCIDENT' ELSE 'STATUS' END AS category, count(*) AS n FROM feed GROUP BY ALL")
def _(spark, d):
    return A.feed_counts(view(spark, d, "feed"))


@query("run_counts", """SELECT 'link' AS table_name, count(*) AS n, count(DISTINCT incident_id) AS n_ids FROM link WHERE incident_id LIKE 'inc-1%' UNION ALL
 SELECT 'calc', count(*), count(DISTINCT incident_id) FROM calc WHERE incident_id LIKE 'inc-1%' UNION ALL
 SELECT 'audit', count(*), count(DISTINCT incident_id) FROM audit WHERE incident_id LIKE 'inc-1%' UNION ALL
 SELECT 'incident', count(*), count(DISTINCT incident_id) FROM incident WHERE incident_id LIKE 'inc-1%'""")
def _(spark, d):
    return A.run_counts({k: (view(spark, d, k), "incident_id") for k in ("link", "calc", "audit", "incident")}, "inc-1")


@query("incident_rollup", """SELECT incident_id, report_count, independent_source_count, first_at, last_at, round(1.0 - exp(-0.45 * independent_source_count), 2) AS corroboration_score FROM (
 SELECT incident_id, count(*) AS report_count, (1 + count(*) FILTER (WHERE relationship_type = 'CORROBORATING'))::INT AS independent_source_count,
 min(fused_at) AS first_at, max(fused_at) AS last_at FROM link GROUP BY incident_id)""")
def _(spark, d):
    return A.rollup(view(spark, d, "link"))


@query("corroboration", "SELECT DISTINCT independent_source_count AS n, round(1.0 - exp(-0.45 * independent_source_count), 2) AS corroboration FROM incident")
def _(spark, d):
    n = view(spark, d, "incident").select(F.col("independent_source_count").alias("n")).distinct()
    return n.withColumn("corroboration", S.corroboration(F.col("n")))


@query("vector_contract", "SELECT count(*) AS total, 0::BIGINT AS missing, 0::BIGINT AS wrong_dimension, 0::BIGINT AS not_finite, round(min(n), 4) AS norm_min, round(avg(n), 4) AS norm_mean, round(max(n), 4) AS norm_max FROM (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def _(spark, d):
    from muster.plans.views import table

    return A.vector_contract(table(spark, d, "embeddings"), "embedding", 64)


@query("latency_profile", "SELECT event_type, count(ms) AS n, " + ", ".join(f"quantile_disc(ms, {p}) AS p{int(p * 100)}" for p in A.PERCENTILES) + ", round(avg(ms), 4) AS mean, min(ms) AS low, max(ms) AS high, count(ms) > 0 AS is_measured FROM latency GROUP BY event_type")
def _(spark, d):
    return A.latency_profile(view(spark, d, "latency"), "event_type", "ms")


@query("latency_stats", "SELECT event_type, " + ", ".join(f"round(quantile_cont(ms, {p}), 4) AS p{int(p * 100)}" for p in A.PERCENTILES) + ", round(stddev_pop(ms), 4) AS std, round(count(ms) * 1000.0 / sum(ms), 4) AS per_second FROM latency GROUP BY event_type")
def _(spark, d):
    return A.latency_stats(view(spark, d, "latency"), "event_type", "ms")


@query("cold_warm", "SELECT event_type, CASE WHEN event_id = f THEN 'cold' ELSE 'warm' END AS phase, count(*) AS n, round(avg(ms), 4) AS mean, max(ms) AS high FROM (SELECT *, min(event_id) OVER (PARTITION BY event_type) AS f FROM latency) GROUP BY ALL")
def _(spark, d):
    return A.cold_warm(view(spark, d, "latency"), "event_type", "event_id", "ms")


@query("group_severity", """WITH b AS (SELECT pred_group, max(score) AS best FROM label GROUP BY 1)
SELECT true_group, max(CASE true_urgency WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)::INT AS severity, max(best) AS best_score FROM label JOIN b USING (pred_group) GROUP BY 1""")
def _(spark, d):
    return A.group_severity(view(spark, d, "label"))


@query("status_counts", "SELECT processing_status, count(*) AS n FROM pred GROUP BY 1")
def _(spark, d):
    return A.status_counts(view(spark, d, "pred"))


@query("multi_report_groups", "SELECT incident_id, count(*) AS n FROM link GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return A.multi_report_groups(view(spark, d, "link"), "incident_id")


@query("pulse_counts", "SELECT pulse, injected, (sum(injected) OVER (ORDER BY pulse ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM (SELECT date_trunc('hour', reported_at) AS pulse, count(*) AS injected FROM report GROUP BY 1)")
def _(spark, d):
    return A.pulse_counts(view(spark, d, "report"), "reported_at")


@query("health_ratios", """SELECT * FROM (SELECT round((count(*) FILTER (WHERE type_confidence >= 0.6)) / count(*), 4) AS confident, round((count(*) FILTER (WHERE processing_status = 'FAILED')) / count(*), 4) AS fallback,
 round((count(*) FILTER (WHERE processing_status = 'NEEDS_REVIEW')) / count(*), 4) AS review FROM pred),
 (SELECT round((count(*) FILTER (WHERE relationship_type = 'DUPLICATE')) / count(*), 4) AS duplicate FROM link),
 (SELECT round((SELECT count(*) FROM audit) / (SELECT count(DISTINCT incident_id) FROM link), 4) AS overrides_per_incident)""")
def _(spark, d):
    return A.health_ratios(view(spark, d, "pred"), view(spark, d, "link"), view(spark, d, "audit"))


@query("mean_confidence", """SELECT report_id, m AS confidence, coalesce(m < 0.6, false) AS low FROM (SELECT report_id,
 CASE WHEN n > 0 THEN (coalesce(type_confidence, 0) + coalesce(urgency_confidence, 0) + coalesce(location_confidence, 0)) / n END AS m FROM (
 SELECT *, (type_confidence IS NOT NULL)::INT + (urgency_confidence IS NOT NULL)::INT + (location_confidence IS NOT NULL)::INT AS n FROM pred))""")
def _(spark, d):
    m = A.mean_confidence(F.col("type_confidence"), F.col("urgency_confidence"), F.col("location_confidence"))
    out = view(spark, d, "pred").select("report_id", m.alias("confidence"))
    return out.withColumn("low", F.coalesce(F.col("confidence") < 0.6, F.lit(False)))


@query("harmonic_confidence", """SELECT report_id, CASE WHEN w = 0 THEN NULL WHEN z THEN 0.0 ELSE round(w / i, 4) END AS confidence FROM (SELECT report_id,
 CASE WHEN type_confidence IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN urgency_confidence IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN location_confidence IS NULL THEN 0 ELSE 0.2::DOUBLE END AS w,
 coalesce(type_confidence <= 0, false) OR coalesce(urgency_confidence <= 0, false) OR coalesce(location_confidence <= 0, false) AS z,
 coalesce(0.3::DOUBLE / nullif(type_confidence, 0), 0) + coalesce(0.25::DOUBLE / nullif(urgency_confidence, 0), 0) + coalesce(0.2::DOUBLE / nullif(location_confidence, 0), 0) AS i FROM pred)""")
def _(spark, d):
    parts = [F.nullif(F.col(c), F.lit(-1.0)) for c in ("type_confidence", "urgency_confidence", "location_confidence")]
    return view(spark, d, "pred").select("report_id", A.harmonic_confidence(parts).alias("confidence"))


FUSED = """fused AS (SELECT l.incident_id, l.link_id, r.urgency, r.people_count, r.location_text, r.latitude, r.longitude,
 CASE WHEN r.event_id % 7 = 0 THEN 'EXACT' WHEN r.event_id % 7 < 4 THEN 'APPROXIMATE' ELSE 'UNKNOWN' END AS location_precision,
 CASE r.event_id % 5 WHEN 0 THEN 'FLOOD_FLASH_FLOOD' WHEN 1 THEN 'MEDICAL_EMERGENCY' WHEN 2 THEN 'FIRE_WILDFIRE_EXPLOSION' END AS incident_type,
 r.event_id, row_number() OVER (PARTITION BY l.incident_id ORDER BY l.fused_at, l.link_id) AS seq
 FROM link l JOIN report r ON r.report_id = l.report_id)"""


def fused(spark, d):
    named = FUSED.replace("FROM link l", "FROM {link} l").replace("JOIN report r", "JOIN {report} r")
    df = spark.sql(f"WITH {named} SELECT * FROM fused", link=view(spark, d, "link"), report=view(spark, d, "report"))
    responses = F.array_compact(F.array(
        F.when(F.col("event_id") % 2 == 0, "MEDICAL_EMS"), F.when(F.col("event_id") % 3 == 0, "ANIMAL_CARE"),
        F.when(F.col("event_id") % 7 == 0, "SEARCH_AND_RESCUE"),
    ))
    return df.withColumn("responses", responses)


@query("fuse_fields", f"""WITH {FUSED}, r AS (SELECT incident_id, bool_or(event_id % 7 = 0) AS s, bool_or(event_id % 2 = 0) AS m, bool_or(event_id % 3 = 0) AS a,
 max(CASE urgency WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS u, max(people_count) AS people_at_risk_count,
 arg_min(incident_type, seq) FILTER (WHERE incident_type IS NOT NULL) AS incident_type, count(DISTINCT incident_type) > 1 AS type_conflict,
 arg_min({{'t': location_text, 'p': location_precision}}, seq) AS f FROM fused GROUP BY 1),
loc AS (SELECT *, CASE location_precision WHEN 'EXACT' THEN 3 WHEN 'APPROXIMATE' THEN 2 ELSE 1 END AS p FROM fused WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
rec AS (SELECT * FROM loc QUALIFY p > coalesce(max(p) OVER (PARTITION BY incident_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
z AS (SELECT incident_id, arg_max(latitude, seq) AS latitude, arg_max(longitude, seq) AS longitude, arg_max(location_precision, seq) AS location_precision,
 arg_max(location_text, seq) FILTER (WHERE location_text IS NOT NULL) AS location_text FROM rec GROUP BY 1)
SELECT incident_id, CASE WHEN u > 0 THEN ['LOW','MEDIUM','HIGH','CRITICAL'][u] END AS urgency, people_at_risk_count, incident_type, type_conflict,
 coalesce(z.location_text, f.t) AS location_text, latitude, longitude, coalesce(z.location_precision, f.p) AS location_precision,
 list_filter([CASE WHEN s THEN 'SEARCH_AND_RESCUE' END, CASE WHEN m THEN 'MEDICAL_EMS' END, CASE WHEN a THEN 'ANIMAL_CARE' END], lambda x: x IS NOT NULL) AS responses FROM r LEFT JOIN z USING (incident_id)""")
def _(spark, d):
    return A.fuse_fields(fused(spark, d))
