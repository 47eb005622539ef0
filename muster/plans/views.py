"""Deterministic triage tables over the given ones, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.config import INCIDENT_TYPES
from muster.functions.scalars import norm_place

_TYPES = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(INCIDENT_TYPES))

VIEWS: dict[str, str] = {
    "report": """SELECT 'rep-' || lpad(cast(e.event_id AS string), 8, '0') AS report_id, cast(e.ts AS timestamp) AS reported_at,
  d.text AS text, v.embedding AS embedding,
  CASE e.event_type WHEN 'error' THEN 'simulator' WHEN 'click' THEN 'dataset' WHEN 'view' THEN 'other' ELSE 'manual' END AS source,
  e.event_type = 'error' AS is_synthetic,
  CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE 'caller-' || cast(e.user_id AS string) END AS caller_id,
  CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE cast(2020000 + (e.event_id * 37 % 400) * 10 AS double) / 100000 END AS latitude,
  CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE cast(8580000 + (e.event_id * 53 % 400) * 10 AS double) / 100000 END AS longitude,
  CASE WHEN e.event_id % 5 = 0 THEN NULL WHEN e.event_id % 5 <= 2 THEN r.r_name
    ELSE r.r_name || ' NATION_' || cast(e.user_id % 25 AS string) END AS location_text,
  CASE WHEN e.event_id % 6 = 0 THEN NULL ELSE cast(e.event_id % 9 AS int) END AS people_count,
  CASE WHEN e.value >= 120 THEN 'CRITICAL' WHEN e.value >= 60 THEN 'HIGH' WHEN e.value >= 20 THEN 'MEDIUM'
    WHEN e.value >= 2 THEN 'LOW' END AS urgency,
  e.event_id, e.user_id, e.value, d.doc_id
FROM (SELECT x.*, x.event_id % dn.n AS doc_key, (x.user_id * 7 + x.event_id % 3) % vn.n AS vec_key FROM {events} x
  CROSS JOIN (SELECT count(*) AS n FROM {documents}) dn CROSS JOIN (SELECT count(*) AS n FROM {embeddings}) vn) e
JOIN {documents} d ON d.doc_id = e.doc_key
JOIN {embeddings} v ON v.vec_id = e.vec_key
JOIN {region} r ON r.r_regionkey = e.user_id % 5""",
    "incident": f"""SELECT 'inc-' || cast(o_orderkey AS string) AS incident_id,
  CASE WHEN o_orderkey % 10 = 0 THEN 'RESOLVED' WHEN o_orderkey % 10 = 1 THEN 'VERIFIED' WHEN o_orderkey % 10 = 2 THEN 'ESCALATED'
    WHEN o_orderkey % 10 <= 4 THEN 'NEEDS_REVIEW' WHEN o_orderkey % 10 = 5 THEN 'FALSE_REPORT' ELSE 'ACTIVE' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' END AS urgency,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderkey % 8 AS int) END AS people_at_risk_count,
  cast(1 + o_orderkey % 7 AS int) AS independent_source_count,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE cast(o_orderkey % 101 AS double) / 100 END AS confidence,
  o_orderkey % 5 = 0 AS is_synthetic, cast(o_orderdate AS timestamp) AS created_at,
  CASE o_orderkey % 10 {_TYPES} END AS incident_type,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(2020000 + (o_orderkey * 41 % 400) * 10 AS double) / 100000 END AS latitude,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(8580000 + (o_orderkey * 59 % 400) * 10 AS double) / 100000 END AS longitude,
  o_orderkey % 11 = 0 AS overridden, o_orderkey, o_custkey FROM {{orders}}""",
    "link": """SELECT g.link_id, g.incident_id, g.report_id, g.fused_at, g.source,
  CASE WHEN g.k = 1 THEN 'INITIAL' WHEN g.flag = 'A' THEN 'DUPLICATE' WHEN g.flag = 'N' THEN 'CORROBORATING' ELSE 'RELATED' END AS relationship_type,
  CASE WHEN g.k = 1 THEN NULL ELSE cast(70 + (g.l_orderkey * 7 + g.l_linenumber) % 31 AS double) / 100 END AS similarity_score
FROM (SELECT l_orderkey, l_linenumber, 'lnk-' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) AS link_id,
  'inc-' || cast(l_orderkey AS string) AS incident_id,
  'rep-' || lpad(cast((l_orderkey * 7 + l_linenumber) % 12000 AS string), 8, '0') AS report_id,
  cast(min(l_shipdate) AS timestamp) AS fused_at, min(l_suppkey) AS source, min(l_returnflag) AS flag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_shipdate), l_linenumber) AS k
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) g""",
    "calc": """SELECT 'calc-' || lpad(cast(event_id AS string), 8, '0') AS calc_id, 'inc-' || cast(user_id AS string) AS incident_id,
  cast(ts AS timestamp) AS calculated_at, least(value, 100.0) AS priority_score,
  CASE WHEN value >= 80 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' WHEN value >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS priority_level,
  'scored ' || event_type AS explanation FROM {events}""",
    "audit": """SELECT 'ovr-' || cast(o_orderkey AS string) AS override_id, 'inc-' || cast(o_orderkey AS string) AS incident_id,
  'op-' || cast(o_custkey % 12 AS string) AS operator_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'urgency' ELSE 'priority_score' END AS field,
  o_orderstatus AS previous_value, o_orderpriority AS new_value, 'reason ' || cast(o_custkey AS string) AS reason,
  cast(o_orderdate AS timestamp) AS created_at FROM {orders} WHERE o_orderkey % 13 = 0""",
    "pred": """SELECT 'rep-' || lpad(cast(event_id AS string), 8, '0') AS report_id,
  CASE WHEN event_id % 17 = 0 THEN 'FAILED' WHEN event_id % 11 = 0 THEN 'PARTIAL' WHEN event_id % 7 = 0 THEN 'NEEDS_REVIEW' ELSE 'SUCCESS' END AS processing_status,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE cast(event_id % 97 AS double) / 96 END AS type_confidence,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE cast(event_id % 89 AS double) / 88 END AS urgency_confidence,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE cast(event_id % 83 AS double) / 82 END AS location_confidence,
  'model-' || event_type AS model_version, value, event_id FROM {events}""",
    "label": """SELECT d.doc_id, l.quality AS y_true, cast(d.doc_id * 17 % 101 AS double) / 100 AS score, d.doc_id % 37 AS true_group,
  d.doc_id % 37 + CASE WHEN d.doc_id % 11 = 0 THEN 1 ELSE 0 END AS pred_group,
  CASE d.doc_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS true_urgency,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL WHEN d.doc_id % 5 = 0 THEN 'HIGH' WHEN d.doc_id % 4 = 0 THEN 'CRITICAL' WHEN d.doc_id % 4 = 1 THEN 'HIGH'
    WHEN d.doc_id % 4 = 2 THEN 'MEDIUM' ELSE 'LOW' END AS pred_urgency,
  CASE d.doc_id % 3 WHEN 0 THEN 'DUPLICATE' WHEN 1 THEN 'CORROBORATING' ELSE 'NOISE' END AS true_relation,
  CASE WHEN d.doc_id % 7 = 0 THEN 'DUPLICATE' WHEN d.doc_id % 3 = 0 THEN 'DUPLICATE' WHEN d.doc_id % 3 = 1 THEN 'CORROBORATING' ELSE 'INITIAL' END AS pred_relation,
  d.lang, d.source FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    "latency": "SELECT event_id, event_type, value AS ms FROM {events}",
    "feed": """SELECT event_id, cast(ts AS timestamp) AS event_at, 'inc-' || cast(user_id AS string) AS incident_id,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'INCIDENT_CREATED' WHEN event_type = 'error' THEN 'STATUS_CHANGED' ELSE 'INCIDENT_UPDATED' END AS event,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS score,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'VERIFIED' ELSE 'ACTIVE' END AS status FROM {events}""",
}
TABLES = ("region", "customer", "orders", "lineitem", "events", "documents", "embeddings", "labels", "pages", "part", "supplier", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def short_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report view with a digest in place of each text's normal form, for queries that only compare texts.

    Texts are read and hashed once a document, not once a report, and the reports' rows are narrow. Digests are equal where
    the normal forms are, and null where these are.
    """
    norm = norm_place(F.col("text"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.when(norm.isNotNull(), F.hex(F.xxhash64(norm))).alias("text"))
    text = VIEWS["report"]
    return spark.sql(text, **{t: texts if t == "documents" else table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def duck(sql: str) -> str:
    """``sql`` with the views it names put before it."""
    import re

    ctes = [f"{n} AS ({v.format(**{t: t for t in TABLES})})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    return f"WITH {', '.join(ctes)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(ctes)} {body}"
