"""Queries over sources, validation, filters and timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import quality as V
from muster.plans.q_tables import SCORE_SQL, scored
from muster.plans.registry import query
from muster.plans.views import table, view
from muster.runtime import shared_dir
from muster.sources import readers as R

c = F.col


@query("corpus_union", "SELECT 'a' AS corpus, doc_id, text FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', doc_id, text FROM documents WHERE lang IS DISTINCT FROM 'en'")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return R.union_corpora(a=docs.where("lang = 'en'"), b=docs.where("lang is distinct from 'en'")).select("corpus", "doc_id", "text")


@query("lexicon_extend", "SELECT term, CASE WHEN a > 0 THEN 'AREA' ELSE 'NATION' END AS entity_type FROM (SELECT lower(n) AS term, sum(k) AS a FROM (SELECT r_name AS n, 1 AS k FROM region UNION ALL SELECT n_name, 0 FROM nation UNION ALL SELECT r_name, 0 FROM region) GROUP BY 1)")
def _(spark, d):
    r = table(spark, d, "region").select(c("r_name").alias("term"), F.lit("AREA").alias("entity_type"))
    n = table(spark, d, "nation").select(c("n_name").alias("term"), F.lit("NATION").alias("entity_type"))
    return R.extend_gazetteer(r, n.unionByName(r.withColumn("entity_type", F.lit("NATION")).withColumn("term", F.concat(F.lit(" "), "term"))))


@query("map_external_type", "SELECT event_id, CASE event_type WHEN 'error' THEN 'UTILITY_INFRASTRUCTURE_FAILURE' WHEN 'click' THEN 'FLOOD_FLASH_FLOOD' ELSE 'OTHER_GENERAL_INCIDENT' END AS incident_type FROM events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("name", F.when(c("event_type") == "error", " Outage").when(c("event_type") == "click", "FLOOD ").otherwise(c("event_type")))
    return R.map_external_type(e, "name").select("event_id", "incident_type")


def with_metadata(spark, d):
    return view(spark, d, "report").withColumn("metadata", F.create_map(
        F.lit("caller_id"), c("caller_id"), F.lit("secret_note"), F.lit("x"),
        F.when(c("event_id") % 50 == 0, "Expected-Label").otherwise("region"), F.when(c("event_id") % 70 == 0, "Hard Negative").otherwise(c("location_text")),
    ))


@query("export_public", "SELECT report_id, source, caller_id AS caller, CASE WHEN event_id % 50 <> 0 THEN CASE WHEN event_id % 70 = 0 THEN 'Hard Negative' ELSE location_text END END AS region, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 2 END AS n_keys FROM report")
def _(spark, d):
    out = R.public_rows(with_metadata(spark, d))
    return out.select("report_id", "source", c("metadata")["caller_id"].alias("caller"), c("metadata")["region"].alias("region"), F.size("metadata").alias("n_keys"))


@query("allow_metadata", "SELECT report_id, caller_id AS caller FROM report")
def _(spark, d):
    return with_metadata(spark, d).select("report_id", R.allow_metadata(c("metadata"), ("caller_id",))["caller_id"].alias("caller"))


@query("rows_as_json", """SELECT '{"override_id":"' || override_id || '","incident_id":"' || incident_id || '","operator_id":"' || operator_id || '","field":"' || field || '","previous_value":"' || previous_value || '","new_value":"' || new_value
 || '","reason":"' || reason || '","created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') || '"}' AS "row" FROM audit""")
def _(spark, d):
    return R.rows_as_json(view(spark, d, "audit"))


@query("change_feed", """WITH f AS (SELECT incident_id, event = 'INCIDENT_CREATED' AS fresh, coalesce(status, 'ACTIVE') AS st, event_at FROM feed),
e AS (SELECT *, CASE WHEN fresh THEN 'INCIDENT_CREATED' ELSE 'INCIDENT_UPDATED' END AS event FROM f UNION ALL SELECT *, 'STATUS_CHANGED' FROM f WHERE NOT fresh AND st <> 'ACTIVE')
SELECT event, '{"incident_id":"' || incident_id || '","status":"' || st || '"}' AS payload, strftime(event_at, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp" FROM e""")
def _(spark, d):
    f = view(spark, d, "feed")
    return R.to_feed(f.select("incident_id", (c("event") == "INCIDENT_CREATED").alias("is_new"), F.coalesce("status", F.lit("ACTIVE")).alias("status"), F.lit("ACTIVE").alias("previous_status"), c("event_at").alias("at")))


@query("src_reports", "SELECT report_id, md5(text) AS text, source, is_synthetic, date_trunc('millisecond', reported_at) AS reported_at, caller_id AS caller FROM report")
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/muster-src-{uuid.uuid4().hex}"
    with_metadata(spark, d).select("report_id", "text", "source", "is_synthetic", "reported_at", "metadata").write.option("compression", "gzip").json(path)
    got = R.read_reports(spark, path, "json")
    return got.select("report_id", F.md5("text").alias("text"), "source", "is_synthetic", "reported_at", c("metadata")["caller_id"].alias("caller"))


@query("src_labelled", "SELECT event_id::VARCHAR AS event_id, report_id, md5(text) AS text, 'g' || (event_id % 37) AS incident_group, urgency AS expected_urgency FROM report")
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/muster-lab-{uuid.uuid4().hex}"
    r = with_metadata(spark, d)
    r.select(
        c("event_id").cast("string").alias("event_id"), F.lit(1.5).alias("delay_seconds"),
        F.struct("report_id", "text", "source", "is_synthetic", "reported_at", "metadata").alias("dispatch"),
        F.struct(F.concat(F.lit("g"), c("event_id") % 37).alias("incident_group"), c("urgency").alias("expected_urgency")).alias("ground_truth"),
    ).write.option("compression", "gzip").json(path)
    reports, labels = R.read_labelled(spark, path)
    return reports.select("event_id", "report_id", F.md5("text").alias("text")).join(labels.select("report_id", "incident_group", "expected_urgency"), "report_id")


@query("tables_roundtrip", "SELECT report_id, is_synthetic, reported_at, urgency, reported_at::DATE AS day FROM report")
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/muster-tab-{uuid.uuid4().hex}"
    r = view(spark, d, "report").select("report_id", "is_synthetic", "reported_at", "urgency")
    R.append_table(r, path, "reported_at")
    return R.read_table(spark, path, "report_id string, is_synthetic boolean, reported_at timestamp, urgency string")


@query("scorecard", "SELECT 'quality' AS suite, lang AS metric, avg(y_true) AS value, count(*) AS n FROM label GROUP BY lang")
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/muster-score-{uuid.uuid4().hex}"
    rows = view(spark, d, "label").groupBy(F.lit("quality").alias("suite"), c("lang").alias("metric")).agg(F.avg("y_true").alias("value"), F.count("*").alias("n"))
    R.write_scorecard(rows, path)
    return spark.read.schema("suite string, metric string, value double, n long").json(path)


@query("report_id", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'given-' || doc_id ELSE 'rep-' || substr(sha256(text), 1, 12) END AS report_id FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("report_id", F.when(c("doc_id") % 3 == 0, F.concat(F.lit(" given-"), "doc_id", F.lit(" "))).when(c("doc_id") % 3 == 1, "  "))
    return V.assign_report_id(docs).select("doc_id", "report_id")


BROKEN = """br AS (SELECT report_id, text, event_id, CASE WHEN event_id % 41 = 0 THEN 'fax' ELSE source END AS source, CASE WHEN event_id % 43 = 0 THEN 95.0::DOUBLE ELSE latitude END AS latitude,
 CASE WHEN event_id % 47 = 0 THEN -181.0::DOUBLE ELSE longitude END AS longitude, CASE WHEN event_id % 53 = 0 THEN NOT is_synthetic ELSE is_synthetic END AS is_synthetic FROM report)"""


def broken(spark, d):
    e = c("event_id")
    return view(spark, d, "report").withColumns({
        "source": F.when(e % 41 == 0, "fax").otherwise(c("source")), "latitude": F.when(e % 43 == 0, 95.0).otherwise(c("latitude")),
        "longitude": F.when(e % 47 == 0, -181.0).otherwise(c("longitude")), "is_synthetic": F.when(e % 53 == 0, ~c("is_synthetic")).otherwise(c("is_synthetic")),
    })


@query("validate_reports", f"""WITH {BROKEN} SELECT report_id, reasons FROM (SELECT report_id, list_filter([CASE WHEN length(trim(text)) < 3 THEN 'TEXT_TOO_SHORT' END, CASE WHEN length(text) > 4000 THEN 'TEXT_TOO_LONG' END,
 CASE WHEN source NOT IN ('manual', 'simulator', 'dataset', 'other') THEN 'BAD_SOURCE' END, CASE WHEN NOT latitude BETWEEN -90 AND 90 THEN 'BAD_LATITUDE' END, CASE WHEN NOT longitude BETWEEN -180 AND 180 THEN 'BAD_LONGITUDE' END,
 CASE WHEN source = 'simulator' AND NOT is_synthetic THEN 'SIMULATOR_NOT_SYNTHETIC' END, CASE WHEN source = 'manual' AND is_synthetic THEN 'MANUAL_SYNTHETIC' END], lambda x: x IS NOT NULL) AS reasons FROM br) WHERE len(reasons) > 0""")
def _(spark, d):
    return V.validate_reports(broken(spark, d))[1].select("report_id", "reasons")


@query("validate_hints", """SELECT report_id, list_filter([CASE WHEN (lat IS NULL) <> (lon IS NULL) THEN 'PAIR_INCOMPLETE' END, CASE WHEN p = 'UNKNOWN' AND (lat IS NOT NULL OR lon IS NOT NULL) THEN 'UNKNOWN_WITH_COORDINATES' END,
 CASE WHEN p = 'EXACT' AND (lat IS NULL OR lon IS NULL) THEN 'EXACT_WITHOUT_COORDINATES' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT report_id, latitude AS lat, CASE WHEN event_id % 8 = 0 THEN NULL ELSE longitude END AS lon, ['UNKNOWN','APPROXIMATE','EXACT'][event_id % 3 + 1] AS p FROM report)""")
def _(spark, d):
    p = F.element_at(F.array(*map(F.lit, ("UNKNOWN", "APPROXIMATE", "EXACT"))), (c("event_id") % 3 + 1).cast("int"))
    lon = F.when(c("event_id") % 8 != 0, c("longitude"))
    return view(spark, d, "report").select("report_id", V.hint_reasons(c("latitude"), lon, p).alias("reasons"))


@query("constraint_violations", "SELECT incident_id AS row_id, 'status_known' AS rule FROM incident WHERE o_orderkey % 29 = 0 UNION ALL SELECT incident_id, 'people_not_negative' FROM incident WHERE o_orderkey % 31 = 0 UNION ALL SELECT link_id, 'similarity_in_range' FROM link WHERE similarity_score + 0.05 > 1")
def _(spark, d):
    i = view(spark, d, "incident").withColumns({"status": F.when(c("o_orderkey") % 29 == 0, "LOST").otherwise(c("status")), "people_at_risk_count": F.when(c("o_orderkey") % 31 == 0, -1).otherwise(c("people_at_risk_count"))})
    k = view(spark, d, "link").withColumn("similarity_score", c("similarity_score") + 0.05)
    return V.check_constraints(i, "incident_id", V.incident_rules()).unionByName(V.check_constraints(k, "link_id", V.link_rules()))


@query("validate_predictions", "SELECT report_id, list_filter([CASE WHEN event_id % 21 = 0 THEN 'type_confidence_out_of_range' END, CASE WHEN event_id % 22 = 0 THEN 'urgency_confidence_not_finite' END, CASE WHEN event_id % 23 = 0 THEN 'status_unknown' END], lambda x: x IS NOT NULL) AS reasons FROM pred")
def _(spark, d):
    e = c("event_id")
    p = view(spark, d, "pred").withColumns({
        "type_confidence": F.when(e % 21 == 0, 1.5).otherwise(c("type_confidence")), "urgency_confidence": F.when(e % 22 == 0, float("nan")).otherwise(c("urgency_confidence")),
        "processing_status": F.when(e % 23 == 0, "DONE").otherwise(c("processing_status")),
    })
    return p.select("report_id", V.prediction_reasons().alias("reasons"))


@query("normalise_predictions", """SELECT report_id, CASE event_id % 3 WHEN 0 THEN 'FIRE_WILDFIRE_EXPLOSION' WHEN 1 THEN 'FLOOD' ELSE 'OTHER_GENERAL_INCIDENT' END AS incident_type, CASE WHEN event_id % 3 = 2 THEN 'LOW' ELSE coalesce(urgency, 'LOW') END AS urgency,
 CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN event_id % 3 <> 2 THEN people_count END AS people_count, event_id % 3 <> 2 AND coalesce(people_count > 0, false) AS at_risk, event_id % 3 <> 2 AS valid FROM report""")
def _(spark, d):
    r = view(spark, d, "report")
    nested = F.to_json(F.struct(F.struct(F.lit("fire_wildfire_explosion").alias("label")).alias("incident_type"), F.struct(F.lower("urgency").alias("label"), F.lit(0.5).alias("confidence")).alias("urgency"), F.struct(c("people_count").alias("count")).alias("people_at_risk")))
    flat = F.to_json(F.struct(F.lit("flood").alias("type"), c("urgency").alias("level"), c("people_count")))
    return V.normalise_predictions(r.select("report_id", F.when(c("event_id") % 3 == 0, nested).when(c("event_id") % 3 == 1, flat).otherwise("not json").alias("payload")))


@query("leakage_audit", "SELECT report_id AS row_id, CASE WHEN event_id % 50 = 0 THEN 'Expected-Label' ELSE 'region' END AS name, CASE WHEN event_id % 50 = 0 THEN 'KEY' ELSE 'VALUE' END AS leak FROM report WHERE event_id % 50 = 0 OR event_id % 70 = 0")
def _(spark, d):
    return V.audit_leakage(with_metadata(spark, d), "report_id", "metadata")


@query("leakage_nested", """SELECT report_id AS row_id, name, leak FROM report, (VALUES (0, 'a.Expected Label', 'KEY'), (1, 'list[1].Gro\u00fcnd', NULL), (2, 'list[0]', 'VALUE'), (3, 'a.b', 'VALUE'), (4, 'Ground-Truth', 'KEY')) v(k, name, leak) WHERE k = event_id % 7 AND leak IS NOT NULL""")
def _(spark, d):
    texts = ('{"a": {"Expected Label": 1}}', '{"list": [1, {"gro\u00fcnd": "north"}]}', '{"list": ["True Urgency"]}', '{"a": {"b": "Expected: high"}}', '{"Ground-Truth": null}', "not json", None)
    raw = F.get(F.array(*[F.lit(t) for t in texts]), (c("event_id") % 7).cast("int"))
    return V.audit_nested(view(spark, d, "report").select("report_id", raw.alias("meta")), "report_id", "meta")


@query("validate_feed", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'MALFORMED_NON_JSON' WHEN event_id % 7 = 0 THEN 'MALFORMED' ELSE 'OK' END AS verdict FROM events")
def _(spark, d):
    e = c("event_id")
    raw = F.when(e % 9 == 0, "oops {").when(e % 7 == 0, '{"event": "x"}').otherwise('{"event": "x", "payload": {}, "timestamp": "t"}')
    return V.validate_feed(table(spark, d, "events").withColumn("raw", raw)).select("event_id", "verdict")


@query("filter_incidents", f"WITH {SCORE_SQL} SELECT incident_id FROM scored WHERE status IN ('ACTIVE', 'ESCALATED') AND level = 'CRITICAL'")
def _(spark, d):
    return V.filter_incidents(scored(spark, d), "active, escalated", "CRITICAL").select("incident_id")


@query("search", "WITH s AS (SELECT incident_id, status, incident_type FROM incident) SELECT incident_id FROM s WHERE contains(lower(incident_id), 'fire') OR contains(lower(coalesce(incident_type, '')), 'fire') OR contains(lower(status), 'fire')")
def _(spark, d):
    i = view(spark, d, "incident").withColumn("tags", F.array("status"))
    return V.search(i, " Fire", ("incident_id", "incident_type", "tags")).select("incident_id")


@query("filter_feed", "SELECT event_id FROM feed WHERE event = 'STATUS_CHANGED'")
def _(spark, d):
    return V.filter_feed(view(spark, d, "feed"), "STATUS").select("event_id")


@query("scope_run", "SELECT report_id FROM report WHERE report_id LIKE 'rep-0000012%'")
def _(spark, d):
    return V.scope_run(view(spark, d, "report"), "report_id", "rep-0000012").select("report_id")


@query("mapped_only", "SELECT report_id FROM report WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(spark, d):
    return V.mapped_only(view(spark, d, "report")).select("report_id")


@query("overridden_only", "SELECT incident_id FROM incident WHERE overridden")
def _(spark, d):
    return V.overridden_only(view(spark, d, "incident")).select("incident_id")


@query("normalise_ts", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE strftime(date_trunc('second', event_at), '%Y-%m-%dT%H:%M:%SZ') END AS iso, CASE event_id % 4 WHEN 3 THEN 'INVALID_TIMESTAMP' WHEN 1 THEN 'NAIVE_ASSUMED_UTC' END AS warning FROM feed""")
def _(spark, d):
    f, e = view(spark, d, "feed"), c("event_id") % 4
    sec = F.date_trunc("second", "event_at")
    raw = (
        F.when(e == 0, F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(e == 1, F.date_format(sec, "yyyy-MM-dd HH:mm:ss"))
        .when(e == 2, F.unix_seconds(sec).cast("string")).otherwise("next tuesday")
    )
    return f.select("event_id", V.normalise_ts(raw).alias("t")).select("event_id", "t.iso", "t.warning")


@query("rebase_ts", "SELECT report_id, timestamp '2030-01-01 00:00:00' + (reported_at - min(reported_at) OVER ()) AS reported_at FROM report")
def _(spark, d):
    return V.rebase_ts(view(spark, d, "report").select("report_id", "reported_at"), "reported_at", "2030-01-01 00:00:00")
