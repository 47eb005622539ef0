"""Queries over similarities, candidate and pair joins, assembly, sets and fusion rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.functions import scalars as S
from muster.operators import assemble as J
from muster.operators import candidates as C
from muster.operators import dedup as D
from muster.operators import fusion as U
from muster.plans.q_tables import SCORE_SQL
from muster.plans.registry import query
from muster.plans.views import short_view, table, view

c = F.col

# -- the pair rule in DuckDB, over all pairs within the horizon --------------------------------------------------

PLACE = "CASE WHEN lower(trim({0})) NOT IN ('', 'unknown', 'none', 'null', 'n/a', 'unspecified') THEN lower(trim({0})) END"
KIND = """CASE WHEN {a}latitude IS NOT NULL AND {b}latitude IS NOT NULL THEN 'COORDINATES' WHEN {a}place IS NULL AND {b}place IS NULL THEN 'BOTH_UNKNOWN'
 WHEN {a}place IS NULL OR {b}place IS NULL THEN 'ONE_UNKNOWN' WHEN {a}place = {b}place THEN 'EXACT_TEXT'
 WHEN contains({a}place, {b}place) OR contains({b}place, {a}place) OR list_has_any(list_filter(string_split({a}place, ' '), lambda x: length(x) >= 3), string_split({b}place, ' ')) THEN 'SUBSTRING_TEXT'
 ELSE 'CONFLICTING_TEXT' END"""
KM = """6371.0 * 2 * atan2(sqrt(hv), sqrt(1 - hv))"""
HV = """greatest(0.0, least(1.0, pow(sin(radians({b}latitude - {a}latitude) / 2), 2) + cos(radians({a}latitude)) * cos(radians({b}latitude)) * pow(sin(radians({b}longitude - {a}longitude) / 2), 2)))"""
DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def pair_sql(semantic: bool) -> str:
    cos = "round(greatest(-1.0, least(1.0, " + DOT.format(a="a.embedding", b="b.embedding") + " / (sqrt(" + DOT.format(a="a.embedding", b="a.embedding") + ") * sqrt(" + DOT.format(a="b.embedding", b="b.embedding") + ")))), 4)"
    sem, score = (cos, "0.55 * semantic + 0.2 * temporal + 0.25 * spatial") if semantic else ("NULL::DOUBLE", "0.4444 * temporal + 0.5556 * spatial")
    return f"""p AS (SELECT * EXCLUDE (text), {PLACE.format('location_text')} AS place, md5(lower(trim(text))) AS nt FROM report),
pr AS (SELECT a.report_id AS a_report_id, b.report_id AS b_report_id, {sem} AS semantic, epoch_us(b.reported_at) / 3600000000.0 - epoch_us(a.reported_at) / 3600000000.0 AS h0,
 (epoch_us(b.reported_at) - epoch_us(a.reported_at)) / 3600000000.0 AS hours, {KIND.format(a='a.', b='b.')} AS kind, {HV.format(a='a.', b='b.')} AS hv,
 a.nt = b.nt AS verbatim, b.caller_id AS src, coalesce(a.caller_id = b.caller_id, false) AS same
 FROM p a JOIN p b ON a.is_synthetic = b.is_synthetic AND (b.reported_at > a.reported_at OR (b.reported_at = a.reported_at AND a.report_id < b.report_id))
 AND epoch_us(b.reported_at) - epoch_us(a.reported_at) <= 21600000000),
p2 AS (SELECT *, round(exp(-hours / 3.0), 4) AS temporal, CASE kind WHEN 'COORDINATES' THEN round(greatest(0.0, 1.0 - {KM} / 2.5), 4) WHEN 'EXACT_TEXT' THEN 0.9 WHEN 'SUBSTRING_TEXT' THEN 0.6 WHEN 'CONFLICTING_TEXT' THEN 0.0 ELSE 0.5 END::DOUBLE AS spatial FROM pr),
p3 AS (SELECT *, round(greatest(0.0, least(1.0, ({score})::DOUBLE)), 4) AS score FROM p2),
pairs AS (SELECT *, CASE WHEN semantic >= 0.7 AND (kind = 'CONFLICTING_TEXT' OR hours > 6 OR temporal <= 0) THEN 'UNCERTAIN' WHEN kind = 'CONFLICTING_TEXT' THEN 'INITIAL' WHEN score < 0.7 THEN 'INITIAL'
 WHEN verbatim OR same THEN 'DUPLICATE' WHEN score >= 0.85 AND src IS NULL THEN 'DUPLICATE' ELSE 'CORROBORATING' END AS relation FROM p3)"""


@query("pair_join", f"WITH {pair_sql(False)} SELECT a_report_id, b_report_id, kind FROM pairs WHERE relation <> 'INITIAL'")
def _(spark, d):
    return C.matched_pairs(view(spark, d, "report"))


@query("correlate", f"WITH {pair_sql(True)} SELECT a_report_id, b_report_id, semantic, temporal, spatial, score, kind, relation FROM pairs WHERE relation <> 'INITIAL'")
def _(spark, d):
    return C.matched_by_vectors(short_view(spark, d))


@query("relationship", f"WITH {pair_sql(True)} SELECT relation, kind, count(*) AS n FROM pairs GROUP BY ALL")
def _(spark, d):
    return C.relation_counts(short_view(spark, d))


@query("composite", f"WITH {pair_sql(True)} SELECT kind, count(*) AS n, max(score) AS high FROM pairs GROUP BY kind")
def _(spark, d):
    return C.highest_scores(short_view(spark, d))


@query("spatial_similarity", f"WITH {pair_sql(False)} SELECT kind, spatial, count(*) AS n FROM pairs GROUP BY ALL")
def _(spark, d):
    return C.place_counts(view(spark, d, "report"), by_points=True)


@query("fuse_components", f"""WITH RECURSIVE {pair_sql(True)}, e AS (SELECT a_report_id AS x, b_report_id AS y FROM pairs WHERE relation <> 'INITIAL' UNION SELECT b_report_id, a_report_id FROM pairs WHERE relation <> 'INITIAL'),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT r.report_id, coalesce(least(r.report_id, m.lo), r.report_id) AS component FROM report r LEFT JOIN (SELECT x, min(y) AS lo FROM reach GROUP BY x) m ON m.x = r.report_id""")
def _(spark, d):
    return U.with_components(view(spark, d, "report"), C.matched_components(short_view(spark, d)))


# One incident a caller, day and kind: its last report gives time and place.
INC = """cand AS (SELECT 'inc-' || max(event_id) AS incident_id, CASE max(event_id) % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'RESOLVED' END AS status,
 is_synthetic, max(reported_at) AS last_active, arg_max(x, (reported_at, event_id)).a AS latitude, arg_max(x, (reported_at, event_id)).b AS longitude, arg_max(x, (reported_at, event_id)).c AS location_text
 FROM (SELECT *, {'a': latitude, 'b': longitude, 'c': location_text} AS x FROM report) GROUP BY user_id, date_trunc('day', reported_at), is_synthetic)"""


def open_incidents(spark, d):
    r = view(spark, d, "report")
    last = F.max(F.struct("reported_at", "event_id", "latitude", "longitude", "location_text")).alias("l")
    g = r.groupBy("user_id", F.date_trunc("day", "reported_at").alias("day"), "is_synthetic").agg(last, F.max("event_id").alias("e"))
    return g.select(
        F.concat(F.lit("inc-"), "e").alias("incident_id"), F.when(c("e") % 3 == 0, "ACTIVE").when(c("e") % 3 == 1, "NEEDS_REVIEW").otherwise("RESOLVED").alias("status"),
        "is_synthetic", c("l.reported_at").alias("last_active"), "l.latitude", "l.longitude", "l.location_text",
    )


CAND = """ca AS (SELECT r.report_id, r.reported_at, c.incident_id, c.last_active, r.latitude AS rlat, r.longitude AS rlon, r.location_text AS rt, c.latitude AS clat, c.longitude AS clon, c.location_text AS ct
 FROM report r JOIN cand c ON r.is_synthetic = c.is_synthetic AND c.status IN ('ACTIVE', 'NEEDS_REVIEW') AND epoch_us(r.reported_at) - epoch_us(c.last_active) BETWEEN 0 AND 21600000000)"""


@query("candidate_join", f"WITH {INC}, {CAND} SELECT report_id, incident_id FROM ca")
def _(spark, d):
    return C.candidates(view(spark, d, "report"), open_incidents(spark, d)).select("report_id", c("i_incident_id").alias("incident_id"))


@query("best_match", f"""WITH {INC}, {CAND}, n AS (SELECT report_id, incident_id, last_active, rlat AS a_latitude, rlon AS a_longitude, {PLACE.format('rt')} AS a_place, clat AS b_latitude, clon AS b_longitude, {PLACE.format('ct')} AS b_place,
 (epoch_us(reported_at) - epoch_us(last_active)) / 3600000000.0 AS hours FROM ca),
k AS (SELECT *, {KIND.format(a='a_', b='b_')} AS kind, {HV.format(a='a_', b='b_')} AS hv FROM n),
s AS (SELECT *, round(exp(-hours / 3.0), 4) AS t, CASE kind WHEN 'COORDINATES' THEN round(greatest(0.0, 1.0 - {KM} / 2.5), 4) WHEN 'EXACT_TEXT' THEN 0.9 WHEN 'SUBSTRING_TEXT' THEN 0.6 WHEN 'CONFLICTING_TEXT' THEN 0.0 ELSE 0.5 END::DOUBLE AS sp FROM k),
z AS (SELECT *, round((0.4444 * t + 0.5556 * sp)::DOUBLE, 4) AS score FROM s)
SELECT report_id, incident_id, score FROM z WHERE kind <> 'CONFLICTING_TEXT' AND score >= 0.7 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY score DESC, last_active DESC, incident_id) = 1""")
def _(spark, d):
    found = C.best_candidates(view(spark, d, "report"), open_incidents(spark, d))
    return C.best_match(found).select("report_id", "incident_id", "score")


# -- scalar functions ----------------------------------------------------------------------------------------------


@query("cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(-1.0, least(1.0, " + DOT.format(a="a.embedding", b="b.embedding") + " / (sqrt(" + DOT.format(a="a.embedding", b="a.embedding") + ") * sqrt(" + DOT.format(a="b.embedding", b="b.embedding") + ")))), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(c("vec_id").alias("a"), c("embedding").alias("va")), e.select((c("vec_id") - 1).alias("a"), c("vec_id").alias("b"), c("embedding").alias("vb"))
    return a.join(b, "a").select("a", "b", S.cosine(c("va"), c("vb")).alias("cosine"))


@query("unit_vector", "SELECT vec_id, round(embedding[1] / sqrt(" + DOT.format(a="embedding", b="embedding") + "), 5) AS first, abs(sqrt(" + DOT.format(a="embedding", b="embedding") + ") - 1) <= 0.001 AS unit FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(S.unit_vector(c("embedding"))[0], 5).alias("first"), S.is_unit(c("embedding")).alias("unit"))


@query("temporal_decay", "SELECT report_id, CASE WHEN event_id % 100 / 10.0 > 6 THEN 0.0 ELSE round(exp(-(event_id % 100 / 10.0) / 3.0), 4) END AS decay FROM report")
def _(spark, d):
    return view(spark, d, "report").select("report_id", S.temporal_decay((c("event_id") % 100) / 10.0).alias("decay"))


BASE = "20.3, 85.82"


@query("haversine", f"SELECT report_id, round({KM}, 6) AS km FROM (SELECT report_id, {HV.format(a='b_', b='')} AS hv FROM (SELECT *, 20.3::DOUBLE AS b_latitude, 85.82::DOUBLE AS b_longitude FROM report WHERE latitude IS NOT NULL))")
def _(spark, d):
    r = view(spark, d, "report").where("latitude is not null")
    return r.select("report_id", F.round(S.haversine_km(F.lit(20.3), F.lit(85.82), c("latitude"), c("longitude")), 6).alias("km"))


@query("bearing", """SELECT report_id, round(g, 4) AS degrees, ['N','NE','E','SE','S','SW','W','NW'][floor((g + 22.5) / 45.0)::INT % 8 + 1] AS compass FROM (SELECT report_id,
 (degrees(atan2(sin(radians(longitude - 85.82)) * cos(radians(latitude)), cos(radians(20.3)) * sin(radians(latitude)) - sin(radians(20.3)) * cos(radians(latitude)) * cos(radians(longitude - 85.82)))) + 360.0) % 360.0 AS g FROM report WHERE latitude IS NOT NULL)""")
def _(spark, d):
    g = S.bearing_degrees(F.lit(20.3), F.lit(85.82), c("latitude"), c("longitude"))
    return view(spark, d, "report").where("latitude is not null").select("report_id", F.round(g, 4).alias("degrees"), S.compass(g).alias("compass"))


@query("norm_location", f"SELECT report_id, {PLACE.format('location_text')} AS place FROM report")
def _(spark, d):
    return view(spark, d, "report").select("report_id", S.norm_place(c("location_text")).alias("place"))


@query("post_counts", "SELECT link_id, CASE WHEN relationship_type = 'INITIAL' THEN 1 ELSE 2 END AS report_count, CASE WHEN relationship_type = 'CORROBORATING' THEN 2 ELSE 1 END AS sources FROM link")
def _(spark, d):
    k = c("relationship_type")
    return view(spark, d, "link").select("link_id", F.when(k == "INITIAL", 1).otherwise(2).alias("report_count"), F.when(k == "CORROBORATING", 2).otherwise(1).alias("sources"))


@query("corroboration_text", """SELECT incident_id, CASE WHEN n = 1 THEN 'one source, ' || k || ' report(s)' ELSE n || ' sources agree, weight ' || printf('%.2f', round(1 - exp(-0.45 * n), 2)) END AS sentence
 FROM (SELECT incident_id, count(*) AS k, 1 + count(*) FILTER (WHERE relationship_type = 'CORROBORATING') AS n FROM link GROUP BY 1)""")
def _(spark, d):
    from muster.operators.aggregates import rollup

    r = rollup(view(spark, d, "link"))
    return r.select("incident_id", S.corroboration_text(c("report_count"), c("independent_source_count"), c("corroboration_score")).alias("sentence"))


@query("priority_fallback", "SELECT report_id, CASE WHEN processing_status = 'FAILED' THEN 50.0::DOUBLE ELSE round(least(100.0, value), 2) END AS priority_score FROM pred")
def _(spark, d):
    return view(spark, d, "pred").select("report_id", F.when(c("processing_status") == "FAILED", 50.0).otherwise(F.round(F.least(F.lit(100.0), c("value")), 2)).alias("priority_score"))


@query("priority_sentence", f"""WITH {SCORE_SQL} SELECT incident_id, CASE WHEN status = 'RESOLVED' THEN 'closed, so it ranks last with 0' ELSE level || ' at ' || printf('%.2f', score)
 || ': urgency ' || coalesce(urgency, 'not known') || ' adds ' || printf('%.2f', round(u * 0.35, 2)) || '; people ' || CASE WHEN people_at_risk_count > 0 THEN people_at_risk_count::VARCHAR ELSE 'none named' END
 || ' adds ' || printf('%.2f', round(p * 0.3, 2)) || '; sources ' || independent_source_count || ' adds ' || printf('%.2f', round(c * 0.2, 2)) || '; hazard ' || coalesce(incident_type, 'not known')
 || ' adds ' || printf('%.2f', round(h * 0.15, 2)) END AS explanation FROM scored""")
def _(spark, d):
    from muster.operators.review import explain_priority

    return explain_priority(view(spark, d, "incident")).select("incident_id", "explanation")


@query("priority_explain")
def _(spark, d):
    from muster.operators.review import explain_priority

    return explain_priority(view(spark, d, "incident"))


@query("number_words", """WITH w AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN cast(event_id AS string) WHEN 1 THEN ['one','two','three','four','five','six','seven','eight','nine'][event_id % 9 + 1]
 WHEN 2 THEN ['twenty','thirty','forty'][event_id % 3 + 1] || '-' || ['one','two','three','four','five','six','seven','eight','nine'][event_id % 9 + 1] ELSE ['two','three'][event_id % 2 + 1] || ' hundred and ' || ['five','six'][event_id % 2 + 1] END AS t FROM events)
SELECT event_id, t, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id <= 10000 THEN event_id END WHEN 1 THEN event_id % 9 + 1 WHEN 2 THEN (event_id % 3 + 2) * 10 + event_id % 9 + 1 ELSE (event_id % 2 + 2) * 100 + event_id % 2 + 5 END::INT AS n FROM w""")
def _(spark, d):
    units = [k for k, v in S.WORD_VALUES.items() if 1 <= v <= 9]
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    e = c("event_id")
    t = (
        F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, pick(units, e % 9))
        .when(e % 4 == 2, F.concat(pick(["twenty", "thirty", "forty"], e % 3), F.lit("-"), pick(units, e % 9)))
        .otherwise(F.concat(pick(["two", "three"], e % 2), F.lit(" hundred and "), pick(["five", "six"], e % 2)))
    )
    return table(spark, d, "events").select("event_id", t.alias("t"), S.number_words(t).alias("n"))


@query("text_match", """WITH t AS (SELECT a.report_id AS a, list_distinct(regexp_extract_all(lower(a.location_text), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(lower(b.location_text), '[a-z0-9]+')) AS y
 FROM report a JOIN report b ON b.event_id = a.event_id + 3)
SELECT a, coalesce(len(list_intersect(x, y)) > 0 AND (len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.4 OR ((len(list_intersect(x, y)) = len(x) OR len(list_intersect(x, y)) = len(y)) AND len(list_filter(list_intersect(x, y), lambda w: length(w) >= 4)) > 0)), false) AS matched FROM t""")
def _(spark, d):
    r = view(spark, d, "report").select("event_id", "report_id", "location_text")
    b = r.select((c("event_id") - 3).alias("event_id"), c("location_text").alias("other"))
    return r.join(b, "event_id").select(c("report_id").alias("a"), S.text_match(c("location_text"), c("other")).alias("matched"))


@query("norm_span", r"SELECT doc_id, md5(regexp_replace(lower(trim(text)), '[\t\n\x0b\f\r ]+', ' ', 'g')) AS span FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.norm_span(c("text")).cast("binary")).alias("span"))


@query("json_fields", "SELECT event_id, cast(props->>'$.k' AS int) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("source_id", "SELECT report_id, coalesce(caller_id, source) AS source_id FROM report")
def _(spark, d):
    md = F.create_map(F.lit("caller_id"), c("caller_id"))
    return view(spark, d, "report").select("report_id", S.source_id(md, c("source")).alias("source_id"))


@query("operator_id", """SELECT override_id, CASE WHEN h IS NOT NULL AND b IS NOT NULL AND h <> b THEN NULL ELSE coalesce(h, b) END AS operator,
 CASE WHEN h IS NULL AND b IS NULL THEN 'MISSING_OPERATOR' WHEN h <> b THEN 'OPERATOR_MISMATCH' END AS error FROM (SELECT override_id, o, CASE WHEN o % 3 = 0 THEN NULL ELSE operator_id END AS h,
 CASE WHEN o % 5 = 0 THEN 'op-x' WHEN o % 2 = 0 THEN NULL ELSE operator_id END AS b FROM (SELECT *, cast(replace(override_id, 'ovr-', '') AS bigint) AS o FROM audit))""")
def _(spark, d):
    a = view(spark, d, "audit").withColumn("o", F.replace("override_id", F.lit("ovr-")).cast("long"))
    h = F.when(c("o") % 3 != 0, c("operator_id"))
    b = F.when(c("o") % 5 == 0, "op-x").when(c("o") % 2 != 0, c("operator_id"))
    return a.select("override_id", S.operator_id(h, b).alias("x")).select("override_id", "x.*")


@query("location_overlay", """SELECT report_id, CASE WHEN event_id % 4 = 1 THEN 1.5 ELSE latitude END AS lat, CASE WHEN event_id % 4 = 1 THEN 2.5 ELSE longitude END AS lon,
 CASE WHEN event_id % 4 = 1 THEN 'hint' WHEN event_id % 4 = 2 THEN coalesce(location_text, 'hint') ELSE location_text END AS place FROM report""")
def _(spark, d):
    from muster.operators.review import overlay_location

    e = c("event_id") % 4
    hint = F.struct(
        F.when(e == 1, 1.5).alias("latitude"), F.when(e == 1, 2.5).alias("longitude"), F.when(e.isin(1, 2), "hint").alias("raw_text"), F.lit(None).cast("string").alias("precision")
    )
    r = view(spark, d, "report").withColumn("hint", hint)
    pred = F.struct("latitude", "longitude", c("location_text").alias("text"), F.lit("APPROXIMATE").alias("precision"))
    out = r.select("report_id", overlay_location(pred, c("hint")).alias("l"))
    return out.select("report_id", c("l.latitude").alias("lat"), c("l.longitude").alias("lon"), c("l.text").alias("place"))


@query("fallback_prediction", "SELECT report_id, 'FAILED' AS processing_status, ['ANALYSIS_FAILED'] AS warnings, location_text AS place FROM report")
def _(spark, d):
    from muster.operators.review import fallback_prediction

    return fallback_prediction(view(spark, d, "report")).select("report_id", "processing_status", "warnings", c("location.text").alias("place"))


PRECISE = "CASE WHEN {0}event_id % 7 = 0 THEN 'EXACT' WHEN {0}event_id % 7 < 4 THEN 'APPROXIMATE' ELSE 'UNKNOWN' END"
RANKED = "CASE WHEN {0}event_id % 7 = 0 THEN 3 WHEN {0}event_id % 7 < 4 THEN 2 ELSE 1 END"


@query("fuse_pair", f"""WITH p AS (SELECT a.report_id, CASE WHEN coalesce(array_position(['LOW','MEDIUM','HIGH','CRITICAL'], b.urgency), 0) > coalesce(array_position(['LOW','MEDIUM','HIGH','CRITICAL'], a.urgency), 0) THEN b.urgency ELSE coalesce(a.urgency, b.urgency) END AS urgency,
 greatest(a.people_count, b.people_count) AS people_count, b.latitude IS NOT NULL AND b.event_id % 10 <> 0 AND (a.latitude IS NULL OR {RANKED.format('b.')} > {RANKED.format('a.')}) AS better,
 a.location_text AS t1, b.location_text AS t2, a.latitude AS alat, b.latitude AS blat, a.longitude AS alon, b.longitude AS blon, {PRECISE.format('a.')} AS ap, {PRECISE.format('b.')} AS bp
 FROM report a JOIN report b ON b.event_id = a.event_id + 1)
SELECT report_id, urgency, people_count, CASE WHEN better THEN coalesce(t2, t1) ELSE t1 END AS location_text, CASE WHEN better THEN blat ELSE alat END AS latitude,
 CASE WHEN better THEN blon ELSE alon END AS longitude, CASE WHEN better THEN bp ELSE ap END AS location_precision FROM p""")
def _(spark, d):
    r = view(spark, d, "report").select(
        "event_id", "report_id", "urgency", "people_count", "location_text", "latitude", "longitude", F.expr(PRECISE.format("")).alias("location_precision"),
        F.lit("OTHER_GENERAL_INCIDENT").alias("incident_type"), (c("event_id") % 10 == 0).alias("conflict"),
    )
    i = r.select(*[c(x).alias(f"i_{x}") for x in r.columns])
    j = r.select((c("event_id") - 1).alias("i_event_id"), *[c(x).alias(f"r_{x}") for x in r.columns])
    both = U.fuse_pair(i.join(j, "i_event_id"), "r_conflict")
    return both.select(c("i_report_id").alias("report_id"), "urgency", "people_count", "location_text", "latitude", "longitude", "location_precision")


# -- assembly ------------------------------------------------------------------------------------------------------


@query("source_reports", "SELECT l.incident_id, row_number() OVER (PARTITION BY l.incident_id ORDER BY l.fused_at, l.link_id) AS seq, l.report_id, r.reported_at, r.urgency FROM link l LEFT JOIN report r USING (report_id) QUALIFY r.reported_at IS NOT NULL")
def _(spark, d):
    return J.source_reports(view(spark, d, "link"), view(spark, d, "report"))


LATEST = "lp AS (SELECT l.incident_id, l.report_id, p.* EXCLUDE (report_id) FROM link l JOIN pred p USING (report_id) QUALIFY row_number() OVER (PARTITION BY l.incident_id ORDER BY l.fused_at DESC, l.link_id DESC) = 1)"


@query("latest_prediction", f"WITH {LATEST} SELECT incident_id, report_id, processing_status FROM lp")
def _(spark, d):
    return J.latest_prediction(view(spark, d, "link"), view(spark, d, "pred")).select("incident_id", "report_id", "processing_status")


@query("assemble_incident", f"""WITH {LATEST}, lc AS (SELECT * FROM calc QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY calculated_at DESC, calc_id DESC) = 1),
lk AS (SELECT incident_id, count(*) AS n, list_sort(list_distinct(list(report_id))) AS ids FROM link GROUP BY 1)
SELECT i.incident_id, i.status, coalesce(n, 0) AS report_count, coalesce(ids, []) AS report_ids, coalesce(priority_score, 0) AS priority_score, coalesce(priority_level, 'LOW') AS priority_level,
 coalesce(explanation, 'Not scored yet.') AS explanation, type_confidence, urgency_confidence, location_confidence FROM incident i LEFT JOIN lk USING (incident_id) LEFT JOIN lc USING (incident_id) LEFT JOIN lp USING (incident_id)""")
def _(spark, d):
    return J.assemble(*[view(spark, d, n) for n in ("incident", "link", "calc", "pred")])


@query("incident_detail")
def _(spark, d):
    v = J.assemble(*[view(spark, d, n) for n in ("incident", "link", "calc", "pred")])
    return J.incident_detail(v, view(spark, d, "link"), view(spark, d, "report"), view(spark, d, "audit"))


@query("detail_digest", """WITH s AS (SELECT l.incident_id, string_agg(l.report_id, ',' ORDER BY l.fused_at, l.link_id) AS reports FROM link l JOIN report r USING (report_id) GROUP BY 1),
a AS (SELECT incident_id, string_agg(override_id, ',' ORDER BY created_at DESC, override_id DESC) AS trail FROM audit GROUP BY 1)
SELECT incident_id, coalesce(reports, '') AS reports, coalesce(trail, '') AS trail FROM incident LEFT JOIN s USING (incident_id) LEFT JOIN a USING (incident_id)""")
def _(spark, d):
    v = J.assemble(*[view(spark, d, n) for n in ("incident", "link", "calc", "pred")])
    out = J.incident_detail(v, view(spark, d, "link"), view(spark, d, "report"), view(spark, d, "audit"))
    listed = lambda rows, f: F.coalesce(F.array_join(F.transform(rows, lambda x: x[f]), ","), F.lit(""))
    return out.select("incident_id", listed("reports", "report_id").alias("reports"), listed("audit_trail", "override_id").alias("trail"))


@query("run_incidents", "SELECT incident_id FROM incident WHERE incident_id IN (SELECT incident_id FROM link WHERE report_id LIKE 'rep-000001%' AND report_id IN (SELECT report_id FROM report))")
def _(spark, d):
    return J.incidents_of_run(view(spark, d, "incident"), view(spark, d, "link"), view(spark, d, "report"), "rep-000001").select("incident_id")


@query("orphan_links", "SELECT link_id FROM link WHERE incident_id NOT IN (SELECT incident_id FROM incident WHERE status <> 'FALSE_REPORT')")
def _(spark, d):
    return J.orphans(view(spark, d, "link"), view(spark, d, "incident").where("status <> 'FALSE_REPORT'")).select("link_id")


@query("pending_reports", "SELECT report_id FROM report WHERE report_id NOT IN (SELECT report_id FROM link WHERE relationship_type <> 'RELATED')")
def _(spark, d):
    return J.pending(view(spark, d, "report"), view(spark, d, "link").where("relationship_type <> 'RELATED'")).select("report_id")


@query("missing_reports", "SELECT DISTINCT report_id FROM link WHERE report_id NOT IN (SELECT report_id FROM report)")
def _(spark, d):
    return J.missing(view(spark, d, "link"), view(spark, d, "report"), "report_id").distinct()


@query("unknown_feed_ids", "SELECT DISTINCT incident_id FROM feed WHERE incident_id NOT IN (SELECT incident_id FROM incident WHERE is_synthetic)")
def _(spark, d):
    return J.missing(view(spark, d, "feed"), view(spark, d, "incident").where("is_synthetic"), "incident_id").distinct()


@query("with_labels", "SELECT l.doc_id, l.y_true, coalesce(p.y, -1) AS y_pred, coalesce(p.score, 0) AS p, p.y IS NOT NULL AS valid FROM label l LEFT JOIN (SELECT doc_id, (score >= 0.5)::INT AS y, score FROM label WHERE doc_id % 6 <> 0) p USING (doc_id)")
def _(spark, d):
    v = view(spark, d, "label")
    preds = v.where("doc_id % 6 <> 0").select("doc_id", (c("score") >= 0.5).cast("int").alias("y_pred"), c("score").alias("p"))
    return J.with_labels(preds, v.select("doc_id", "y_true"))


@query("priority_as_of", "WITH pb AS (SELECT report_id AS probe_id, 'inc-' || ((user_id * 3) % 150) AS incident_id, reported_at AS at_time FROM report) SELECT probe_id, pb.incident_id, at_time, c.priority_score AS score FROM pb ASOF LEFT JOIN (SELECT * FROM calc QUALIFY row_number() OVER (PARTITION BY incident_id, calculated_at ORDER BY calc_id DESC) = 1) c ON pb.incident_id = c.incident_id AND pb.at_time >= c.calculated_at")
def _(spark, d):
    probes = view(spark, d, "report").select(c("report_id").alias("probe_id"), F.concat(F.lit("inc-"), (c("user_id") * 3) % 150).alias("incident_id"), c("reported_at").alias("at"))
    return J.priority_as_of(probes, view(spark, d, "calc")).withColumnRenamed("at", "at_time")


@query("timeline", """SELECT incident_id, link_id AS event_id, fused_at AS event_at, 'REPORT_FUSED' AS event_type, 'Report ' || report_id || ' fused as ' || relationship_type AS summary FROM link
 UNION ALL SELECT incident_id, calc_id, calculated_at, 'PRIORITY_CALCULATED', 'Priority ' || priority_level FROM calc
 UNION ALL SELECT incident_id, override_id, created_at, 'HUMAN_ACTION', operator_id || ' set ' || field || ' to ' || new_value FROM audit""")
def _(spark, d):
    return J.timeline(view(spark, d, "link"), view(spark, d, "calc"), view(spark, d, "audit"))


# -- sets ------------------------------------------------------------------------------------------------------------


@query("idempotent_ingest", """WITH s AS (SELECT report_id, text, source, is_synthetic, reported_at FROM report WHERE event_id % 2 = 0), n AS (SELECT report_id, CASE WHEN event_id % 10 = 4 THEN 'changed' ELSE text END AS text, source, is_synthetic, reported_at FROM report WHERE event_id % 3 = 0)
SELECT n.report_id, CASE WHEN s.report_id IS NULL THEN 'NEW' WHEN s.text = n.text THEN 'RETRY' ELSE 'CONFLICT' END AS verdict FROM n LEFT JOIN s USING (report_id)""")
def _(spark, d):
    r = view(spark, d, "report")
    cols = ("report_id", "source", "is_synthetic", "reported_at")
    stored = r.where("event_id % 2 = 0").select(*cols, F.xxhash64("text").alias("text_hash"))
    text = F.when(c("event_id") % 10 == 4, "changed").otherwise(c("text"))
    new = r.where("event_id % 3 = 0").select(*cols, F.xxhash64(text).alias("text_hash"))
    return D.split_retries(new, stored).select("report_id", "verdict")


@query("verbatim_duplicates", "SELECT sha256(lower(trim(text))) AS text_key, count(*) AS n, min(report_id) AS first_report FROM report GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return D.verbatim_groups(view(spark, d, "report"))


@query("response_union", """SELECT report_id, list_concat(list_filter(['SEARCH_AND_RESCUE','MEDICAL_EMS','FIRE_HAZMAT'], lambda x: list_contains(u, x)), list_sort(list_filter(u, lambda x: x NOT IN ('SEARCH_AND_RESCUE','MEDICAL_EMS','FIRE_HAZMAT')))) AS responses FROM (
 SELECT report_id, list_distinct(list_filter([CASE WHEN event_id % 2 = 0 THEN 'ZOO' END, CASE WHEN event_id % 3 = 0 THEN 'FIRE_HAZMAT' END, CASE WHEN event_id % 5 = 0 THEN 'SEARCH_AND_RESCUE' END, CASE WHEN event_id % 7 = 0 THEN 'ANIMAL' END, CASE WHEN event_id % 2 = 1 THEN 'FIRE_HAZMAT' END], lambda x: x IS NOT NULL)) AS u FROM report)""")
def _(spark, d):
    some = lambda *p: F.array_compact(F.array(*[F.when(c("event_id") % m == r, k) for m, r, k in p]))
    a, b = some((2, 0, "ZOO"), (3, 0, "FIRE_HAZMAT"), (5, 0, "SEARCH_AND_RESCUE")), some((7, 0, "ANIMAL"), (2, 1, "FIRE_HAZMAT"))
    return view(spark, d, "report").select("report_id", U.fuse_responses(a, b).alias("responses"))


@query("entity_merge", """SELECT report_id, list_sort(list_distinct(list_filter([CASE WHEN event_id % 2 = 0 THEN {'type': 'ROAD', 'text': 'Main'} END, CASE WHEN event_id % 2 <> 0 THEN {'type': 'ROAD', 'text': 'main'} END, CASE WHEN event_id % 3 = 0 THEN {'type': 'AREA', 'text': 'Old Town'} END], lambda x: x IS NOT NULL))) AS entities FROM report""")
def _(spark, d):
    e = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit(text).alias("text"))
    raw = F.array_compact(F.array(
        F.when(c("event_id") % 2 == 0, e("road", "Main")), e("ROAD", "main"), F.when(c("event_id") % 3 == 0, e("Area", "Old Town")), F.when(c("event_id") % 3 == 0, e("AREA", "old town")),
    ))
    return D.merge_entities(view(spark, d, "report").select("report_id", raw.alias("entities")))


@query("distinct_warnings", "SELECT report_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 'a' END, 'b', CASE WHEN event_id % 2 <> 0 THEN 'a' END], lambda x: x IS NOT NULL) AS warnings FROM report")
def _(spark, d):
    w = F.array_compact(F.array(F.when(c("event_id") % 2 == 0, " a"), F.lit("b"), F.lit("  "), F.lit("a "), F.lit("b")))
    return view(spark, d, "report").select("report_id", D.dedup_warnings(w).alias("warnings"))


@query("distinct_sources", "SELECT DISTINCT incident_id, source FROM link")
def _(spark, d):
    return D.sources_of(view(spark, d, "link"))


@query("reconcile", "SELECT 'missing' AS metric, count(*) AS n FROM (SELECT report_id FROM report EXCEPT ALL SELECT report_id FROM link) UNION ALL SELECT 'repeated', count(*) - count(DISTINCT report_id) FROM link")
def _(spark, d):
    return D.reconcile(view(spark, d, "report"), view(spark, d, "link"), "report_id")


# -- fusion --------------------------------------------------------------------------------------------------------


@query("fuse_replay")
def _(spark, d):
    return U.fuse_replay(short_view(spark, d), "region")


@query("fuse_replay_semantic")
def _(spark, d):
    return U.fuse_replay(short_view(spark, d), "region", semantic=True)


@query("fusion_outputs")
def _(spark, d):
    r = short_view(spark, d)
    out = U.fusion_outputs(U.fuse_replay(r, "exact"), r)
    return out["states"].join(out["ledger"], "incident_id")


@query("open_incident", """SELECT 'inc-' || report_id AS incident_id, CASE WHEN processing_status IN ('FAILED', 'PARTIAL', 'NEEDS_REVIEW') OR coalesce(type_confidence < 0.6, false) THEN 'NEEDS_REVIEW' ELSE 'ACTIVE' END AS status,
 1 AS report_count, 1 AS independent_source_count, 0.36::DOUBLE AS corroboration_score FROM pred""")
def _(spark, d):
    return U.open_incident(view(spark, d, "pred").withColumn("confidence", c("type_confidence")))


@query("route_review", """SELECT l.link_id, CASE WHEN (l.relationship_type = 'RELATED' OR p.processing_status IN ('FAILED', 'PARTIAL') OR coalesce(p.type_confidence < 0.6, false) OR p.event_id % 19 = 0 OR p.event_id % 23 = 0)
 AND NOT (i.status IN ('VERIFIED', 'ESCALATED') OR i.overridden) THEN 'NEEDS_REVIEW' ELSE i.status END AS new_status FROM link l JOIN pred p USING (report_id) JOIN incident i USING (incident_id)""")
def _(spark, d):
    j = view(spark, d, "link").join(view(spark, d, "pred"), "report_id").join(view(spark, d, "incident").select("incident_id", "status", "overridden"), "incident_id")
    j = j.withColumns({
        "relationship_type": F.when(c("relationship_type") == "RELATED", "UNCERTAIN").otherwise(c("relationship_type")), "confidence": c("type_confidence"),
        "type_conflict": c("event_id") % 19 == 0, "location_conflict": c("event_id") % 23 == 0,
    })
    return U.route_review(j).select("link_id", "new_status")


@query("override_protect", "SELECT incident_id, CASE WHEN overridden THEN urgency ELSE 'HIGH' END AS urgency, CASE WHEN overridden THEN people_at_risk_count ELSE 3 END AS people_at_risk_count FROM incident")
def _(spark, d):
    i = view(spark, d, "incident").select("incident_id", "overridden", "urgency", "people_at_risk_count").withColumns({"new_urgency": F.lit("HIGH"), "new_people_at_risk_count": F.lit(3)})
    return U.protect(i, ("urgency", "people_at_risk_count")).select("incident_id", "urgency", "people_at_risk_count")


@query("recover_failed", "SELECT 'inc-' || report_id AS incident_id, report_id, 'NEEDS_REVIEW' AS status, 50.0::DOUBLE AS priority_score, 'MEDIUM' AS priority_level FROM pred WHERE processing_status = 'FAILED'")
def _(spark, d):
    return U.recover_failed(view(spark, d, "pred"))


@query("session_blocks", """WITH g AS (SELECT report_id, is_synthetic, reported_at, coalesce(epoch_us(reported_at) - epoch_us(lag(reported_at) OVER (PARTITION BY is_synthetic ORDER BY reported_at, report_id)) > 1800000000, true) AS s FROM report),
n AS (SELECT *, sum(s::INT) OVER (PARTITION BY is_synthetic ORDER BY reported_at, report_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT report_id, min(reported_at) OVER (PARTITION BY is_synthetic, k) AS block FROM n""")
def _(spark, d):
    return U.session_blocks(view(spark, d, "report"), 0.5).select("report_id", "block")


@query("session_blocks_all", """WITH g AS (SELECT report_id, is_synthetic, reported_at, coalesce(epoch_us(reported_at) - epoch_us(lag(reported_at) OVER (PARTITION BY is_synthetic ORDER BY reported_at, report_id)) > 21600000000, true) AS s FROM report),
n AS (SELECT *, sum(s::INT) OVER (PARTITION BY is_synthetic ORDER BY reported_at, report_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT report_id, min(reported_at) OVER (PARTITION BY is_synthetic, k) AS block FROM n""")
def _(spark, d):
    return U.session_blocks(view(spark, d, "report")).select("report_id", "block")
