"""Queries over the text jobs, with a test lexicon of words that occur in the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.config import INCIDENT_TYPES
from muster.operators import text as T
from muster.plans.registry import query
from muster.plans.views import table, view

c = F.col
TEST = (
    ("FIRE_WILDFIRE_EXPLOSION", "keyword", "the"), ("FLOOD_FLASH_FLOOD", "keyword", "that"), ("FLOOD_FLASH_FLOOD", "keyword", "with"), ("MEDICAL_EMERGENCY", "keyword", "this"),
    ("FIRE_WILDFIRE_EXPLOSION", "keyword", "are"), ("STRUCTURAL_COLLAPSE", "phrase", "of the"), ("MEDICAL_EMERGENCY", "phrase", "in the"), ("SEVERE_WEATHER_STORM", "keyword", "than"),
    ("OTHER_GENERAL_INCIDENT", "keyword", "from"),
)
VALUES = "lex(class, tier, term) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in TEST) + ")"
HITS = f"""{VALUES}, tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}'']+') AS w FROM documents), nrm AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM tok),
hits AS (SELECT doc_id, class, tier, term FROM nrm JOIN lex ON contains(t, ' ' || term || ' ')),
kw AS (SELECT doc_id, class, round(least(1.0, sum(CASE tier WHEN 'phrase' THEN 2.0 ELSE 1.0 END)::DOUBLE / 2.5), 4) AS score FROM hits GROUP BY ALL)"""


def lexicon(spark):
    return T.terms(spark, TEST, "class string, tier string, term string")


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


# The same classes of blanks and controls in both engines.
CLEAN = r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2060}\x{feff}]', ' ', 'g'), '[ \xa0]+', ' ', 'g'), ' +([!?,.:;])', '\1', 'g'))) AS clean FROM documents"""


@query("clean_text", CLEAN)
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.tidy_spaces(c("text")).cast("binary")).alias("clean"))


@query("clean_text_all", CLEAN)
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.tidy_spaces(c("text")).cast("binary")).alias("clean"))


@query("clean_reports")
def _(spark, d):
    return T.clean_reports(table(spark, d, "pages").select("page_id", c("html").alias("text"))).drop("text")


@query("lexicon_hits", f"WITH {HITS} SELECT doc_id, class, term FROM hits")
def _(spark, d):
    return T.lexicon_hits(docs(spark, d), lexicon(spark), "doc_id", longest=2).select("doc_id", "class", "term")


@query("keyword_scores", f"WITH {HITS} SELECT doc_id, class, score FROM kw")
def _(spark, d):
    return T.keyword_scores(docs(spark, d), lexicon(spark), "doc_id", longest=2)


PROTO = "pr AS (SELECT ['" + "','".join(INCIDENT_TYPES) + "'][vec_id % 9 + 1] AS class, embedding::DOUBLE[] AS proto FROM embeddings WHERE vec_id < 27)"
COS = f"""{PROTO}, cs AS (SELECT vec_id, class, max(round(greatest(-1, least(1, list_dot_product(embedding::DOUBLE[], proto) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(proto, proto))))), 4)) AS cos FROM embeddings, pr GROUP BY ALL)"""


def protos(spark, d):
    kind = F.element_at(F.array(*map(F.lit, INCIDENT_TYPES)), (c("vec_id") % 9 + 1).cast("int"))
    return table(spark, d, "embeddings").where("vec_id < 27").select(kind.alias("class"), c("embedding").alias("proto"))


@query("prototype_scores", f"WITH {COS} SELECT vec_id, class, cos + 0.0 AS cos FROM cs")
def _(spark, d):
    # a rounded -0.0 becomes 0.0
    return T.prototype_scores(table(spark, d, "embeddings"), protos(spark, d), "vec_id").withColumn("cos", c("cos") + 0.0)


@query("semantic_scores", f"WITH {COS} SELECT vec_id, class, round(greatest(0, least(1, (cos - 0.2) / 0.5)), 4) AS score FROM cs")
def _(spark, d):
    return T.semantic_scores(table(spark, d, "embeddings"), protos(spark, d), "vec_id")


@query("top_classes", f"WITH {COS} SELECT vec_id, class, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, class) AS rank FROM cs QUALIFY rank <= 3")
def _(spark, d):
    from muster.operators.queue import top_classes

    s = T.prototype_scores(table(spark, d, "embeddings"), protos(spark, d), "vec_id")
    return top_classes(s.select(c("vec_id").alias("report_id"), "class", c("cos").alias("score"), c("class").alias("class_rank"))).select(c("report_id").alias("vec_id"), "class", "rank")


ORDER = "['" + "','".join(INCIDENT_TYPES) + "']"
PREC = "['" + "','".join(T.PRECEDENCE) + "']"


@query("classify", f"""WITH {HITS}, al AS (SELECT d.doc_id, k.class, coalesce(kw.score, 0) AS score FROM documents d CROSS JOIN (SELECT unnest({ORDER}) AS class) k LEFT JOIN kw ON kw.doc_id = d.doc_id AND kw.class = k.class),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, array_position({ORDER}, class)) AS r FROM al),
tp AS (SELECT a.doc_id, a.class AS l1, a.score AS s1, b.class AS l2, b.score AS s2 FROM rk a JOIN rk b ON a.doc_id = b.doc_id AND a.r = 1 AND b.r = 2),
sw AS (SELECT *, abs(s1 - s2) < 0.03 AND s1 > 0.1 AND array_position({PREC}, l2) < array_position({PREC}, l1) AS x FROM tp),
z AS (SELECT doc_id, CASE WHEN x THEN l2 ELSE l1 END AS l, CASE WHEN x THEN s2 ELSE s1 END AS t, CASE WHEN x THEN s1 ELSE s2 END AS s,
 CASE WHEN s2 >= 0.35 AND s2 >= 0.7 * s1 AND l1 <> 'OTHER_GENERAL_INCIDENT' AND l2 <> 'OTHER_GENERAL_INCIDENT' THEN l2 END AS secondary_hazard FROM sw),
y AS (SELECT *, round(CASE WHEN t < 0.35 THEN greatest(0.2, least(0.48, t)) WHEN l = 'OTHER_GENERAL_INCIDENT' THEN least(0.7, t) ELSE least(1.0, greatest(0.1, t + 0.05 * (t - s))) END::DOUBLE, 2) AS confidence FROM z)
SELECT doc_id, CASE WHEN t < 0.35 THEN 'OTHER_GENERAL_INCIDENT' ELSE l END AS incident_type, confidence, CASE WHEN t < 0.35 OR confidence < 0.6 THEN 'NEEDS_REVIEW' ELSE 'SUCCESS' END AS type_status, secondary_hazard FROM y""")
def _(spark, d):
    return T.classify(docs(spark, d), T.keyword_scores(docs(spark, d), lexicon(spark), "doc_id", longest=2), "doc_id")


@query("risk_signals", f"WITH {HITS} SELECT doc_id, list_sort(list_distinct(list(substr(class, 1, 5)))) AS signals FROM hits GROUP BY 1")
def _(spark, d):
    lex = lexicon(spark).select(F.substring("class", 1, 5).alias("signal"), "term")
    return T.risk_signals(docs(spark, d), lex, "doc_id")


@query("people_at_risk", "SELECT report_id, (event_id % 30)::INT AS people_count, 0.75::DOUBLE AS people_confidence, NULL::VARCHAR AS people_warning FROM report")
def _(spark, d):
    r = view(spark, d, "report").select("report_id", F.concat(F.lit("about "), (c("event_id") % 30).cast("string"), F.lit(" people trapped near room 12")).alias("text"))
    return T.people_at_risk(r)


@query("vocab_entities", f"WITH {HITS} SELECT doc_id, tier AS entity_type, term FROM hits")
def _(spark, d):
    return T.vocab_entities(docs(spark, d), lexicon(spark).select("term", c("tier").alias("entity_type")), "doc_id")


@query("entities")
def _(spark, d):
    return T.extract_entities(docs(spark, d), lexicon(spark).select("term", c("tier").alias("entity_type")), "doc_id")


@query("primary_location", """WITH p AS (SELECT report_id, array_to_string(list_transform(string_split(location_text, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS place FROM report)
SELECT report_id, place, CASE WHEN place IS NULL THEN 'UNKNOWN' ELSE 'APPROXIMATE' END AS place_precision, CASE WHEN place IS NOT NULL THEN 0.75::DOUBLE END AS place_confidence FROM p""")
def _(spark, d):
    r = view(spark, d, "report").select("report_id", F.concat(F.lit("fire near "), F.initcap(F.lower("location_text")), F.lit(" now")).alias("text"))
    return T.extract_location(r)


RT = (("MEDICAL_EMS", "strong", "the"), ("MEDICAL_EMS", "strong", "this"), ("FIRE_HAZMAT", "supporting", "that"), ("SEARCH_AND_RESCUE", "strong", "with"), ("SEARCH_AND_RESCUE", "negation", "of the"), ("ANY", "doubt", "than"))


@query("required_responses", f"""WITH rt(class, tier, term) AS (VALUES {', '.join(str(x) for x in RT)}), {HITS.replace('hits AS', 'h0 AS').replace('FROM hits', 'FROM h0')},
hh AS (SELECT doc_id, rt.class, rt.tier FROM nrm JOIN rt ON contains(t, ' ' || rt.term || ' ')), dt AS (SELECT DISTINCT doc_id FROM hh WHERE tier = 'doubt'),
g AS (SELECT doc_id, class, count(*) FILTER (WHERE tier = 'strong') AS s, count(*) FILTER (WHERE tier = 'supporting') AS p, count(*) FILTER (WHERE tier = 'negation') AS n FROM hh WHERE class <> 'ANY' GROUP BY ALL),
k AS (SELECT doc_id, class, round((CASE WHEN s > 0 THEN CASE WHEN doc_id IN (FROM dt) THEN greatest(0.55, CASE WHEN s >= 2 THEN 0.94 ELSE 0.92 END - 0.22) ELSE CASE WHEN s >= 2 THEN 0.94 ELSE 0.92 END END ELSE CASE WHEN doc_id IN (FROM dt) THEN greatest(0.5, 0.72 - 0.18) ELSE 0.72 END END)::DOUBLE, 2) AS cf FROM g WHERE n = 0 AND s + p > 0)
SELECT doc_id, list(class || ':' || printf('%.2f', cf) ORDER BY array_position(['SEARCH_AND_RESCUE','MEDICAL_EMS','FIRE_HAZMAT'], class)) AS responses FROM k GROUP BY 1""")
def _(spark, d):
    r = T.required_responses(docs(spark, d), T.terms(spark, RT, "class string, tier string, term string"), "doc_id")
    return r.select("doc_id", F.transform("responses", lambda x: F.concat(x["type"], F.lit(":"), F.format_string("%.2f", x["confidence"]))).alias("responses"))


UT = (
    ("life", "TRAPPED", 85.0, "this"), ("life", "INJURED", 50.0, "with"), ("velocity", "ACTIVE_FIRE", 70.0, "that"), ("vulnerable", "CHILDREN_AT_RISK", 85.0, "than"),
    ("negation", "TRAPPED", 0.0, "of the"), ("distress", "PLEA", 15.0, "are"), ("temporal", "NOW", 15.0, "from"), ("contained", "CONTAINED", 0.0, "in the"),
)


def urgent(spark, d):
    lex = T.terms(spark, UT, "dim string, signal string, base double, term string")
    return T.score_urgency(docs(spark, d).withColumn("people_count", (c("doc_id") % 25).cast("int")), lex, "doc_id")


URG = f"""ut(dim, signal, base, term) AS (VALUES {', '.join(str(x) for x in UT)}), {HITS}, uh AS (SELECT DISTINCT doc_id, dim, signal, base FROM nrm JOIN ut ON contains(t, ' ' || ut.term || ' ')),
f AS (SELECT d.doc_id, d.text, d.doc_id % 25 AS n, coalesce(bool_or(signal = 'TRAPPED' AND dim = 'life'), false) AS tr, coalesce(bool_or(dim = 'negation'), false) AS ng, coalesce(bool_or(signal = 'INJURED'), false) AS ij, coalesce(bool_or(dim = 'velocity'), false) AS ve,
 coalesce(bool_or(dim = 'vulnerable'), false) AS vu, coalesce(bool_or(dim = 'distress'), false) AS di, coalesce(bool_or(dim = 'temporal'), false) AS te, coalesce(bool_or(dim = 'contained'), false) AS co FROM documents d LEFT JOIN uh USING (doc_id) GROUP BY ALL),
f2 AS (SELECT *, tr AND NOT ng AS t2, CASE WHEN n >= 20 THEN 50 WHEN n >= 10 THEN 45 WHEN n >= 5 THEN 35 WHEN n >= 2 THEN 25 WHEN n = 1 THEN 15 ELSE 0 END AS st, di::INT * 15 AS dd, CASE WHEN tr AND NOT ng THEN 85 WHEN ij THEN 50 ELSE 0 END AS lb FROM f),
f3 AS (SELECT *, least(100, CASE WHEN lb > 0 THEN lb + st + CASE WHEN t2 AND ij THEN 5 ELSE 0 END + dd ELSE dd END)::DOUBLE AS life_safety, CASE WHEN co THEN least(15.0, ve::INT * 70 * 0.15) ELSE ve::INT * (70 + te::INT * 15) END::DOUBLE AS velocity, vu::INT * 85.0::DOUBLE AS vulnerability FROM f2),
f4 AS (SELECT *, round(0.5::DOUBLE * life_safety + 0.3::DOUBLE * velocity + 0.2::DOUBLE * vulnerability, 2) AS us FROM f3)"""


@query("urgency", f"WITH {URG} SELECT doc_id, life_safety, round(velocity, 2) AS velocity, vulnerability, CASE WHEN us >= 80 THEN 'CRITICAL' WHEN us >= 60 THEN 'HIGH' WHEN us >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM f4")
def _(spark, d):
    return urgent(spark, d).select("doc_id", "life_safety", "velocity", "vulnerability", "urgency")


@query("urgency_confidence", f"""WITH {URG} SELECT doc_id, round(greatest(0.1, least(0.98, 0.7::DOUBLE + CASE WHEN n > 0 THEN 0.1 ELSE 0 END + CASE WHEN (life_safety >= 50)::INT + (velocity >= 50)::INT + (vulnerability >= 50)::INT >= 2 THEN 0.08 ELSE 0 END
 + CASE WHEN di THEN 0.05 ELSE 0 END + CASE WHEN (ng AND lb = 0) OR co THEN 0.1 ELSE 0 END - CASE WHEN len(string_split_regex(trim(text), '\\s+')) <= 3 OR length(text) < 20 THEN 0.15 ELSE 0 END - CASE WHEN co AND ve THEN 0.1 ELSE 0 END)), 2) AS confidence FROM f4""")
def _(spark, d):
    u = urgent(spark, d)
    return u.select("doc_id", T.urgency_confidence(u).alias("confidence"))


@query("processing_status", "SELECT report_id, CASE WHEN event_id % 31 = 0 THEN 'FAILED' WHEN event_id % 29 = 0 THEN 'NEEDS_REVIEW' WHEN type_confidence < 0.6 THEN 'NEEDS_REVIEW' WHEN type_confidence IS NOT NULL THEN CASE WHEN event_id % 7 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END WHEN event_id % 7 = 0 THEN 'PARTIAL' ELSE 'NEEDS_REVIEW' END AS status FROM pred")
def _(spark, d):
    e = c("event_id")
    return view(spark, d, "pred").select("report_id", T.resolve_status(c("type_confidence"), e % 7 == 0, e % 29 == 0, e % 31 == 0).alias("status"))


@query("embed")
def _(spark, d):
    return T.embed(docs(spark, d), key="doc_id")


def tables(spark):
    from muster.sources.readers import load_lexicon

    return (
        load_lexicon(spark), T.terms(spark, T.RISK_TERMS, "signal string, term string"), T.terms(spark, T.RESPONSE_TERMS, "class string, tier string, term string"),
        T.terms(spark, T.URGENCY_TERMS, "dim string, signal string, base double, term string"),
    )


@query("enrich")
def _(spark, d):
    return T.enrich(docs(spark, d), *tables(spark), key="doc_id").drop("text")


def whole(spark, d, lightweight):
    """The documents as raw reports; a class' prototype text is its words in the lexicon."""
    from muster.sources.readers import load_lexicon

    words = load_lexicon(spark)
    texts = words.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("text"))
    gazetteer = lexicon(spark).select("term", c("tier").alias("entity_type"))
    return T.enrich_full(docs(spark, d), *tables(spark), gazetteer, T.prototype_vectors(texts), lightweight=lightweight, key="doc_id").drop("text")


@query("enrich_full")
def _(spark, d):
    return whole(spark, d, False)


@query("enrich_light")
def _(spark, d):
    return whole(spark, d, True)
