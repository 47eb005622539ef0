"""Queries over the positional lexicon automaton: reports woven from sentences and documents.

A report is a sentence, by the document's id, before the whole document, whose vowels are taken out: so it holds no term. What each sentence asks for is written beside it
by hand, so the twins repeat no rule of the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import lexscan as X
from muster.operators import text as T
from muster.operators.terms import response_rows, urgency_rows
from muster.plans.registry import query
from muster.plans.views import table

c = F.col

# sentence, responses with their confidence, life safety, velocity, vulnerability, label
WOVEN = (
    ("No injuries reported downtown. Two people injured at the mill.", "MEDICAL_EMS:0.92", 50, 0, 0, "LOW"),
    ("There is no fire, no injuries.", "", 0, 0, 0, "LOW"),
    ("Maybe a fire at the mill.", "FIRE_HAZMAT:0.70", 0, 70, 0, "LOW"),
    ("Fire at the mill and an explosion; two children trapped.", "SEARCH_AND_RESCUE:0.92 FIRE_HAZMAT:0.94", 85, 70, 85, "CRITICAL"),
    ("The fire drill went well.", "", 0, 0, 0, "LOW"),
    ("Smoke over the yard, possibly a burst pipe.", "FIRE_HAZMAT:0.54 PUBLIC_WORKS_UTILITY:0.70", 0, 0, 0, "LOW"),
    ("An ambulance is needed, a man is unconscious and bleeding.", "MEDICAL_EMS:0.94", 85, 0, 0, "MEDIUM"),
    ("Armed man near the bank but nobody armed was seen later.", "POLICE_SECURITY:0.92", 0, 0, 0, "LOW"),
    ("Nobody hurt.", "", 0, 0, 0, "LOW"),
    ("Power line down, no power in the street.", "PUBLIC_WORKS_UTILITY:0.92", 0, 0, 0, "LOW"),
    ("Everyone got out. The roof collapsed.", "", 0, 75, 0, "LOW"),
    ("Good morning to you.", "", 0, 0, 0, "LOW"),
)
SAID = f"said(k, sentence, responses, life, speed, frail, urgency) AS (VALUES {', '.join(str((k, *x)) for k, x in enumerate(WOVEN))})"


def woven(spark, d):
    said = F.array(*[F.lit(x[0]) for x in WOVEN])
    k = F.pmod(c("doc_id"), F.lit(len(WOVEN))).cast("int")
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.get(said, k), F.translate("text", "aeiouyAEIOUY", "")).alias("text"))


def lexicons(spark):
    from muster.sources.readers import load_lexicon

    return X.entries(
        load_lexicon(spark), T.terms(spark, T.RISK_TERMS, "signal string, term string"), T.terms(spark, response_rows(), "class string, tier string, term string"),
        T.terms(spark, urgency_rows(), "dim string, signal string, base double, term string"),
    )


def listed(responses):
    one = F.transform(responses, lambda x: F.concat(x["type"], F.lit(":"), F.format_string("%.2f", x["confidence"])))
    return F.coalesce(F.array_join(one, " "), F.lit("")).alias("responses")


@query("scoped_responses", f"WITH {SAID} SELECT doc_id, responses FROM documents JOIN said ON k = doc_id % {len(WOVEN)}")
def _(spark, d):
    return X.with_hits(woven(spark, d), lexicons(spark)).select("doc_id", listed(X.responses_of(c("__h"))))


@query("scoped_urgency", f"WITH {SAID} SELECT doc_id, life::DOUBLE AS life_safety, speed::DOUBLE AS velocity, frail::DOUBLE AS vulnerability, urgency FROM documents JOIN said ON k = doc_id % {len(WOVEN)}")
def _(spark, d):
    u = X.with_hits(woven(spark, d), lexicons(spark)).select("doc_id", X.urgency_of(c("__h"), F.lit(None).cast("int")).alias("u"))
    return u.select("doc_id", "u.life_safety", "u.velocity", "u.vulnerability", "u.urgency")


@query("enrich_rows")
def _(spark, d):
    return X.enrich_rows(woven(spark, d), lexicons(spark)).drop("text")


@query("enrich_stream", f"WITH {SAID} SELECT doc_id, responses FROM documents JOIN said ON k = doc_id % {len(WOVEN)}")
def _(spark, d):
    from muster.plans.q_stream import drained, stream_of

    stream = stream_of(spark, woven(spark, d))
    return drained(spark, X.enrich_rows(stream, lexicons(spark)).select("doc_id", listed(c("responses"))))


@query("gazetteer_spans", """WITH t AS (SELECT r_name AS term FROM region UNION SELECT replace(lower(n_name), '_', ' ') FROM nation),
w AS (SELECT report_id, ' ' || lower(coalesce(replace(location_text, 'NATION_', 'nation '), '')) || ' ' AS p FROM report)
SELECT report_id, list_sort(list(lower(term))) AS found FROM w JOIN t ON contains(p, ' ' || lower(term) || ' ') GROUP BY 1""")
def _(spark, d):
    from muster.plans.views import view

    terms = table(spark, d, "region").select(F.lower("r_name").alias("term")).union(table(spark, d, "nation").select(F.lower("n_name").alias("term")))
    gazetteer = terms.select(F.regexp_replace("term", "[^a-z0-9']+", " ").alias("term"), F.lit("REGION").alias("entity_type"))
    r = view(spark, d, "report").select("report_id", F.regexp_replace("location_text", "NATION_", "nation ").alias("text"))
    found = X.positional_hits(r, gazetteer).join(r, "report_id")
    return found.select("report_id", F.array_sort(F.transform("spans", lambda s: F.lower(F.col("text").substr(s["start"] + 1, s["end"] - s["start"])))).alias("found"))
