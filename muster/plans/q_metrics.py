"""Queries over the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import aggregates as A
from muster.operators import metrics as M
from muster.plans.registry import query
from muster.plans.views import table, view

c = F.col
R = lambda a, b, e="0.0": f"CASE WHEN ({b}) > 0 THEN round(({a}) / ({b}), 4) ELSE {e}::DOUBLE END"
CI = lambda p: f"(count(*) FILTER (WHERE {p}))"


@query("confusion", "SELECT true_urgency AS y_true, pred_urgency AS y_pred, count(*) AS n FROM label GROUP BY ALL")
def _(spark, d):
    return M.confusion(view(spark, d, "label"), "true_urgency", "pred_urgency")


@query("class_report", f"""WITH k AS (SELECT DISTINCT true_urgency AS class FROM label), z AS (SELECT k.class, {CI('true_urgency = class AND pred_urgency = class')} AS tp, {CI('true_urgency <> class AND pred_urgency = class')} AS fp,
 {CI("true_urgency = class AND coalesce(pred_urgency, '') <> class")} AS fn, {CI("true_urgency <> class AND coalesce(pred_urgency, '') <> class")} AS tn FROM k, label GROUP BY 1)
SELECT class, tp, fp, fn, tn, {R('tp', 'tp + fp')} AS precision, {R('tp', 'tp + fn')} AS recall, {R('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS support FROM z""")
def _(spark, d):
    return M.class_report(view(spark, d, "label"), "true_urgency", "pred_urgency")


@query("critical_recall", f"""WITH g AS (SELECT true_group, bool_or(true_urgency = 'CRITICAL') AS t, bool_or(true_urgency = 'CRITICAL' AND coalesce(pred_urgency, '') = 'CRITICAL') AS h FROM label GROUP BY 1),
u AS (SELECT 'report' AS grain, {CI("true_urgency = 'CRITICAL'")} AS n, {CI("true_urgency = 'CRITICAL' AND pred_urgency = 'CRITICAL'")} AS found FROM label UNION ALL SELECT 'incident', {CI('t')}, {CI('t AND h')} FROM g)
SELECT *, {R('found', 'n', 'NULL')} AS recall, {R('n - found', 'n', 'NULL')} AS miss_rate FROM u""")
def _(spark, d):
    return M.critical_recall(view(spark, d, "label"), "true_group", "doc_id")


LV = "array_position(['LOW','MEDIUM','HIGH','CRITICAL'], {})"


@query("urgency_alignment", f"SELECT round(avg(abs({LV.format('true_urgency')} - {LV.format('pred_urgency')})) FILTER (WHERE pred_urgency IS NOT NULL), 4) AS mae, " + R(CI("true_urgency IN ('HIGH','CRITICAL') AND pred_urgency IN ('HIGH','CRITICAL')"), CI("true_urgency IN ('HIGH','CRITICAL')")) + " AS high_recall FROM label")
def _(spark, d):
    return M.urgency_alignment(view(spark, d, "label"))


@query("pair_metrics", f"""WITH p AS (SELECT a.true_group = b.true_group AS t, a.pred_group = b.pred_group AS q FROM label a JOIN label b ON a.doc_id < b.doc_id),
s AS (SELECT {CI('t AND q')} AS tp, {CI('NOT t AND q')} AS fp, {CI('t AND NOT q')} AS fn, {CI('NOT t AND NOT q')} AS tn FROM p)
SELECT *, {R('tp', 'tp + fp')} AS precision, {R('tp', 'tp + fn')} AS recall, {R('2 * tp', '2 * tp + fp + fn')} AS f1, {R('tp + tn', 'tp + fp + fn + tn')} AS rand FROM s""")
def _(spark, d):
    return M.pair_metrics(view(spark, d, "label"), "true_group", "pred_group")


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY true_group) + (count(*) OVER (PARTITION BY true_group) - 1) / 2.0 AS b FROM label) SELECT round(corr(a, b), 4) AS spearman, count(*) AS n FROM r")
def _(spark, d):
    return M.spearman(view(spark, d, "label"), "score", "true_group")


MULTI = "(SELECT list_filter([CASE WHEN doc_id % 2 = 0 THEN 'A' END, CASE WHEN doc_id % 3 = 0 THEN 'B' END], lambda x: x IS NOT NULL) AS t, list_filter([CASE WHEN doc_id % 4 = 0 THEN 'A' END, CASE WHEN doc_id % 3 = 0 THEN 'B' END, CASE WHEN doc_id % 7 = 0 THEN 'C' END], lambda x: x IS NOT NULL) AS p FROM label)"


@query("multilabel", f"""WITH s AS (SELECT sum(len(list_intersect(t, p))) AS tp, sum(len(p) - len(list_intersect(t, p))) AS fp, sum(len(t) - len(list_intersect(t, p))) AS fn, count(*) AS n,
 {CI('len(list_intersect(t, p)) = len(t) AND len(t) = len(p)')} AS ex, {CI('len(t) = 0 AND len(p) > 0')} AS fe, {CI('len(t) = 0')} AS em FROM {MULTI})
SELECT {R('tp', 'tp + fp')} AS micro_precision, {R('tp', 'tp + fn')} AS micro_recall, {R('2 * tp', '2 * tp + fp + fn')} AS micro_f1, {R('ex', 'n')} AS exact_rate, {R('fe', 'em')} AS false_positive_rate FROM s""")
def _(spark, d):
    some = lambda *p: F.array_compact(F.array(*[F.when(c("doc_id") % m == 0, k) for m, k in p]))
    v = view(spark, d, "label").select(some((2, "A"), (3, "B")).alias("t"), some((4, "A"), (3, "B"), (7, "C")).alias("p"))
    return M.multilabel(v, "t", "p")


@query("multilabel_macro", f"""WITH e AS (SELECT l, list_contains(t, l) AS a, list_contains(p, l) AS b FROM (SELECT t, p, unnest(['A', 'B', 'C']) AS l FROM {MULTI})),
g AS (SELECT l, {CI('a AND b')} AS tp, {CI('NOT a AND b')} AS fp, {CI('a AND NOT b')} AS fn FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE a OR b) > 0)
SELECT round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 4) AS macro_precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 4) AS macro_recall, round(avg(2 * tp / (2 * tp + fp + fn)), 4) AS macro_f1, count(*) AS labels FROM g""")
def _(spark, d):
    some = lambda *p: F.array_compact(F.array(*[F.when(c("doc_id") % m == 0, k) for m, k in p]))
    v = view(spark, d, "label").select(some((2, "A"), (3, "B")).alias("t"), some((4, "A"), (3, "B"), (7, "C")).alias("p"))
    return M.multilabel_macro(v, "t", "p")


@query("critical_missed", """SELECT 'report' AS grain, doc_id::VARCHAR AS id FROM label WHERE true_urgency = 'CRITICAL' AND pred_urgency IS DISTINCT FROM 'CRITICAL'
UNION ALL SELECT 'incident', true_group::VARCHAR FROM label WHERE true_urgency = 'CRITICAL' GROUP BY true_group HAVING NOT bool_or(coalesce(pred_urgency = 'CRITICAL', false))""")
def _(spark, d):
    return M.missed_critical(view(spark, d, "label"), "true_group", "doc_id")


@query("location_metrics", f"""WITH z AS (SELECT location_text AS t, CASE WHEN event_id % 7 <> 0 THEN location_text END AS p, latitude AS tl, CASE WHEN event_id % 4 = 0 THEN 20.25::DOUBLE WHEN event_id % 5 = 0 THEN NULL ELSE latitude END AS pl FROM report)
SELECT {R(CI('t IS NOT NULL AND p IS NOT NULL'), CI('t IS NOT NULL'))} AS presence, {R(CI('t = p'), CI('t IS NOT NULL'))} AS text_match, {R(CI('pl IS NOT NULL AND tl IS NULL'), 'count(*)')} AS hallucination,
 {R(CI('tl IS NOT NULL AND pl IS NOT NULL'), CI('tl IS NOT NULL'))} AS recall, round(avg(6371.0 * radians(abs(tl - pl))), 4) AS mean_km FROM z""")
def _(spark, d):
    e = c("event_id")
    r = view(spark, d, "report").select(
        c("location_text").alias("true_text"), F.when(e % 7 != 0, c("location_text")).alias("pred_text"), c("latitude").alias("true_lat"), F.lit(85.8).alias("true_lon"),
        F.when(e % 4 == 0, 20.25).when(e % 5 != 0, c("latitude")).alias("pred_lat"), F.lit(85.8).alias("pred_lon"),
    )
    return M.location_metrics(r)


@query("people_metrics", f"""WITH z AS (SELECT people_count AS t, CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 7 = 0 THEN NULL ELSE people_count END AS p FROM report), y AS (SELECT *, coalesce(t > 0, false) AS a, coalesce(p > 0, false) AS b FROM z)
SELECT {R(CI('a = b'), 'count(*)')} AS accuracy, {R(CI('a AND b'), CI('b'))} AS precision, {R(CI('a AND b'), CI('a'))} AS recall, round(avg(abs(t - p)), 4) AS mae, {R(CI('t = p'), CI('t IS NOT NULL AND p IS NOT NULL'))} AS exact_rate FROM y""")
def _(spark, d):
    e = c("event_id")
    return M.people_metrics(view(spark, d, "report").select(c("people_count").alias("true_count"), F.when(e % 5 == 0, 2).when(e % 7 != 0, c("people_count")).alias("pred_count")))


@query("coverage", f"""WITH z AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ['X', 'Y'] ELSE [] END AS r FROM label) SELECT count(*) AS total, {CI('len(r) = 0')} AS valid, {R(CI('len(r) = 0'), 'count(*)')} AS coverage,
 (SELECT list_sort(list(doc_id || ': X|Y')) FROM (SELECT doc_id FROM z WHERE len(r) > 0 ORDER BY doc_id LIMIT 20)) AS examples FROM z""")
def _(spark, d):
    v = view(spark, d, "label").withColumn("r", F.when(c("doc_id") % 9 == 0, F.array(F.lit("X"), F.lit("Y"))).otherwise(F.array().cast("array<string>")))
    return M.coverage(v, "doc_id", "r")


@query("roc_auc", "WITH p AS (SELECT (a.score > b.score)::INT + (a.score = b.score)::INT / 2.0 AS w FROM label a JOIN label b ON a.y_true = 1 AND b.y_true = 0) SELECT round(avg(w), 4) AS auc, (SELECT count(*) FROM label WHERE y_true = 1) AS positives, (SELECT count(*) FROM label WHERE y_true = 0) AS negatives FROM p")
def _(spark, d):
    return M.roc_auc(view(spark, d, "label"), "y_true", "score")


@query("roc_curve", "SELECT t.score AS threshold, round(count(*) FILTER (WHERE y_true = 1 AND l.score >= t.score) / count(*) FILTER (WHERE y_true = 1), 4) AS tpr, round(count(*) FILTER (WHERE y_true = 0 AND l.score >= t.score) / count(*) FILTER (WHERE y_true = 0), 4) AS fpr FROM (SELECT DISTINCT score FROM label) t, label l GROUP BY 1")
def _(spark, d):
    return M.roc_curve(view(spark, d, "label"), "y_true", "score")


@query("at_threshold", f"""WITH s AS (SELECT {CI('y_true = 1 AND score >= 0.5')} AS tp, {CI('y_true = 0 AND score >= 0.5')} AS fp, {CI('y_true = 1 AND score < 0.5')} AS fn, {CI('y_true = 0 AND score < 0.5')} AS tn FROM label)
SELECT *, {R('tp', 'tp + fp')} AS precision, {R('tp', 'tp + fn')} AS recall, {R('2 * tp', '2 * tp + fp + fn')} AS f1, {R('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM s""")
def _(spark, d):
    return M.at_threshold(view(spark, d, "label"), "y_true", "score", 0.5)


@query("relation_metrics", "SELECT k AS relation, " + R(CI("true_relation = k AND pred_relation = k"), CI("pred_relation = k")) + " AS precision, " + R(CI("true_relation = k AND pred_relation = k"), CI("true_relation = k")) + f" AS recall, {CI('true_relation = k')} AS support FROM label, (VALUES ('DUPLICATE'), ('CORROBORATING')) v(k) GROUP BY k")
def _(spark, d):
    return M.relation_metrics(view(spark, d, "label"))


@query("hard_negatives", "SELECT " + CI("true_relation = 'NOISE'") + " AS n, " + R(CI("true_relation = 'NOISE' AND pred_relation = 'INITIAL'"), CI("true_relation = 'NOISE'")) + " AS rejection_rate FROM label")
def _(spark, d):
    return M.hard_negatives(view(spark, d, "label"))


@query("dynamics", """WITH p AS (SELECT incident_id, count(*) FILTER (WHERE relationship_type = 'CORROBORATING') AS c, count(*) FILTER (WHERE relationship_type = 'DUPLICATE') AS d FROM link GROUP BY 1)
SELECT 'corroboration_raises' AS assertion, CASE WHEN c > 0 THEN 'PASS' ELSE 'NOT_EVALUATED' END AS verdict, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'duplicates_do_not_raise', CASE WHEN c = 0 AND d > 0 THEN 'PASS' ELSE 'NOT_EVALUATED' END, count(*) FROM p GROUP BY ALL""")
def _(spark, d):
    return M.dynamics(view(spark, d, "link"))


@query("separation", """WITH p AS (SELECT a.label = b.label AS positive, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT round(avg(s) FILTER (WHERE positive), 3) AS positive_mean, round(avg(s) FILTER (WHERE NOT positive), 3) AS negative_mean, round(avg(s) FILTER (WHERE positive) - avg(s) FILTER (WHERE NOT positive), 3) AS margin, true AS symmetric, true AS self_similar FROM p""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("vb"), c("label").alias("lb"))
    return M.separation(e.withColumnRenamed("embedding", "va").join(b, "vec_id").withColumn("positive", c("label") == c("lb")))


@query("range_adherence", "SELECT count(*) AS n, round(count(*) FILTER (WHERE priority_score BETWEEN 5 AND 50) / count(*), 4) AS rate FROM calc")
def _(spark, d):
    return M.range_adherence(view(spark, d, "calc").withColumns({"lo": F.lit(5.0), "hi": F.lit(50.0)}), "priority_score", "lo", "hi")


@query("entity_metrics_exact", """SELECT 'PLACE' AS type, count(*) FILTER (WHERE location_text IS NOT NULL AND event_id % 9 <> 0) AS tp, count(*) FILTER (WHERE location_text IS NOT NULL AND event_id % 9 = 0) AS fp,
 count(*) FILTER (WHERE location_text IS NOT NULL AND event_id % 9 = 0) AS fn, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM report""")
def _(spark, d):
    r = view(spark, d, "report").where("location_text is not null")
    true = r.select("report_id", F.lit("place").alias("type"), c("location_text").alias("text"))
    pred = r.select("report_id", F.lit("PLACE").alias("type"), F.when(c("event_id") % 9 == 0, "elsewhere").otherwise(F.concat(F.lit(" "), F.lower("location_text"))).alias("text"))
    return M.entity_metrics_exact(true, pred)


@query("entity_metrics_greedy", f"""WITH s AS (SELECT {CI('event_id % 9 <> 0')} AS tp, {CI('event_id % 9 = 0')} AS fp, {CI('event_id % 9 = 0')} AS fn FROM report WHERE location_text IS NOT NULL)
SELECT grain, type, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {R('tp', 'tp + fp')} AS precision, {R('tp', 'tp + fn')} AS recall, {R('2 * tp', '2 * tp + fp + fn')} AS f1 FROM s, (VALUES ('joint'), ('span')) g(grain), (VALUES ('ALL'), ('PLACE')) t(type)""")
def _(spark, d):
    e = lambda t, k: F.struct(t.alias("text"), F.lit(k).alias("type"))
    r = view(spark, d, "report").where("location_text is not null")
    pred = F.when(c("event_id") % 9 == 0, F.array(e(F.lit("elsewhere"), "PLACE"))).otherwise(F.array(e(F.upper("location_text"), "PLACE")))
    return M.entity_metrics_greedy(r.select("report_id", F.array(e(c("location_text"), "PLACE")).alias("true"), pred.alias("pred")))


@query("contamination", r"SELECT doc_id FROM documents WHERE lang = 'en' AND regexp_replace(lower(trim(text)), '[\t\n\x0b\f\r ]+', ' ', 'g') IN (SELECT regexp_replace(lower(trim(text)), '[\t\n\x0b\f\r ]+', ' ', 'g') FROM documents WHERE lang <> 'en' OR doc_id % 50 = 0)")
def _(spark, d):
    docs = table(spark, d, "documents")
    return M.contamination(docs.where("lang = 'en'"), docs.where("lang <> 'en' or doc_id % 50 = 0")).select("doc_id")


@query("integrity", """SELECT 'orphan_links' AS metric, count(*) AS n FROM link WHERE incident_id NOT IN (SELECT incident_id FROM incident WHERE status <> 'RESOLVED') UNION ALL
 SELECT 'partition_violations', count(*) FROM link JOIN incident i USING (incident_id) JOIN report r USING (report_id) WHERE i.is_synthetic <> r.is_synthetic AND status <> 'RESOLVED' UNION ALL
 SELECT 'repeated_reports', count(*) - count(DISTINCT report_id) FROM link UNION ALL SELECT 'unlinked_reports', count(*) FROM report WHERE report_id NOT IN (SELECT report_id FROM link)""")
def _(spark, d):
    return M.integrity(view(spark, d, "link"), view(spark, d, "incident").where("status <> 'RESOLVED'"), view(spark, d, "report"))


@query("retry_delta", "SELECT 'link' AS table_name, 0::BIGINT AS delta UNION ALL SELECT 'audit', 0")
def _(spark, d):
    count = lambda: A.run_counts({k: (view(spark, d, k), "incident_id") for k in ("link", "audit")}, "inc-").select("table_name", "n")
    return M.retry_delta(count(), count())


@query("label_accuracy", "SELECT round(avg((true_urgency IS NOT DISTINCT FROM pred_urgency)::INT), 4) AS agreement, count(*) AS n FROM label")
def _(spark, d):
    return M.label_accuracy(view(spark, d, "label"), "true_urgency", "pred_urgency")
