"""Distributed evaluation metrics; every one reduces to counts before anything meets in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.config import URGENCIES
from muster.functions import scalars as S
from muster.operators.aggregates import rank_in
from muster.operators.queue import avg_rank
from muster.runtime import running_sums

LEVEL = {u: i + 1 for i, u in enumerate(URGENCIES)}


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(empty).cast("double"))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, F1 and support of every class, from the confusion counts."""
    cells = confusion(df, true, pred)
    right = F.when(F.col("y_true").eqNullSafe(F.col("y_pred")), F.col("n")).otherwise(0)
    rows = cells.select(F.col("y_true").alias("class"), F.col("n").alias("t"), F.lit(0).alias("p"), right.alias("tp")).unionByName(
        cells.select(F.col("y_pred").alias("class"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp"))
    )
    per = rows.where("class is not null").groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    total = df.agg(F.count("*").alias("total"))
    out = per.crossJoin(F.broadcast(total))
    out = out.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    out = out.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))).select("class", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "support")


def macro(report: DataFrame, supported_only: bool = True) -> DataFrame:
    rows = report.where("support > 0") if supported_only else report
    return rows.agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"))


def critical_recall(df: DataFrame, group: str, key: str) -> DataFrame:
    """At report and at group level: a group counts if any of its reports is critical, and as found if any is found."""
    hit = (F.col("true_urgency") == "CRITICAL") & (F.col("pred_urgency") == "CRITICAL")
    truth = F.col("true_urgency") == "CRITICAL"
    a = df.agg(F.count_if(truth).alias("n"), F.count_if(hit).alias("found")).withColumn("grain", F.lit("report"))
    per = df.groupBy(group).agg(F.max(truth.cast("int")).alias("t"), F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("h"))
    b = per.agg(F.count_if(F.col("t") == 1).alias("n"), F.count_if((F.col("t") == 1) & (F.col("h") == 1)).alias("found")).withColumn("grain", F.lit("incident"))
    both = a.unionByName(b)
    return both.select("grain", "n", "found", ratio(F.col("found"), F.col("n"), None).alias("recall"), ratio(F.col("n") - F.col("found"), F.col("n"), None).alias("miss_rate"))


def urgency_alignment(df: DataFrame) -> DataFrame:
    t, p = rank_in(F.col("true_urgency"), URGENCIES), rank_in(F.col("pred_urgency"), URGENCIES)
    both = (t > 0) & (p > 0)
    high = F.col("true_urgency").isin("HIGH", "CRITICAL")
    return df.agg(
        F.round(F.avg(F.when(both, F.abs(t - p))), 4).alias("mae"),
        ratio(F.count_if(high & F.col("pred_urgency").isin("HIGH", "CRITICAL")), F.count_if(high)).alias("high_recall"),
    )


def pair_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Pairwise precision, recall, F1 and Rand index from the contingency table, never from pairs."""
    two = lambda n: n * (n - 1) / 2
    cells = df.groupBy(true, pred).agg(F.count("*").cast("double").alias("n"))
    tp = cells.agg(F.sum(two(F.col("n"))).alias("tp"), F.sum("n").alias("total"))
    a = cells.groupBy(true).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("same_true"))
    b = cells.groupBy(pred).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("same_pred"))
    out = tp.crossJoin(a).crossJoin(b)  # one row each
    out = out.withColumns({"fp": F.col("same_pred") - F.col("tp"), "fn": F.col("same_true") - F.col("tp")})
    out = out.withColumn("tn", two(F.col("total")) - F.col("tp") - F.col("fp") - F.col("fn"))
    p, r = F.col("tp") / F.col("same_pred"), F.col("tp") / F.col("same_true")
    return out.select(
        *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")],
        ratio(F.col("tp"), F.col("same_pred")).alias("precision"), ratio(F.col("tp"), F.col("same_true")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("same_pred") + F.col("same_true")).alias("f1"), ratio(F.col("tp") + F.col("tn"), two(F.col("total")), 1.0).alias("rand"),
    )


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; a NaN counts as 0; null for a constant side."""
    clean = df.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in (a, b)])
    ranked = avg_rank(avg_rank(clean, a).withColumnRenamed("avg_rank", "_ra"), b).withColumnRenamed("avg_rank", "_rb")
    return ranked.agg(F.round(F.corr("_ra", "_rb"), 4).alias("spearman"), F.count("*").alias("n"))


def multilabel(df: DataFrame, true: str, pred: str) -> DataFrame:
    both = F.size(F.array_intersect(true, pred))
    t, p = F.size(F.array_distinct(true)), F.size(F.array_distinct(pred))
    out = df.agg(
        F.sum(both).alias("tp"), F.sum(p - both).alias("fp"), F.sum(t - both).alias("fn"), F.count("*").alias("n"),
        F.count_if((both == t) & (both == p)).alias("exact"), F.count_if((t == 0) & (p > 0)).alias("fp_empty"), F.count_if(t == 0).alias("empty"),
    )
    return out.select(
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("micro_precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("micro_recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("micro_f1"), ratio(F.col("exact"), F.col("n")).alias("exact_rate"),
        ratio(F.col("fp_empty"), F.col("empty")).alias("false_positive_rate"),
    )


def multilabel_macro(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Means over the labels that occur of each label's precision, recall and F1; an empty denominator counts as 0."""
    sides = F.array_union(F.array_distinct(true), F.array_distinct(pred))
    rows = df.select(true, pred, F.explode(sides).alias("label"))
    t, p = F.array_contains(true, F.col("label")), F.array_contains(pred, F.col("label"))
    per = rows.groupBy("label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    per = per.select(
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("p"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("r"),
        (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f"),
    )
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4)
    return per.agg(mean("p").alias("macro_precision"), mean("r").alias("macro_recall"), mean("f").alias("macro_f1"), F.count("*").alias("labels"))


def missed_critical(df: DataFrame, group: str, key: str) -> DataFrame:
    """``(grain, id)`` of every critical report, and every incident with one, that no critical prediction found."""
    t, p = F.col("true_urgency") == "CRITICAL", F.coalesce(F.col("pred_urgency") == "CRITICAL", F.lit(False))
    reports = df.where(t & ~p).select(F.lit("report").alias("grain"), F.col(key).cast("string").alias("id"))
    groups = df.where(t).groupBy(group).agg(F.max(p).alias("hit")).where(~F.col("hit"))
    return reports.unionByName(groups.select(F.lit("incident").alias("grain"), F.col(group).cast("string").alias("id")))


def location_metrics(df: DataFrame) -> DataFrame:
    """Presence, text match, coordinate hallucination and mean distance of predicted against expected places."""
    t, p = F.col("true_text"), F.col("pred_text")
    got, made = F.col("true_lat").isNotNull(), F.col("pred_lat").isNotNull()
    km = S.haversine_km(F.col("true_lat"), F.col("true_lon"), F.col("pred_lat"), F.col("pred_lon"))
    return df.agg(
        ratio(F.count_if(t.isNotNull() & p.isNotNull()), F.count_if(t.isNotNull())).alias("presence"),
        ratio(F.count_if(t.isNotNull() & S.text_match(t, p)), F.count_if(t.isNotNull())).alias("text_match"),
        ratio(F.count_if(made & ~got), F.count("*")).alias("hallucination"), ratio(F.count_if(got & made), F.count_if(got)).alias("recall"),
        F.round(F.avg(F.when(got & made, km)), 4).alias("mean_km"),
    )


def people_metrics(df: DataFrame) -> DataFrame:
    t, p = F.coalesce(F.col("true_count") > 0, F.lit(False)), F.coalesce(F.col("pred_count") > 0, F.lit(False))
    both = F.col("true_count").isNotNull() & F.col("pred_count").isNotNull()
    return df.agg(
        ratio(F.count_if(t == p), F.count("*")).alias("accuracy"), ratio(F.count_if(t & p), F.count_if(p)).alias("precision"),
        ratio(F.count_if(t & p), F.count_if(t)).alias("recall"), F.round(F.avg(F.when(both, F.abs(F.col("true_count") - F.col("pred_count")))), 4).alias("mae"),
        ratio(F.count_if(both & (F.col("true_count") == F.col("pred_count"))), F.count_if(both)).alias("exact_rate"),
    )


def coverage(df: DataFrame, key: str, reasons: str, keep: int = 20) -> DataFrame:
    """Share of valid rows and the reasons of the first ``keep`` others by key (a report's feature)."""
    bad = df.where(F.size(reasons) > 0).orderBy(key).limit(keep).agg(F.array_sort(F.collect_list(F.concat_ws(": ", key, F.array_join(reasons, "|")))).alias("examples"))
    total = df.agg(F.count("*").alias("total"), F.count_if(F.size(reasons) == 0).alias("valid"))
    return total.withColumn("coverage", ratio(F.col("valid"), F.col("total"))).crossJoin(bad)


def score_steps(df: DataFrame, true: str, score: str) -> DataFrame:
    """Positives and negatives at each distinct score, and how many lie at it or above, summed up along ranges of scores."""
    per = df.groupBy(score).agg(F.count_if(F.col(true) == 1).alias("pos"), F.count_if(F.col(true) == 0).alias("neg"))
    return running_sums(per, [F.desc(score)], ["pos", "neg"]).withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp"})


def roc_auc(df: DataFrame, true: str, score: str) -> DataFrame:
    """Mann-Whitney with ties as halves."""
    s = score_steps(df, true, score)
    wins = F.col("pos") * 0.0 + F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2.0
    out = s.agg(F.sum(wins).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(ratio(F.col("wins"), F.col("p") * F.col("n"), None).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def roc_curve(df: DataFrame, true: str, score: str) -> DataFrame:
    s = score_steps(df, true, score)
    total = df.agg(F.count_if(F.col(true) == 1).alias("p"), F.count_if(F.col(true) == 0).alias("n"))
    out = s.crossJoin(F.broadcast(total))
    return out.select(F.col(score).alias("threshold"), ratio(F.col("tp"), F.col("p")).alias("tpr"), ratio(F.col("fp"), F.col("n")).alias("fpr"))


def at_threshold(df: DataFrame, true: str, score: str, t: float) -> DataFrame:
    y, p = F.col(true) == 1, F.col(score) >= t
    out = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return out.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
    })


def relation_metrics(df: DataFrame, classes: tuple[str, ...] = ("DUPLICATE", "CORROBORATING")) -> DataFrame:
    out = None
    for k in classes:
        t, p = F.col("true_relation") == k, F.col("pred_relation") == k
        one = df.agg(
            ratio(F.count_if(t & p), F.count_if(p)).alias("precision"), ratio(F.count_if(t & p), F.count_if(t)).alias("recall"), F.count_if(t).alias("support"),
        ).withColumn("relation", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def hard_negatives(df: DataFrame) -> DataFrame:
    """Noise that was not merged into an incident."""
    noise = F.col("true_relation") == "NOISE"
    return df.agg(F.count_if(noise).alias("n"), ratio(F.count_if(noise & (F.col("pred_relation") == "INITIAL")), F.count_if(noise)).alias("rejection_rate"))


def dynamics(links: DataFrame) -> DataFrame:
    """Corroboration must end above its start where a corroborating report came; duplicates alone must not raise it."""
    per = links.groupBy("incident_id").agg(
        F.count_if(F.col("relationship_type") == "CORROBORATING").alias("c"), F.count_if(F.col("relationship_type") == "DUPLICATE").alias("d"),
    )
    per = per.withColumn("score", S.corroboration(1 + F.col("c")))
    raised = F.when(F.col("c") > 0, F.when(F.col("score") > 0.36, "PASS").otherwise("FAIL")).otherwise("NOT_EVALUATED")
    flat = F.when((F.col("c") == 0) & (F.col("d") > 0), F.when(F.col("score") <= 0.36, "PASS").otherwise("FAIL")).otherwise("NOT_EVALUATED")
    rows = per.select(F.explode(F.array(
        F.struct(F.lit("corroboration_raises").alias("assertion"), raised.alias("verdict")), F.struct(F.lit("duplicates_do_not_raise").alias("assertion"), flat.alias("verdict"))
    )).alias("x")).select("x.*")
    return rows.groupBy("assertion", "verdict").agg(F.count("*").alias("n"))


def separation(pairs: DataFrame, dim: int = 64) -> DataFrame:
    """``pairs(va, vb, positive)``: mean similarity of both kinds, margin, symmetry and self-similarity."""
    sim, back, own = S.cosine(F.col("va"), F.col("vb"), dim), S.cosine(F.col("vb"), F.col("va"), dim), S.cosine(F.col("va"), F.col("va"), dim)
    s = pairs.select("positive", sim.alias("s"), F.abs(sim - back).alias("asym"), own.alias("own"))
    out = s.agg(
        F.avg(F.when(F.col("positive"), F.col("s"))).alias("p"), F.avg(F.when(~F.col("positive"), F.col("s"))).alias("q"),
        (F.max("asym") <= 1e-4).alias("symmetric"), (F.min("own") >= 0.9999).alias("self_similar"),
    )
    return out.select(F.round("p", 3).alias("positive_mean"), F.round("q", 3).alias("negative_mean"), F.round(F.col("p") - F.col("q"), 3).alias("margin"), "symmetric", "self_similar")


def range_adherence(df: DataFrame, score: str, lo: str, hi: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), ratio(F.count_if(F.col(score).between(F.col(lo), F.col(hi))), F.count("*")).alias("rate"))


def entity_metrics_exact(true: DataFrame, pred: DataFrame) -> DataFrame:
    """``(report_id, type, text)`` on both sides, matched exactly on normalised spans, per type."""
    key = lambda df: df.select("report_id", F.upper("type").alias("type"), S.norm_span(F.col("text")).alias("text")).distinct()
    t, p = key(true).withColumn("t", F.lit(1)), key(pred).withColumn("p", F.lit(1))
    both = t.join(p, ["report_id", "type", "text"], "full").fillna(0, ["t", "p"])
    out = both.groupBy("type").agg(F.count_if((F.col("t") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if(F.col("t") == 0).alias("fp"), F.count_if(F.col("p") == 0).alias("fn"))
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def same_span(a: str | None, b: str | None) -> bool:
    """Equal or one inside the other, by lower-case words; an empty span equals only an empty one."""
    a, b = (" ".join((x or "").lower().split()) for x in (a, b))
    return a == b or bool(a and b and (a in b or b in a))


def greedy_pairs(true: list, pred: list, joint: bool) -> tuple[list[str], list[str], list[str]]:
    """Types of the matched true entities, of the predicted ones left, and of the true ones missed; in order, one to one."""
    left, hit, missed = list(pred), [], []
    for t in true:
        k = next((i for i, p in enumerate(left) if same_span(t["text"], p["text"]) and (not joint or t["type"] == p["type"])), None)
        if k is None:
            missed.append(t["type"])
        else:
            hit.append(t["type"])
            del left[k]
    return hit, [p["type"] for p in left], missed


def entity_metrics_greedy(df: DataFrame) -> DataFrame:
    """``(report_id, true, pred)`` arrays of ``(text, type)``: greedy one-to-one in order, joint and by span alone, for each type
    and for ``ALL``. A match counts for the true entity's type."""
    import pandas as pd

    from muster.runtime import arrow_batches

    def match(batches):
        for rows in batches:
            out = []
            for ts, ps in zip(rows["true"], rows["pred"]):
                for grain in ("joint", "span"):
                    found = greedy_pairs([] if ts is None else list(ts), [] if ps is None else list(ps), grain == "joint")
                    out += [(grain, kind, *(int(i == k) for i in range(3))) for k, kinds in enumerate(found) for t in kinds for kind in ("ALL", t)]
            yield pd.DataFrame(out, columns=["grain", "type", "tp", "fp", "fn"])

    arrow_batches(df.sparkSession, 10_000)
    each = df.select("true", "pred").mapInPandas(match, "grain string, type string, tp int, fp int, fn int")
    out = each.groupBy("grain", "type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return out.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 1.0),
    })


def contamination(test: DataFrame, known: DataFrame) -> DataFrame:
    """Test texts that equal a known text after normalisation; joined by hash."""
    key = lambda c: F.sha2(S.norm_span(F.col(c)).cast("binary"), 256)
    return test.withColumn("_k", key("text")).join(known.select(key("text").alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def label_accuracy(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("int")), 4).alias("agreement"), F.count("*").alias("n"))


def integrity(links: DataFrame, incidents: DataFrame, reports: DataFrame) -> DataFrame:
    """Orphans, links across kinds, repeated and missing rows as one metrics table."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    i, r = incidents.select("incident_id", F.col("is_synthetic").alias("si")), reports.select("report_id", F.col("is_synthetic").alias("sr"))
    mixed = links.join(i, "incident_id").join(r, "report_id").where("si <> sr")
    repeated = links.agg((F.count("*") - F.count_distinct("report_id")).alias("n")).select(F.lit("repeated_reports").alias("metric"), "n")
    return (
        count(links.join(i, "incident_id", "left_anti"), "orphan_links").unionByName(count(mixed, "partition_violations"))
        .unionByName(repeated).unionByName(count(reports.join(links, "report_id", "left_anti"), "unlinked_reports"))
    )


def retry_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumnRenamed("n", "n0").join(after.withColumnRenamed("n", "n1"), "table_name", "full").select(
        "table_name", (F.coalesce("n1", F.lit(0)) - F.coalesce("n0", F.lit(0))).alias("delta")
    )
