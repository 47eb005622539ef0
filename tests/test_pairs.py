"""Pairs by their distinct vectors and by classes of rows are the pairs of a plain join."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from muster.graph import connected_components
from muster.operators import candidates as C
from muster.operators import fusion as U
from muster.plans.views import view
from tests import test_replay

SF = "/root/testdata/sf0.001"
KEY = ["a_report_id", "b_report_id", "semantic", "score", "relation"]


def some_blind(spark):
    r = view(spark, SF, "report").where("event_id % 2 = 0")
    odd = F.when(F.col("event_id") % 26 == 0, F.array(F.lit(1.0).cast("float"))).when(F.col("event_id") % 34 == 0, F.transform("embedding", lambda x: x * F.lit(0).cast("float")))
    return r.withColumn("embedding", F.when(F.col("event_id") % 22 != 0, F.coalesce(odd, "embedding")))


def test_reports_of_similar_vectors_alone_meet(spark, monkeypatch):
    r = some_blind(spark)
    fast = C.candidate_pairs(r, True, matching=True)
    assert "a_embedding" not in fast.columns  # distinct vectors were compared, not those of pairs of reports
    assert fast.where("semantic is not null").agg(F.min("semantic")).first()[0] >= C.least_cosine()
    got = sorted(map(tuple, C.correlate(fast, True).where("matched").select(KEY).collect()), key=str)
    monkeypatch.setattr(C, "VECTORS", 3)
    plain = C.candidate_pairs(r, True, matching=True)
    assert "a_embedding" in plain.columns
    assert got == sorted(map(tuple, C.correlate(plain, True).where("matched").select(KEY).collect()), key=str) and got


def test_counts_by_classes_are_the_counts_of_pairs(spark):
    r = view(spark, SF, "report").where("event_id % 2 = 0")
    r = r.withColumn("reported_at", F.when(F.col("event_id") % 14 != 0, F.timestamp_micros(F.unix_micros("reported_at") % F.lit(40_000_000_000))))  # ties, nulls and full slots
    p = C.prepared(r, vectors=False)
    every = C.correlate(C._tidy(C._meet(p, p, 6.0)).withColumn("kind", C._kind()))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(C.place_counts(r, by_points=True)) == rows(every.groupBy("kind", "spatial").agg(F.count("*").alias("n")))
    plan = C.place_counts(r)._jdf.queryExecution().executedPlan().toString()
    assert "a_report_id" not in plan  # reports aren't paired


def test_relations_and_highest_scores_of_all_pairs(spark):
    r = some_blind(spark)
    every = C.correlate(C.candidate_pairs(r, True), True).persist()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(C.relation_counts(r)) == rows(every.groupBy("relation", "kind").agg(F.count("*").alias("n")))
    assert rows(C.highest_scores(r)) == rows(every.groupBy("kind").agg(F.count("*").alias("n"), F.max("score").alias("high")))
    every.unpersist()


def test_best_candidates_hold_the_best_of_all_and_few_more(spark):
    from muster.plans import registry  # noqa: F401  loads all queries in their order
    from muster.plans.q_scores import open_incidents

    r, i = view(spark, SF, "report"), open_incidents(spark, SF)
    squeeze = lambda df, ts: df.withColumn(ts, F.timestamp_micros(F.unix_micros(ts) % F.lit(9_000_000_000)))
    r, i = squeeze(r, "reported_at"), squeeze(i, "last_active")  # ties of time are rare, so half of the incidents share theirs
    i = i.withColumn("last_active", F.when(F.crc32("incident_id") % 2 == 0, F.date_trunc("minute", "last_active")).otherwise(F.col("last_active")))
    every, few = C.score_candidates(r, i).persist(), C.best_candidates(r, i).persist()
    best = lambda df: sorted(map(tuple, C.best_match(df).select("report_id", "incident_id", "last_active", "score").collect()))
    assert best(few) == best(every) and len(best(few)) > 500
    assert few.count() < 5 * r.count() < every.count() / 2


def test_pairs_that_match_without_vectors_are_those_of_a_plain_join(spark):
    r = view(spark, SF, "report").where("event_id % 2 = 0")
    r = r.withColumn("reported_at", F.when(F.col("event_id") % 14 != 0, F.timestamp_micros(F.unix_micros("reported_at") % F.lit(40_000_000_000))))  # ties and nulls
    p = C.prepared(r, vectors=False)
    keys = ["a_report_id", "b_report_id", "kind"]
    rule = "a_is_synthetic = b_is_synthetic and (b_reported_at > a_reported_at or (b_reported_at = a_reported_at and a_report_id < b_report_id)) and unix_micros(b_reported_at) - unix_micros(a_reported_at) <= 21600000000"
    both = p.select(*[F.col(x).alias(f"a_{x}") for x in p.columns]).join(p.select(*[F.col(x).alias(f"b_{x}") for x in p.columns]), F.expr(rule))
    want = sorted(map(tuple, C.correlate(C._tidy(both).withColumn("kind", C._kind())).where("matched").select(keys).collect()))
    found = C.matched_pairs(r)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500
    likely = C.likely_pairs(p, p)
    assert {x["sure"] for x in likely.select("sure").distinct().collect()} == {True, False}


def test_pair_join_keeps_exact_scores_out_of_the_generated_join(spark):
    from muster.plans import registry

    plan = registry.QUERIES["pair_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "SortMergeJoin" in x and "a_is_synthetic" in x]
    exact = [x for x in joins if "ATAN2" in x]
    assert len(joins) >= 5 and exact and all("exists(" in x[: x.index("ATAN2")] for x in exact)
    assert "REPARTITION_BY_NUM" in plan  # few bytes give many pairs, so partitions aren't merged by bytes


def test_candidates_meet_in_a_given_number_of_tasks_and_are_those_of_a_plain_join(spark):
    from muster.plans import registry  # noqa: F401  loads all queries in their order
    from muster.plans.q_scores import open_incidents

    r, i = view(spark, SF, "report"), open_incidents(spark, SF)
    names = i.select(*[F.col(x).alias(f"i_{x}") for x in i.columns])
    rule = "is_synthetic = i_is_synthetic and i_status in ('ACTIVE', 'NEEDS_REVIEW') and unix_micros(reported_at) - unix_micros(i_last_active) between 0 and 21600000000"
    pairs = lambda df: sorted(map(tuple, df.select("report_id", "i_incident_id").collect()))
    found = C.candidates(r, i)
    assert pairs(found) == pairs(r.join(names, F.expr(rule))) and found.columns == [*r.columns, *[f"i_{x}" for x in i.columns if x != "is_synthetic"]]
    plan = found.select("report_id", "i_incident_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2


def seen(spark, n=400, hours=30, seed=3):
    """Reports whose vectors can all be used; few of them, so that reports share them."""
    rows = [r for r in test_replay.made(n, hours, seed) if r["hours"] is not None]
    vectors = [r["vector"] for r in rows if r["vector"]][:12]
    return test_replay.frame(spark, [r | {"vector": vectors[k % 12]} for k, r in enumerate(rows)])


def test_pairs_scored_in_arrays_are_those_of_columns(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIR_STEP", 700)
    reports = seen(spark)
    names = [x.split()[0] for x in C.GIVEN["pairs"].split(", ")]
    want = C.correlate(C.candidate_pairs(reports, True, dim=8), True).select(*names).collect()
    matched = {tuple(x) for x in want if x["relation"] != "INITIAL"}
    assert {x[7] for x in matched} == {"UNCERTAIN", "DUPLICATE", "CORROBORATING"}
    got = C.alike_scores(reports, C.least_cosine(), "pairs", dim=8).collect()
    assert len(got) == len(matched) and {tuple(x) for x in got} == matched
    every = Counter((x["relation"], x["kind"]) for x in want)
    counts = C.alike_scores(reports, -1.0, "relations", dim=8).groupBy("relation", "kind").agg(F.sum("n").alias("n")).collect()
    assert {(x["relation"], x["kind"]): x["n"] for x in counts} == every and len({k for _, k in every}) == 6
    high = C.alike_scores(reports, -1.0, "highest", dim=8).groupBy("kind").agg(F.max("high").alias("high")).collect()
    assert dict(map(tuple, high)) == {k: max(x["score"] for x in want if x["kind"] == k) for k in {x["kind"] for x in want}}
    edges = C.alike_scores(reports, C.least_cosine(), "edges", dim=8)
    a, b = (connected_components(e).collect() for e in (edges, spark.createDataFrame([x[:2] for x in matched], "a string, b string")))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and edges.count() < len(matched)


def test_rounding_is_that_of_columns(spark):
    values = [0.70004999999999995, 0.70005, 0.123450000001, 0.5, 0.55 * 0.8181 + 0.2 * 0.5 + 0.25 * 0.6] + [k * 0.000005 for k in range(4000)]
    want = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 4)).collect()]
    assert C.rounded(np.array(values)).tolist() == want


def test_components_of_linked_vectors_at_once(spark, monkeypatch):
    reports = seen(spark, n=150, hours=60)
    pairs = C.correlate(C.candidate_pairs(reports, True, dim=8), True)
    want = {tuple(x) for x in U.fuse_components(pairs, reports).collect()}
    assert len({c for _, c in want}) not in (1, len(want))
    once = C.matched_components(reports, dim=8)
    assert {tuple(x) for x in U.with_components(reports, once).collect()} == want
    monkeypatch.setattr(C, "CLOSED_ROWS", 5)
    assert C.alike_scores(reports, C.least_cosine(), "components", dim=8) is None
    assert {tuple(x) for x in U.with_components(reports, C.matched_components(reports, dim=8)).collect()} == want
