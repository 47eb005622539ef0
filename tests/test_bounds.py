"""Bounds of vector pairs lose no match and spare most products; sums along ranges need no single task; overrides."""

import random

from pyspark.sql import functions as F

from muster.operators import candidates as C
from muster.operators import metrics as M
from muster.operators import review as W
from muster.plans.views import view
from muster.runtime import ranked, running_sums

SF = "/root/testdata/sf0.001"


def test_bounds_lose_no_match_and_spare_most_products(spark):
    r = view(spark, SF, "report")
    r = r.withColumn("embedding", F.when(F.col("event_id") % 13 != 0, F.col("embedding")))
    every = C.correlate(C.candidate_pairs(r, True), True)
    some = C.correlate(C.candidate_pairs(r, True, matching=True), True)
    key = ["a_report_id", "b_report_id", "semantic", "score", "relation"]
    assert sorted(map(tuple, some.where("matched").select(key).collect()), key=str) == sorted(map(tuple, every.where("matched").select(key).collect()), key=str)
    whole = some.where("semantic is not null").count()
    assert 0 < whole < 0.3 * every.where("semantic is not null").count()


def test_sums_along_ranges(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.random(), rnd.randrange(9)) for _ in range(500)] + [("a", None, 2), (None, 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    key = lambda x: (x is None, x or 0)
    out = running_sums(df, [F.col("x").asc_nulls_last()], ["n"])
    for r in out.collect():
        if r["x"] is not None and r["x"] != 0.5:
            assert r["upto_n"] == sum(n for _, x, n in rows if key(x) <= key(r["x"]))
    by = running_sums(df, [F.col("x").asc_nulls_last()], ["n"], ("g",))
    assert by.count() == len(rows)
    for r in by.collect():
        assert r["upto_n"] == sum(n for g, x, n in rows if g == r["g"] and key(x) <= key(r["x"]))
    plan = out._jdf.queryExecution().executedPlan().toString() + by._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert running_sums(df.limit(0), [F.col("x").asc()], ["n"]).count() == 0


def test_places_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert all(r["x"] == r["at"] for r in ranked(df, [F.col("x")], "at").collect())
    assert ranked(df.limit(0), [F.col("x")], "at").count() == 0


def test_roc_over_distinct_doubles_has_no_single_task(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(int(rnd.random() < 0.4), rnd.random()) for _ in range(400)], "y int, s double")
    curve = M.roc_curve(df, "y", "s")
    assert curve.count() == 400 and "SinglePartition" not in M.score_steps(df, "y", "s")._jdf.queryExecution().executedPlan().toString()


def test_an_override_sees_what_the_one_before_left(spark):
    state = spark.createDataFrame([("i1", "LOW", None, 3, 1.0, 2.0, "here", "EXACT", "ACTIVE", 1, None)], "incident_id string, urgency string, incident_type string, people_at_risk_count int, latitude double, longitude double, location_text string, location_precision string, status string, independent_source_count int, confidence double")
    acts = [("1", "urgency", "high"), ("2", "urgency", "none"), ("3", "urgency", "CRITICAL "), ("4", "people_at_risk_count", None), ("5", "location", '{"text": "mill", "latitude": 5}'), ("6", "location", "mill"), ("7", "color", "x"), ("8", "location", '{"precision": "best"}')]
    actions = spark.createDataFrame([("i1", i, f, v, "seen on site", "2024-01-01") for i, f, v in acts] + [("i2", "9", "urgency", "LOW", "seen on site", "2024-01-01")], "incident_id string, override_id string, field string, new_value string, reason string, at string")
    got = {r["override_id"]: (r["previous_value"], r["applied_value"], r["rejected"]) for r in W.override_ledger(state, actions).collect()}
    before = '{"text":"here","latitude":1.0,"longitude":2.0,"precision":"EXACT"}'
    after = '{"text":"mill","latitude":5.0,"precision":"UNKNOWN"}'
    assert got == {
        "1": ("LOW", "HIGH", None), "2": ("HIGH", None, "VALUE_NOT_VALID"), "3": ("HIGH", "CRITICAL", None), "4": ("3", None, None), "5": (before, after, None),
        "6": (after, None, "VALUE_NOT_VALID"), "7": (None, None, "FIELD_NOT_ALLOWED"), "8": (after, None, "VALUE_NOT_VALID"), "9": (None, None, "UNKNOWN_INCIDENT"),
    }
    row = W.apply_overrides(state, actions).first()
    assert (row["urgency"], row["people_at_risk_count"], row["location_text"], row["latitude"], row["longitude"], row["overridden"]) == ("CRITICAL", None, "mill", 5.0, None, True)


def test_the_ledger_sorts_narrow_rows_in_tasks_of_bounded_size(spark, monkeypatch):
    state = spark.range(40).select(F.concat(F.lit("i"), "id").alias("incident_id"), F.lit("LOW").alias("urgency"), F.lit(1.0).alias("latitude"))
    actions = state.select("incident_id", F.lit("urgency").alias("field"), F.lit("high").alias("new_value"), F.lit("seen on site").alias("reason"), F.lit(1).alias("at"), F.lit("o").alias("override_id"))
    monkeypatch.setattr(W, "LEDGER_ROWS", 4, raising=False)
    out = W.override_ledger(state, actions)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(incident_id" in plan and ", 10)" in plan and "map(" not in plan
    assert {tuple(r) for r in out.select("previous_value", "applied_value").collect()} == {("LOW", "HIGH")} and out.count() == 40


def test_greedy_entities():
    e = lambda *x: [dict(zip(("text", "type"), t)) for t in x]
    assert M.greedy_pairs(e(("mill road", "ROAD"), ("bank", "PLACE")), e(("Mill  Road", "PLACE"), ("the bank", "PLACE")), True) == (["PLACE"], ["PLACE"], ["ROAD"])
    assert M.greedy_pairs(e(("mill road", "ROAD")), e(("Mill", "PLACE")), False) == (["ROAD"], [], [])
    assert M.greedy_pairs(e(("", "ROAD"), ("x", "ROAD")), e(("mill", "ROAD"), (None, "ROAD")), True) == (["ROAD"], ["ROAD"], ["ROAD"])
