"""Joins, fusion, ledgers and metrics against small brute-force versions."""

import itertools
import random

from pyspark.sql import functions as F

from muster.graph import connected_components
from muster.operators import candidates as C
from muster.operators import fusion as U
from muster.operators import metrics as M
from muster.operators import review as W
from muster.operators import text as T
from muster.sources import readers as R

REPORT = "report_id string, reported_at timestamp, is_synthetic boolean, latitude double, longitude double, location_text string, text string, caller_id string, embedding array<float>"


def reports(spark, n=160, seed=3, hours=30):
    import datetime as dt

    rnd, out = random.Random(seed), []
    for i in range(n):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(hours * 3600))
        lat, lon = (20 + rnd.random() / 50, 85 + rnd.random() / 50) if rnd.random() < 0.5 else (None, None)
        place = rnd.choice([None, "old town", "old town market", "spring", "ring", "harbour"])
        out.append((f"r{i:04d}", at, rnd.random() < 0.3, lat, lon, place, f"text {rnd.randrange(40)}", rnd.choice([None, "a", "b", "c"]), None))
    return spark.createDataFrame(out, REPORT)


def test_pruned_pairs_lose_no_match(spark):
    r = reports(spark)
    pruned = C.correlate(C.candidate_pairs(r)).where("matched").select("a_report_id", "b_report_id", "score", "relation")
    p = C.prepared(r)
    every = C.correlate(C._tidy(C._meet(p, p, 6.0)).withColumn("kind", C._kind())).where("matched").select("a_report_id", "b_report_id", "score", "relation")
    assert sorted(map(tuple, pruned.collect())) == sorted(map(tuple, every.collect()))
    assert pruned.count() > 20


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, x) for x in range(2001, 2080)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pair_metrics_golden(spark):
    df = spark.createDataFrame([("A", "X"), ("A", "X"), ("B", "X"), ("B", "Y")], "t string, p string")
    got = M.pair_metrics(df, "t", "p").first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["rand"]) == (1, 2, 1, 2, 0.5)


def test_auc_is_the_share_of_ordered_pairs(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(2), rnd.randrange(10) / 10) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    got = M.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auc"]
    assert abs(got - want) < 1e-4


def test_reviews_see_the_state_before(spark):
    state = spark.createDataFrame([("i1", "ACTIVE"), ("i2", "FALSE_REPORT")], "incident_id string, status string")
    acts = spark.createDataFrame(
        [("i1", "a", "RESOLVED", "all clear", 1), ("i1", "b", "VERIFIED", "all clear", 2), ("i1", "c", "ACTIVE", "reopened", 3), ("i2", "d", "ACTIVE", "reopened", 1), ("i1", "e", "VERIFIED", "ok", 4)],
        "incident_id string, action_id string, target string, notes string, at int",
    )
    got = {r["action_id"]: (r["status"], r["rejected"]) for r in W.apply_reviews(state, acts).collect()}
    assert got == {"a": ("RESOLVED", None), "b": ("RESOLVED", "TRANSITION_NOT_ALLOWED"), "c": ("ACTIVE", None), "d": ("FALSE_REPORT", "TRANSITION_NOT_ALLOWED"), "e": ("ACTIVE", "NOTES_TOO_SHORT")}


def test_people_counts():
    assert T.count_people("about twelve people trapped in room 14")[:2] == (12, 0.75)
    assert T.count_people("3 children and 2 adults inside")[0] == 5
    assert T.count_people("5 workers here, 9 workers there")[2] == "MULTIPLE_COUNTS"
    assert T.count_people("4 people, then 7 people, total of 11 people")[0] == 11
    assert T.count_people("call 555-1234, highway 20")[0] is None


def test_enrich_and_clean(spark):
    from muster.plans.q_text import tables

    rows = [("a", "<p>Fire &amp; thick smoke near Old Town , 3 people trapped</p>"), ("b", "  "), ("c", None)]
    df = T.clean_reports(spark.createDataFrame(rows, "report_id string, text string"))
    got = {r["report_id"]: r for r in df.collect()}
    assert got["a"]["clean"] == "Fire & thick smoke near Old Town, 3 people trapped" and got["b"]["clean_error"] == "EMPTY"
    out = {r["report_id"]: r for r in T.enrich(df.select("report_id", F.col("clean").alias("text")), *tables(spark)).collect()}
    assert out["a"]["incident_type"] == "FIRE_WILDFIRE_EXPLOSION" and out["a"]["people_count"] == 3 and out["a"]["place"] == "Old Town"
    assert out["c"]["processing_status"] == "FAILED" and set(out) == {"a", "b", "c"}


def test_full_enrichment_and_its_lightweight_switch(spark):
    from muster.plans.q_text import tables

    raw = [
        ("a", "<p>Fire &amp; thick smoke near Old Town , 3 people trapped</p>", 1), ("b", "  ", 2), ("c", None, 3), ("d", "Fire. " + "x" * 5000, 4),
        ("e", "Fire. Old Town Bridge and NH-44", 5), ("f", "Fire. Old Town Bridge and NH-44", 5),
    ]
    df = spark.createDataFrame(raw, "report_id string, text string, place int")
    gaz = spark.createDataFrame([("old town", "AREA")], "term string, entity_type string")
    protos = T.prototype_vectors(spark.createDataFrame([("FIRE_WILDFIRE_EXPLOSION", "fire smoke"), ("FLOOD_FLASH_FLOOD", "water flood")], "class string, text string"))

    def broken(texts):
        raise ValueError("no model")

    run = lambda **how: {r["report_id"]: r for r in T.enrich_full(df, *tables(spark), gaz, protos, **how).collect()}
    light, full, lost = run(lightweight=True), run(), run(model=broken)
    assert set(light) == set(full) == set(lost) == set("abcdef")
    plain = {r["report_id"]: r for r in T.enrich(T.clean_reports(df).select("report_id", F.col("clean").alias("text")), *tables(spark)).collect()}
    for k, r in light.items():
        assert r["embedding"] is None and (r["incident_type"], r["confidence"], r["urgency"]) == (plain[k]["incident_type"], plain[k]["confidence"], plain[k]["urgency"])
        assert (lost[k]["incident_type"], lost[k]["confidence"]) == (r["incident_type"], r["confidence"]) and lost[k]["embedding"] is None
        assert ("EMBEDDING_UNAVAILABLE" in lost[k]["warnings"]) == (r["text"] is not None) and "EMBEDDING_UNAVAILABLE" not in r["warnings"]
    assert full["a"]["confidence"] != light["a"]["confidence"] and full["b"]["confidence"] == light["b"]["confidence"]
    assert full["a"]["text"] == "Fire & thick smoke near Old Town, 3 people trapped" and len(full["a"]["embedding"]) == 64
    assert [(e["text"], e["type"]) for e in full["a"]["entities"]] == [("Old Town", "AREA")] and full["a"]["place"] == "Old Town"
    assert full["b"]["warnings"] == full["c"]["warnings"] == ["EMPTY"] and full["c"]["processing_status"] == "FAILED"
    assert full["d"]["truncated"] and "TRUNCATED" in full["d"]["warnings"]
    assert {e["type"] for e in full["e"]["entities"]} == {"LANDMARK", "ROAD"} and full["e"][1:] == full["f"][1:]
    assert all(r["processing_status"] not in ("SUCCESS",) for r in lost.values())
    assert T.enrich_full(df.limit(0), *tables(spark), gaz, protos).count() == 0


def test_feed_and_metadata(spark):
    df = spark.createDataFrame([("i", True, "ACTIVE", None), ("j", False, "VERIFIED", "ACTIVE")], "incident_id string, is_new boolean, status string, previous_status string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r["event"] for r in R.to_feed(df).collect()) == ["INCIDENT_CREATED", "INCIDENT_UPDATED", "STATUS_CHANGED"]
