"""The positional automaton, scope of negation and doubt, spans of large gazetteers, and hooks that fail."""

import random
import re

import pytest
from pyspark.sql import functions as F

from muster.operators import hooks, lexscan
from muster.operators import text as T
from muster.operators.terms import response_rows
from muster.plans import registry

SF = "/root/testdata/sf0.001"


def entries():
    return [("response", c, t, 0.0, x) for c, t, x in response_rows()]


def test_terms_are_found_wherever_they_stand():
    rnd = random.Random(2)
    words = ["a", "b", "c'd", "é", "12"]
    terms = [(" ".join(rnd.choices(words, k=rnd.randrange(1, 7)))) for _ in range(40)]
    automaton = lexscan.Automaton([("keyword", "x", "phrase", 0.0, t) for t in sorted(set(terms))])
    for _ in range(100):
        text = rnd.choices(words, k=rnd.randrange(0, 25))
        want = {(i, j, " ".join(text[i:j])) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if " ".join(text[i:j]) in terms}
        assert {(i, j, e[4]) for i, j, e in automaton.find(text)} == want


def said(text):
    return {(h["label"], h["term"], h["negated"], h["doubtful"]) for h in lexscan.hits_of(text, lexscan.Automaton(entries())) if h["tier"] in ("strong", "supporting")}


@pytest.mark.parametrize("text,want", [
    ("No injuries reported downtown. Two people injured at the mill", {("MEDICAL_EMS", "injured", False, False)}),
    ("no fire and no injuries", {("FIRE_HAZMAT", "fire", True, False)}),
    ("no fire here but smoke there", {("FIRE_HAZMAT", "fire", True, False), ("FIRE_HAZMAT", "smoke", False, False)}),
    ("maybe a fire", {("FIRE_HAZMAT", "fire", False, True)}),
    ("maybe. A fire", {("FIRE_HAZMAT", "fire", False, False)}),
    ("maybe " + "very " * 9 + "big fire", {("FIRE_HAZMAT", "fire", False, False)}),
    ("the fire drill", set()), ("İ fire", {("FIRE_HAZMAT", "fire", False, False)}), ("", set()),
])
def test_scope(text, want):
    assert said(text) == want


def test_places_are_those_of_the_text():
    text = "İİ Gas Leak at NH-44!\nfire"
    for h in lexscan.hits_of(text, lexscan.Automaton(entries())):
        assert re.sub(r"\W+", " ", text[h["start"] : h["end"]]).lower() == h["term"]


def test_a_stream_gives_the_rows_of_the_batch(spark):
    want = {(r["doc_id"], r["responses"]) for r in registry.QUERIES["scoped_responses"](spark, SF).collect()}
    assert {(r["doc_id"], r["responses"]) for r in registry.QUERIES["enrich_stream"](spark, SF).collect()} == want
    plan = registry.QUERIES["enrich_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_keyword_scores_of_an_array_are_those_of_the_join(spark):
    from muster.sources.readers import load_lexicon

    words = load_lexicon(spark)
    some = [r["term"] for r in words.collect()]
    rnd = random.Random(1)
    df = spark.createDataFrame([(k, " and ".join(rnd.choices(some, k=4)) + rnd.choice(["", "!", " zz"])) for k in range(60)], "report_id long, text string")
    want = {(r["report_id"], r["class"], r["score"]) for r in T.keyword_scores(df, words).collect()}
    got = lexscan.with_hits(df, lexscan.entries(words)).select("report_id", F.explode(lexscan.keyword_map(F.col("__h"))).alias("class", "score"))
    assert {tuple(r) for r in got.collect()} == want
    one = {tuple(r) for r in T.classify(df, T.keyword_scores(df, words)).collect()}
    rows = lexscan.enrich_rows(df, lexscan.entries(words)).select("report_id", "incident_type", "confidence", "type_status", "secondary_hazard")
    assert {tuple(r) for r in rows.collect()} == one


def test_half_a_million_terms_of_up_to_six_words(spark):
    gazetteer = spark.range(500_000).select(F.concat(F.lit("place "), F.col("id").cast("string")).alias("term"), F.lit("PLACE").alias("entity_type"))
    gazetteer = gazetteer.union(spark.createDataFrame([("the old mill by the river", "LANDMARK"), ("old mill", "LANDMARK")], "term string, entity_type string"))
    df = spark.createDataFrame([(1, "Fire: The old mill by the river, near Place 499999"), (2, "Old mill and place 7 place 8"), (3, None), (4, "")], "report_id long, text string")
    got = {r["report_id"]: [e["text"] for e in r["entities"]] for r in T.extract_entities(df, gazetteer).collect()}
    assert got == {1: ["The old mill by the river", "Place 499999"], 2: ["Old mill", "place 7", "place 8"], 3: [], 4: []}


def test_a_span_model_may_fail(spark):
    def ner(batch):
        if any("bad" in t for t in batch):
            raise OSError("no")
        return [[(0, 4, "NAME"), (2, 999, "OUT")] for _ in batch]

    gazetteer = spark.createDataFrame([("mill", "PLACE")], "term string, entity_type string")
    df = spark.createDataFrame([(k, "bad mill" if k == 3 else f"Mira sees mill {k}") for k in range(20)], "report_id long, text string").coalesce(1)
    rows = {r["report_id"]: r for r in lexscan.entity_spans(df, gazetteer, T.rule_spans, ner).collect()}
    assert [e["text"] for e in rows[3]["entities"]] == ["mill"] and rows[3]["entity_error"] == "OSError"
    assert all([e["text"] for e in r["entities"]] == ["Mira", "mill"] and r["entity_error"] is None for k, r in rows.items() if k != 3)


def test_spans_are_those_of_a_scan_of_all():
    rnd = random.Random(5)
    for _ in range(300):
        spans = [(a := rnd.randrange(30), a + rnd.randrange(1, 8), rnd.choice("xy")) for _ in range(rnd.randrange(12))]
        kept = []
        for s in sorted(spans, key=lambda x: (x[0] - x[1], x[0], x[2])):
            if all(s[1] <= a or s[0] >= b for a, b, _ in kept):
                kept.append(s)
        assert lexscan.apart(spans) == sorted(kept)


def test_one_bad_text_in_a_thousand_costs_one_row(spark):
    calls = []

    def model(batch):
        calls.append(len(batch))
        if "bad" in batch:
            raise RuntimeError("no")
        return [{"size": len(t)} for t in batch]

    batch = ["ok"] * 1000
    batch[617] = "bad"
    out = hooks.isolated(model, batch)
    assert [k for k, (r, e) in enumerate(out) if e] == [617] and out[617] == (None, "RuntimeError") and len(calls) < 25
    df = spark.createDataFrame([(k, t) for k, t in enumerate(batch)], "report_id long, text string")
    rows = hooks.analyze(df, lambda b: [{"size": len(t), "odd": 1} if t == "bad" else {"size": len(t)} for t in b], "size int").collect()
    assert {r["report_id"] for r in rows if r["analysis"] is None} == {617} and {r["analysis_error"] for r in rows} == {None, "KeyError"}
    vectors = T.embed(df, lambda b: model(b) and [[1.0, 2.0] for _ in b])
    assert vectors.where("embedding is null").count() == 1


def test_small_gazetteers_need_no_runs_in_a_join_and_give_the_same(spark, monkeypatch):
    gazetteer = spark.createDataFrame([("mill", "PLACE"), ("mill", "HOUSE"), ("old mill", "PLACE"), ("mill road", "ROAD"), ("a_b", "ODD"), ("road  x", "ODD")], "term string, entity_type string")
    df = spark.createDataFrame([(1, "Old Mill Road, old mill; MILL"), (2, None), (3, "a_b road x a b"), (4, "mill mill road Old Town Hospital NH-5")], "report_id long, text string")
    small = T.extract_entities(df, gazetteer)
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(str, small.collect()))
    monkeypatch.setattr(lexscan, "MOST_TERMS", 2)
    joined = T.extract_entities(df, gazetteer)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, joined.collect())) == got


def test_a_trigger_reads_as_many_files_as_tasks_can_work_on(spark, tmp_path):
    from pathlib import Path

    from muster.plans.q_stream import TRIGGER_FILES, stream_of
    from muster.streaming.stream import drain

    stream = stream_of(spark, spark.range(100).repartition(2 * TRIGGER_FILES))
    drain(stream, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    assert len([p for p in Path(tmp_path / "out-state" / "commits").iterdir() if p.name.isdigit()]) == 2
