import pytest
from pyspark.sql import functions as F

from muster.llm import mixing


def shares(sizes):
    """Targets by repeating the rule: share, stop what is above its cap, share the excess anew."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        rest, free = total - sum(fixed.values()), [s for s in names if s not in fixed]
        level = rest / sum(weight[s] for s in free) if free else 0.0
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


CASES = [
    {"a": 10, "b": 1000, "c": 5000, None: 7},
    {"a": 1, "b": 1, "c": 1, "d": 1, "e": 100000},
    {"a": 0, "b": 50},
    {None: 12},
    {f"s{i:02d}": (i * 37) % 101 for i in range(23)},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_are_the_shared_excess(spark, sizes):
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_repeats_rows_as_planned_and_keeps_columns(spark):
    rows = [(i, f"w {i}" if i % 7 else None, f"s{i % 3}" if i % 5 else None, "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __row string")
    docs = docs.withColumnRenamed("__row", "size")
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, v in plan.items() if v} == count
    assert max(plan.values()) <= 3
    assert plan == {r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs.repartition(7)).collect()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.plan_mix(docs).count() == 0


@pytest.mark.parametrize("ids", ["none", "one", "few"])
@pytest.mark.parametrize("texts", ["equal", "apart"])
def test_rows_without_an_id_of_their_own_draw_apart(spark, ids, texts):
    """Each source's taken words come within five deviations of its target, whatever the ids."""
    key = {"none": lambda i: None, "one": lambda i: 7, "few": lambda i: i % 3}[ids]
    rows = [(key(i), "one two three" if texts == "equal" else f"w{i} two three", "a" if i % 2 else "b", i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, turn int")
    plan = mixing.plan_mix(docs)
    assert plan.count() == 2000
    mixed = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    for r in plan.groupBy("source").agg(F.sum("copies").alias("n"), F.first("target").alias("t")).collect():
        assert abs(3 * r["n"] - r["t"]) <= 3 * 5 * (1000 * 0.25) ** 0.5
        assert mixed[r["source"]] == r["n"]
