"""Small lexicons are looked for while words are read; the hits are those of all word runs."""

from pyspark.sql import functions as F

from muster.operators import text as T


def test_terms_are_found_without_making_every_run(spark, monkeypatch):
    texts = ["No one trapped, no one!", "trapped trapped by the fire", "", None, "one", "the power line is down; the power", "NO ONE TRAPPED"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    terms = ["trapped", "no one trapped", "one", "power line", "the power line is down", "the power", "absent word", ""]
    lexicon = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    rows = lambda: sorted(map(tuple, T.lexicon_hits(df, lexicon, "id").select("id", "term").collect()))
    got = rows()
    assert (0, "no one trapped") in got and (5, "power line") in got and (5, "the power line is down") not in got
    made = df.select(F.size(T.term_runs(F.col("text"), terms)).alias("n")).where("id = 5").first()["n"]
    assert made == 2  # all word runs would be some twenty
    monkeypatch.setattr(T, "PLAN_TERMS", 0)
    assert rows() == got
