"""Queries that run over every row of their tables."""

import hashlib
import re

from pyspark.sql import functions as F

from muster.operators import fusion as U
from muster.plans import registry
from muster.plans.views import short_view, table, view
from tests.test_jobs import reports

SF = "/root/testdata/sf0.001"


def blocks(rows, hours):
    out, last, start = [], {}, {}
    for r in sorted(rows, key=lambda r: (r["reported_at"], r["report_id"])):
        k, at = r["is_synthetic"], r["reported_at"]
        if k not in last or (at - last[k]).total_seconds() > hours * 3600:
            start[k] = at
        last[k] = at
        out.append((r["report_id"], start[k]))
    return sorted(out)


def test_session_blocks_of_every_report(spark):
    rows = view(spark, SF, "report").select("report_id", "is_synthetic", "reported_at").collect()
    got = registry.QUERIES["session_blocks_all"](spark, SF).collect()
    assert sorted(map(tuple, got)) == blocks(rows, 6)
    sparse = reports(spark, n=60, hours=300)
    want = blocks(sparse.collect(), 6)
    assert sorted(map(tuple, U.session_blocks(sparse).select("report_id", "block").collect())) == want
    assert 4 < len({b for _, b in want}) < 60


def tidy(text):
    text = re.sub("[\\x00-\\x1f\\x7f-\\x9f\u200b-\u200f\u2028-\u202e\u2060\ufeff]", " ", text)
    return re.sub(" +([!?,.:;])", r"\1", re.sub("[ \u00a0]+", " ", text)).strip(" ")


def test_clean_text_of_every_language(spark, tmp_path):
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in table(spark, SF, "documents").collect()]
    odd = [(-1, None, "caf\u00e9 \u00a0 ol\u00e9 !\x85\u200b\ufb01n"), (-2, "fr", "\t\u00c7a  va ?\n"), (-3, "de", None), (-4, "es", "")]
    spark.createDataFrame(rows + odd, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, registry.QUERIES["clean_text_all"](spark, str(tmp_path)).collect()))
    assert got == {i: None if t is None else hashlib.md5(tidy(t).encode()).hexdigest() for i, _, t in rows + odd}


def test_fusion_outputs_links_reports_of_all_regions(spark):
    from collections import Counter

    from tests.test_replay import brute

    r = view(spark, SF, "report").withColumn("hours", F.unix_micros("reported_at") / F.lit(3_600_000_000.0)).drop("embedding")
    rows = [x.asDict() | {"location_precision": None, "vector": None} for x in r.collect()]
    want = Counter(incident for _, incident, _, _ in brute(rows, "exact", False))
    got = {x["incident_id"]: x["report_count"] for x in registry.QUERIES["fusion_outputs"](spark, SF).collect()}
    assert got == dict(want) and len(got) < len({incident for _, incident, _, _ in brute(rows, "region", False)})


def test_short_texts_are_equal_where_normal_forms_are(spark, tmp_path):
    import os

    texts = ["Fire", " fire ", "fire.", "", "Unknown", None, "FIRE", "smoke"]
    for t in os.listdir(SF):
        if t != "documents.parquet":
            os.symlink(f"{SF}/{t}", tmp_path / t)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    short = {x["doc_id"]: x["text"] for x in short_view(spark, str(tmp_path)).select("doc_id", "text").distinct().collect()}
    norm = lambda t: None if t is None or t.strip().lower() in ("", "unknown") else t.strip().lower()
    assert len(short) == len(texts) and all((short[i] == short[j]) == (norm(a) == norm(b)) for i, a in enumerate(texts) for j, b in enumerate(texts))
    assert {i for i, t in short.items() if t is None} == {3, 4, 5}
    assert short_view(spark, str(tmp_path)).count() == view(spark, str(tmp_path), "report").count()
