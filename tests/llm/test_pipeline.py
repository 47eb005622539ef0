"""The pipeline's stages: columns, decisions that take effect, and each stage against what it must keep."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from muster.llm import decontam, mixing
from muster.runtime import materialize

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").select((F.col("item_id") + 900_000).alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(1).cast("long").alias("n_chars")).limit(1)
    copy = docs.where("doc_id = 3").withColumn("doc_id", F.lit(900_500).cast("long"))
    odd = spark.createDataFrame([(900_600, None, None, None, None), (900_601, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(leak).unionByName(copy).unionByName(odd).withColumn("__row", F.lit(1))
    leaked, kept = leak.first()["doc_id"], {}
    for name, stage in corpus_pipeline.STAGES:
        columns, before = docs.columns, Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns, name
        kept[name] = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert set(kept[name]) <= set(before), name
        if name != "mixing":
            assert max(kept[name].values()) == 1, name
        if name == "simhash":
            prior = docs
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic & set(kept["toxicity"])) <= 0.5 * len(toxic) and len(clean & set(kept["toxicity"])) >= 0.97 * len(clean)
    assert 900_500 not in kept["line_dedup"] and 3 in kept["toxicity"]
    assert leaked in kept["simhash"] or leaked not in kept["line_dedup"]
    assert leaked not in kept["decontamination"]
    items = decontam.benchmark_items(spark.read.parquet(f"{SF}/benchmark.parquet"))
    index, lexer = decontam.Index(items), decontam.Lexer()
    want = {r["doc_id"] for r in prior.collect() if not decontam.leaks(r["text"] or "", index, lexer)}
    assert set(kept["decontamination"]) == want


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0
    sizes = out.agg(F.sum(mixing.text_size(F.col("text")))).first()[0]
    assert sizes > 0
