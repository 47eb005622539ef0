"""Streams over the whole report view lose no row and agree with the batch forms."""

import glob
import os
import time

import pytest
import test_replay
from pyspark.sql import Window
from pyspark.sql import functions as F

from muster.operators import fusion as U
from muster.plans import registry
from muster.plans.views import view
from muster.runtime import shared_dir
from muster.streaming import stream as S

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_files_are_read_in_event_time(spark):
    from muster.plans import q_stream  # after the registry, which loads it

    path = f"{shared_dir(spark)}/order-test"
    view(spark, SF, "report").select(*q_stream.COLS).repartitionByRange(3, "reported_at").write.parquet(path)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    for k, f in enumerate(files):
        os.utime(f"{path}/{f}", (2_000_000_000 - k, 2_000_000_000 - k))  # the tasks end in the opposite order
    q_stream.order_files(spark, path)
    by_time = sorted(files, key=lambda f: os.path.getmtime(f"{path}/{f}"))
    spans = [spark.read.parquet(f"{path}/{f}").agg(F.min("reported_at"), F.max("reported_at")).first() for f in by_time]
    assert len(spans) == 3 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_dedup_has_every_report_once(spark):
    want = rows(view(spark, SF, "report").select("report_id", "reported_at"))
    assert rows(registry.QUERIES["stream_dedup"](spark, SF)) == want


def test_pulses_sum_to_all_reports(spark):
    want = view(spark, SF, "report").groupBy(F.date_trunc("hour", "reported_at").alias("pulse")).agg(F.count("*").alias("injected"))
    assert rows(registry.QUERIES["stream_pulse"](spark, SF).select("pulse", "injected")) == rows(want)


def test_fuse_stream_is_the_replay(spark):
    want = rows(U.fuse_replay(view(spark, SF, "report"), "region"))
    assert rows(registry.QUERIES["fuse_stream"](spark, SF)) == want


def files(spark, df, path, column="batch"):
    """A stream that reads one file of ``df`` a trigger, in the order of ``column``."""
    schema = df.drop(column).schema
    for k in sorted(r[0] for r in df.select(column).distinct().collect()):
        df.where(F.col(column) == k).drop(column).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # a stream reads files by the second they were written in
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_with_vectors_is_the_replay(spark, tmp_path):
    made = [r for r in test_replay.made(120, 10, 4) if r["hours"] is not None]
    df = test_replay.frame(spark, made)
    cut = F.ntile(3).over(Window.orderBy("reported_at", "report_id"))
    stream = files(spark, df.withColumn("batch", cut), str(tmp_path / "in"))
    S.drain(S.fuse_stream(stream, semantic=True, dim=8), str(tmp_path / "out"))
    got = test_replay.links(spark.read.parquet(str(tmp_path / "out")))
    assert got == test_replay.brute(made, "region", True)


def test_a_late_file_goes_aside_and_is_fused_after_all(spark, tmp_path):
    made = [r for r in test_replay.made(90, 30, 8) if r["hours"] is not None]
    df = test_replay.frame(spark, made)
    late = F.crc32(F.col("report_id").cast("binary")) % 5 == 0
    df = df.withColumn("batch", F.when(late, 3).when(F.unix_micros("reported_at") < 15 * 3_600_000_000, 1).otherwise(2))
    path = str(tmp_path / "out")
    stream = files(spark, df, str(tmp_path / "in"))
    S.route_late(stream, path)
    S.route_late(stream, path)  # a second run finds nothing new
    schema = df.drop("batch").schema
    on_time, aside = (S.routed(spark, path, p, schema) for p in ("in_time", "late"))
    assert rows(on_time.unionByName(aside).select("report_id")) == rows(df.select("report_id"))
    latest = df.where("batch < 3").agg(F.max(F.unix_micros("reported_at"))).first()[0]
    want = df.where((F.col("batch") == 3) & (F.unix_micros("reported_at") < latest - 6 * 3_600_000_000))
    assert rows(aside.select("report_id")) == rows(want.select("report_id")) and want.count() > 3
    again = test_replay.links(S.refuse_late(spark, path, schema))
    assert again <= test_replay.brute(made, "region", False) and {x[0] for x in again} >= {r["report_id"] for r in aside.collect()}


def test_a_broken_feed_gives_each_envelope_once(spark, tmp_path):
    links = spark.createDataFrame(
        [(1, "i1", "r1", "INITIAL", None), (2, "i1", "r2", "DUPLICATE", 0.9), (2, "i2", "r3", "INITIAL", None), (3, "i2", "r4", "UNCERTAIN", 0.5)],
        "batch int, incident_id string, report_id string, relationship_type string, similarity_score double",
    )
    stream, path = files(spark, links, str(tmp_path / "in")), str(tmp_path / "out")
    with pytest.raises(Exception):  # the batch was written, but not committed
        S.feed_sink(stream, path, fail_after=1)
    S.feed_sink(stream, path)
    got = S.read_feed(spark, path).select("event", F.get_json_object("payload", "$.report_id"), F.get_json_object("payload", "$.status"))
    assert rows(got) == sorted([
        ("INCIDENT_CREATED", "r1", None), ("INCIDENT_UPDATED", "r2", None), ("INCIDENT_CREATED", "r3", None), ("INCIDENT_UPDATED", "r4", None), ("STATUS_CHANGED", "r4", "NEEDS_REVIEW"),
    ], key=str)


def test_feed_of_the_reports_names_every_link(spark):
    links = {(x["incident_id"], x["report_id"]) for x in U.fuse_replay(view(spark, SF, "report"), "region").collect()}
    feed = registry.QUERIES["feed_sink"](spark, SF).collect()
    assert {(x["incident_id"], x["report_id"]) for x in feed} == links and len(feed) == len(links)


def test_files_of_a_stream_grow_in_number_with_the_table(spark, monkeypatch):
    from muster.plans import q_stream

    monkeypatch.setattr(q_stream, "FILE_ROWS", 100)
    monkeypatch.setattr(q_stream, "TRIGGER_FILES", 2)
    asked, real = [], q_stream.order_files
    monkeypatch.setattr(q_stream, "order_files", lambda s, path: (asked.append(path), real(s, path)))
    want = rows(view(spark, SF, "report").select("report_id", "reported_at"))
    assert rows(registry.QUERIES["stream_source"](spark, SF)) == want
    made = [f for f in os.listdir(asked[0]) if f.startswith("part-")]
    assert len(made) >= len(want) // 100 and spark.read.parquet(asked[0]).columns == ["report_id", "reported_at"]
    assert max(spark.read.parquet(f"{asked[0]}/{f}").count() for f in made) < 300


def test_streamed_files_hold_no_whole_texts(spark):
    from muster.plans import q_stream

    s = q_stream.streamed(spark, SF)
    path = max(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/muster-in-*"), key=os.path.getmtime)
    texts = [r["text"] for r in spark.read.schema(s.schema).parquet(path).select("text").collect()]
    assert len(texts) == view(spark, SF, "report").count() and max(map(len, texts)) <= 16
    assert len(set(texts)) == view(spark, SF, "report").select(F.lower(F.trim("text"))).distinct().count()
    out, schema = q_stream.routed_late(spark, SF)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/in_time", f"{out}/late").select("text").collect()
    assert len(rows) == len(texts) and max(len(r["text"]) for r in rows) <= 16
