"""Queries over streams, the feed's state and review actions."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from muster.operators import review as W
from muster.plans.q_tables import SCORE_SQL
from muster.plans.registry import query
from muster.plans.views import short_view, view
from muster.runtime import shared_dir
from muster.streaming import stream as S

c = F.col
COLS = ("report_id", "reported_at", "is_synthetic", "caller_id", "latitude", "longitude", "location_text", "text")


FILE_ROWS = 50_000  # reports in one file of a stream
TRIGGER_FILES = 16


def streamed(spark, d, parts: int = 3, closing: bool = False, columns: tuple[str, ...] = COLS):
    """The report view's ``columns`` as files in the shared folder, read back as a stream in the order of event time.

    There are ``parts`` files at least and one for every ``FILE_ROWS`` reports, so that no task's range grows with the table; a trigger reads up to
    ``TRIGGER_FILES`` of them, or one of ``parts``. With ``closing``, a last row of nulls 8 hours on moves the watermark past
    every window of the reports; its own window stays open. Texts come as digests (``short_view``): fusion only compares them.
    """
    path = f"{shared_dir(spark)}/muster-in-{uuid.uuid4().hex}"
    r = short_view(spark, d).select(*columns)
    files = max(parts, -(-view(spark, d, "report").count() // FILE_ROWS))
    r.repartitionByRange(files, "reported_at").write.parquet(path)
    order_files(spark, path)
    if closing:
        late = spark.read.schema(r.schema).parquet(path).agg((F.max("reported_at") + F.expr("INTERVAL 8 HOURS")).alias("reported_at"))
        nulls = {f.name: F.lit(None).cast(f.dataType) for f in r.schema if f.name != "reported_at"}
        late.where("reported_at is not null").withColumns(nulls).select(*columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(r.schema).option("maxFilesPerTrigger", min(TRIGGER_FILES, -(-files // parts))).parquet(path)


def order_files(spark, path: str) -> None:
    """Set the files' times in the order of their ranges: a stream reads by time, and tasks end in any order.

    A range read after a later one would be dropped as late, so a file system without settable times is an error.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    last = int(time.time()) * 1000
    times = [last - 1000 * (len(files) - k) for k in range(len(files))]
    for p, t in zip(files, times):
        fs.setTimes(p, t, -1)
    if [fs.getFileStatus(p).getModificationTime() for p in files] != times:
        raise OSError(f"can't set the times of the files in {path}")


def drained(spark, df, mode: str = "append"):
    path = f"{shared_dir(spark)}/muster-out-{uuid.uuid4().hex}"
    S.drain(df, path, mode)
    return spark.read.schema(df.schema).parquet(path)


def stream_of(spark, df):
    """``df`` as files in the shared folder, read back as a stream of ``TRIGGER_FILES`` files a trigger, so that a trigger keeps as many tasks busy."""
    path = f"{shared_dir(spark)}/muster-in-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", TRIGGER_FILES).parquet(path)


@query("stream_source", "SELECT report_id, reported_at FROM report")
def _(spark, d):
    return drained(spark, streamed(spark, d, columns=("report_id", "reported_at")))


@query("stream_dedup", "SELECT report_id, reported_at FROM report")
def _(spark, d):
    s = streamed(spark, d, columns=("report_id", "reported_at", "latitude"))
    return drained(spark, S.dedup_stream(s.union(s.where("latitude is null"))).select("report_id", "reported_at"))


def routed_late(spark, d):
    """Two runs of one stream: nine tenths of the reports, then the rest, which is late where it lies far behind them."""
    base = f"{shared_dir(spark)}/muster-late-{uuid.uuid4().hex}"
    r = short_view(spark, d)
    reports = r.select(*COLS)
    for part in (r.where("event_id % 10 <> 0"), r.where("event_id % 10 = 0")):
        part.select(*COLS).write.mode("append").parquet(f"{base}/in")
        S.route_late(spark.readStream.schema(reports.schema).parquet(f"{base}/in"), f"{base}/out")
    return f"{base}/out", reports.schema


@query("late_reports", """SELECT report_id, reported_at FROM report WHERE event_id % 10 = 0 AND reported_at < (SELECT max(reported_at) FROM report WHERE event_id % 10 <> 0) - INTERVAL 6 HOUR""")
def _(spark, d):
    path, schema = routed_late(spark, d)
    return S.routed(spark, path, "late", schema).select("report_id", "reported_at")


@query("late_refused")
def _(spark, d):
    path, schema = routed_late(spark, d)
    return S.refuse_late(spark, path, schema)


@query("stream_pulse", "SELECT date_trunc('hour', reported_at) AS pulse, count(*) AS injected FROM report GROUP BY 1")
def _(spark, d):
    return drained(spark, S.pulse_stream(streamed(spark, d, closing=True, columns=("reported_at",))))


@query("stream_enrich", "SELECT report_id, r_regionkey FROM report LEFT JOIN region ON r_name = location_text")
def _(spark, d):
    from muster.plans.views import table

    regions = table(spark, d, "region").select(c("r_name").alias("location_text"), "r_regionkey")
    return drained(spark, S.enrich_stream(streamed(spark, d, columns=("report_id", "reported_at", "location_text")), regions, "location_text").select("report_id", "r_regionkey"))


@query("fuse_stream")
def _(spark, d):
    return drained(spark, S.fuse_stream(streamed(spark, d)))


@query("feed_sink")
def _(spark, d):
    path = f"{shared_dir(spark)}/muster-feed-{uuid.uuid4().hex}"
    S.feed_sink(S.fuse_stream(streamed(spark, d)), path)
    return S.read_feed(spark, path).select("event", F.get_json_object("payload", "$.incident_id").alias("incident_id"), F.get_json_object("payload", "$.report_id").alias("report_id"))


@query("sliding_activity", """SELECT user_id, start, count(*) AS n FROM (SELECT user_id, unnest(generate_series(date_trunc('hour', reported_at) - INTERVAL 5 HOUR, date_trunc('hour', reported_at), INTERVAL 1 HOUR)) AS start FROM report) GROUP BY ALL""")
def _(spark, d):
    return S.activity_window(view(spark, d, "report"), "user_id")


@query("apply_feed", """SELECT incident_id, arg_max(score, event_id) FILTER (WHERE score IS NOT NULL) AS score, arg_max(status, event_id) FILTER (WHERE status IS NOT NULL) AS status, max(event_at) AS updated_at FROM feed GROUP BY 1""")
def _(spark, d):
    return S.apply_feed(view(spark, d, "feed"))


ACT = """act AS (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'ACTIVE' WHEN 3 THEN 'ESCALATED' WHEN 4 THEN 'NEW' ELSE 'FALSE_REPORT' END AS target, CASE WHEN o_orderkey % 17 = 0 THEN 'ok' ELSE 'checked twice' END AS notes FROM incident),
ver AS (SELECT *, CASE WHEN length(trim(notes)) < 5 THEN 'NOTES_TOO_SHORT' WHEN status = target THEN 'NO_CHANGE' WHEN target = 'NEW' THEN 'TARGET_NOT_ALLOWED' WHEN status IN ('ACTIVE', 'NEEDS_REVIEW', 'VERIFIED') THEN NULL
 WHEN status = 'ESCALATED' AND target <> 'FALSE_REPORT' THEN NULL WHEN status = 'RESOLVED' AND target = 'ACTIVE' THEN NULL ELSE 'TRANSITION_NOT_ALLOWED' END AS rejected FROM act)"""


def actions(spark, d):
    k = c("o_orderkey")
    t = F.element_at(F.array(*map(F.lit, ("VERIFIED", "RESOLVED", "ACTIVE", "ESCALATED", "NEW", "FALSE_REPORT"))), (k % 6 + 1).cast("int"))
    i = view(spark, d, "incident")
    return i.select("incident_id", t.alias("target"), F.when(k % 17 == 0, "ok").otherwise("checked twice").alias("notes"), k)


@query("review_transition", f"WITH {ACT} SELECT incident_id, CASE WHEN rejected IS NULL THEN target ELSE status END AS status, rejected FROM ver")
def _(spark, d):
    return W.review_once(view(spark, d, "incident"), actions(spark, d).drop("o_orderkey")).select("incident_id", "status", "rejected")


@query("apply_reviews", f"""WITH {ACT}, one AS (SELECT *, CASE WHEN rejected IS NULL THEN target ELSE status END AS s1 FROM ver)
SELECT incident_id, 'a-' || o_orderkey AS action_id, status AS previous_status, s1 AS status, rejected FROM one
UNION ALL SELECT incident_id, 'b-' || o_orderkey, s1, CASE WHEN s1 IN ('NEEDS_REVIEW', 'VERIFIED', 'ESCALATED', 'RESOLVED') THEN 'ACTIVE' ELSE s1 END,
 CASE WHEN s1 = 'ACTIVE' THEN 'NO_CHANGE' WHEN s1 NOT IN ('NEEDS_REVIEW', 'VERIFIED', 'ESCALATED', 'RESOLVED') THEN 'TRANSITION_NOT_ALLOWED' END FROM one""")
def _(spark, d):
    a = actions(spark, d)
    two = a.select("incident_id", "target", "notes", F.concat(F.lit("a-"), "o_orderkey").alias("action_id"), F.lit(1).alias("at")).unionByName(
        a.select("incident_id", F.lit("ACTIVE").alias("target"), F.lit("back again").alias("notes"), F.concat(F.lit("b-"), "o_orderkey").alias("action_id"), F.lit(2).alias("at"))
    )
    return W.apply_reviews(view(spark, d, "incident"), two)


def overrides(spark, d):
    k = c("o_orderkey")
    field = F.when(k % 3 == 0, "priority_score").when(k % 3 == 1, "urgency").otherwise("people_at_risk_count")
    value = F.when(k % 3 == 0, (k % 120).cast("string")).when(k % 3 == 1, "CRITICAL").otherwise((k % 9 - 1).cast("string"))
    return view(spark, d, "incident").select(
        "incident_id", field.alias("field"), value.alias("new_value"), F.lit("seen on site").alias("reason"), c("created_at").alias("at"), F.concat(F.lit("o-"), k).alias("override_id")
    )


@query("override_priority", """SELECT incident_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 120 <= 100 WHEN 1 THEN true ELSE o_orderkey % 9 >= 1 END AS overridden, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 120 <= 100 THEN (o_orderkey % 120)::DOUBLE END AS priority_score,
 CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 120 > 100 THEN NULL WHEN o_orderkey % 120 >= 80 THEN 'CRITICAL' WHEN o_orderkey % 120 >= 60 THEN 'HIGH' WHEN o_orderkey % 120 >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS priority_level FROM incident""")
def _(spark, d):
    out = W.apply_overrides(view(spark, d, "incident"), overrides(spark, d))
    manual = (c("o_orderkey") % 3 == 0) & c("overridden")
    return out.select("incident_id", "overridden", F.when(manual, c("priority_score")).alias("priority_score"), F.when(manual, c("priority_level")).alias("priority_level"))


@query("apply_overrides")
def _(spark, d):
    return W.apply_overrides(view(spark, d, "incident"), overrides(spark, d))


# By order key: field, first value and how it is applied, second value and why it is rejected (None: it is applied, as a null).
TWICE = (
    ("incident_type", "flood_flash_flood ", "FLOOD_FLASH_FLOOD", None, None), ("urgency", "critical", "CRITICAL", "urgent", "VALUE_NOT_VALID"), ("people_at_risk_count", "7", "7", "-1", "VALUE_NOT_VALID"),
    ("location", '{"text":"mill","latitude":1.5,"longitude":2.5,"precision":"exact"}', '{"text":"mill","latitude":1.5,"longitude":2.5,"precision":"EXACT"}', '{"latitude":99.0}', "VALUE_NOT_VALID"),
    ("required_response", '["police_security","medical_ems"]', '["MEDICAL_EMS","POLICE_SECURITY"]', '["ANIMALS"]', "VALUE_NOT_VALID"), ("priority_score", "61.234", "61.23", "12", "REASON_TOO_SHORT"),
)


def twice(spark, d):
    k = c("o_orderkey")
    of = lambda i: F.get(F.array(*[F.lit(x[i]) for x in TWICE]), (k % 6).cast("int"))
    v = view(spark, d, "incident")
    first = v.select("incident_id", of(0).alias("field"), of(1).alias("new_value"), F.lit("seen on site").alias("reason"), c("created_at").alias("at"), F.concat(F.lit("a-"), k).alias("override_id"))
    reason = F.when(k % 6 == 5, "no").otherwise("seen again")
    return first.unionByName(v.select("incident_id", of(0).alias("field"), of(3).alias("new_value"), reason.alias("reason"), c("created_at").alias("at"), F.concat(F.lit("b-"), k).alias("override_id")))


def _sql(v) -> str:
    return "NULL" if v is None else "'" + v + "'"


@query("override_ledger", f"""WITH t(i, field, v1, a1, v2, why) AS (VALUES {', '.join(f"({i}, {', '.join(map(_sql, x))})" for i, x in enumerate(TWICE))}),
j AS (SELECT n.*, t.* FROM incident n JOIN t ON t.i = n.o_orderkey % 6)
SELECT incident_id, 'a-' || o_orderkey AS override_id, field, CASE field WHEN 'incident_type' THEN incident_type WHEN 'urgency' THEN urgency WHEN 'people_at_risk_count' THEN people_at_risk_count::VARCHAR END AS previous_value,
 CASE WHEN field = 'location' THEN latitude END AS previous_latitude, a1 AS applied_value, NULL AS rejected FROM j
UNION ALL SELECT incident_id, 'b-' || o_orderkey, field, CASE WHEN field <> 'location' THEN a1 END, CASE WHEN field = 'location' THEN 1.5 END, NULL, why FROM j""")
def _(spark, d):
    out = W.override_ledger(view(spark, d, "incident"), twice(spark, d))
    here = c("field") == "location"
    return out.select(
        "incident_id", "override_id", "field", F.when(~here, c("previous_value")).alias("previous_value"),
        F.when(here, F.get_json_object("previous_value", "$.latitude").cast("double")).alias("previous_latitude"), "applied_value", "rejected",
    )


@query("overridden_fields", """SELECT incident_id, CASE WHEN o_orderkey % 6 <> 0 THEN incident_type END AS incident_type, CASE WHEN o_orderkey % 6 = 1 THEN 'CRITICAL' ELSE urgency END AS urgency,
 CASE WHEN o_orderkey % 6 = 2 THEN 7 ELSE people_at_risk_count END AS people_at_risk_count, CASE WHEN o_orderkey % 6 = 3 THEN 'mill' ELSE 'here' END AS location_text, CASE WHEN o_orderkey % 6 = 3 THEN 1.5 ELSE latitude END AS latitude,
 CASE WHEN o_orderkey % 6 = 4 THEN 'MEDICAL_EMS,POLICE_SECURITY' ELSE 'FIRE_HAZMAT' END AS responses FROM incident""")
def _(spark, d):
    state = view(spark, d, "incident").withColumns({"location_text": F.lit("here"), "required_response": F.array(F.lit("FIRE_HAZMAT"))})
    out = W.apply_overrides(state, twice(spark, d))
    return out.select("incident_id", "incident_type", "urgency", "people_at_risk_count", "location_text", "latitude", F.array_join("required_response", ",").alias("responses"))
