"""The replay against a loop that knows nothing of arrays, cuts and slices; streams and slices agree with it."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from muster.operators import fusion as U
from muster.operators import replay as R

WORDS = ("mill road", "mill", "old mill road", "harbour", "harbour east", None, "unknown", "Unlocated hut", "a b")


def r4(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def norm(t):
    t = (t or "").strip().lower()
    return t if t and t not in ("unknown", "none", "null", "n/a", "unspecified") else None


def region(r):
    if r["latitude"] is not None and r["longitude"] is not None:
        return (math.floor(r["latitude"] / 0.25), math.floor(r["longitude"] / 0.25))
    p = norm(r["location_text"])
    return p.split()[0] if p else None


def located(x):
    return x["lat"] is not None and x["lon"] is not None


def space(a, b):
    """Kind and points of two places, written out from the rules."""
    if located(a) and located(b):
        p, q = math.radians(a["lat"]), math.radians(b["lat"])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
        return "COORDINATES", r4(max(0.0, 1 - 6371 * 2 * math.asin(min(1.0, math.sqrt(h))) / 2.5))
    s, t = a["place"], b["place"]
    if s is None or t is None:
        return "UNKNOWN", 0.5
    if s == t:
        return "EXACT_TEXT", 0.9
    if (len(s) >= 3 and s in t) or (len(t) >= 3 and t in s) or any(len(w) >= 3 for w in set(s.split()) & set(t.split())):
        return "SUBSTRING_TEXT", 0.6
    return "CONFLICTING_TEXT", 0.0


def brute(reports, mode, semantic):
    """Every incident ever opened is scored against every report, one by one."""
    ranks, out, worlds = {"UNKNOWN": 1, "APPROXIMATE": 2, "EXACT": 3}, set(), {}
    for r in sorted((x for x in reports if x["hours"] is not None), key=lambda x: (x["hours"], x["report_id"])):
        world = worlds.setdefault((r["is_synthetic"], region(r) if mode == "region" else 0), [])
        me = {"lat": r["latitude"], "lon": r["longitude"], "place": norm(r["location_text"])}
        text, source, best = norm(r["text"]), (r["caller_id"] or "").strip() or None, None
        for i in world:
            gap = r["hours"] - i["last"]
            if gap > 6:
                continue
            kind, p = space(me, i)
            t, s = r4(math.exp(-gap / 3)), None
            if semantic and r["vector"] and i["vector"]:
                s = r4(sum(a * b for a, b in zip(r["vector"], i["vector"])) / math.sqrt(sum(a * a for a in r["vector"])) / math.sqrt(sum(a * a for a in i["vector"])))
            score = r4(max(0.0, min(1.0, 0.4444 * t + 0.5556 * p if s is None else 0.55 * s + 0.2 * t + 0.25 * p)))
            conflict = kind == "CONFLICTING_TEXT"
            unsure = s is not None and s >= 0.7 and conflict
            if unsure or (not conflict and score >= 0.7):
                key = (-score, -i["last"], i["id"])
                if best is None or key < best[0]:
                    best = (key, i, score, unsure)
        if best is None:
            world.append({"id": "inc-" + r["report_id"], "last": r["hours"], **me, "prec": ranks.get(r["location_precision"], 1), "vector": r["vector"], "texts": {text}, "sources": {source}})
            out.add((r["report_id"], "inc-" + r["report_id"], "INITIAL", None))
            continue
        _, i, score, unsure = best
        if unsure:
            relation = "UNCERTAIN"
        elif (text is not None and text in i["texts"]) or (source is not None and source in i["sources"]) or (score >= 0.85 and source is None):
            relation = "DUPLICATE"
        else:
            relation = "CORROBORATING"
        i["last"] = max(i["last"], r["hours"])
        i["texts"].add(text), i["sources"].add(source)
        rank = ranks.get(r["location_precision"], 1)
        if not unsure and located(me) and (not located(i) or rank > i["prec"]):
            i.update(lat=me["lat"], lon=me["lon"], prec=rank, place=me["place"] or i["place"])
        out.add((r["report_id"], i["id"], relation, score))
    return out | {(r["report_id"], "inc-" + r["report_id"], "INITIAL", None) for r in reports if r["hours"] is None}


def made(n, hours, seed, spots=8):
    rng = random.Random(seed)
    themes = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for k in range(n):
        has = rng.random()
        lat, lon = (20 + rng.randrange(spots) * 0.006, 85 + rng.randrange(spots) * 0.006) if has < 0.5 else (None, None)
        theme = rng.choice(themes)
        rows.append({
            "report_id": f"r{k:05d}", "hours": None if rng.random() < 0.01 else round(rng.random() * hours * 3600) / 3600, "is_synthetic": rng.random() < 0.3,
            "latitude": lat, "longitude": lon, "location_text": rng.choice(WORDS), "location_precision": rng.choice(["UNKNOWN", "APPROXIMATE", "EXACT", None]),
            "text": rng.choice(["fire", "Fire ", "smoke", None, "water"]) , "caller_id": rng.choice(["a", "b", " c ", "", None]),
            "vector": None if rng.random() < 0.2 else [x + rng.gauss(0, 0.5) for x in theme],
        })
    return rows


def frame(spark, rows):
    schema = "report_id string, us long, is_synthetic boolean, latitude double, longitude double, location_text string, location_precision string, text string, caller_id string, embedding array<double>"
    data = [(r["report_id"], None if r["hours"] is None else round(r["hours"] * 3_600_000_000), *[r[c] for c in ("is_synthetic", "latitude", "longitude", "location_text", "location_precision", "text", "caller_id", "vector")]) for r in rows]
    return spark.createDataFrame(data, schema).withColumn("reported_at", F.timestamp_micros("us")).drop("us")


def links(df):
    return {(x["report_id"], x["incident_id"], x["relationship_type"], x["similarity_score"]) for x in df.collect()}


@pytest.mark.parametrize("mode,semantic,hours", [("region", False, 60), ("exact", False, 60), ("region", True, 40), ("exact", True, 12)])
def test_replay_is_the_plain_loop(spark, mode, semantic, hours):
    rows = made(500, hours, 5)
    want = brute(rows, mode, semantic)
    assert links(U.fuse_replay(frame(spark, rows), mode, semantic=semantic, dim=8)) == want
    if semantic:
        assert {x[2] for x in want} == {"INITIAL", "DUPLICATE", "CORROBORATING", "UNCERTAIN"} or mode == "region"


def test_slices_of_a_dense_block_agree(spark):
    rows = made(400, 20, 9)
    df = frame(spark, rows)
    want = brute(rows, "exact", False)
    assert links(U.fuse_replay(df, "exact", slice_rows=40)) == want


def test_slices_settle_in_few_rounds(spark):
    rows = [dict(r, is_synthetic=False) for r in made(600, 10, 3, spots=3) if r["latitude"] is not None and r["hours"] is not None]
    df = R.session_blocks(R.narrow_reports(frame(spark, rows), R.region_block(frame(spark, rows)), False, 8), 6.0, ("is_synthetic", "region"))
    out, rounds = R.replay_blocks(df, slice_rows=20)
    assert out.count() == len(rows) and rounds < len(rows) / 20 / 2


def test_odd_reports(spark):
    rows = made(6, 1, 1)
    for r in rows[:3]:
        r.update(latitude=95.0, longitude=10.0, location_text=None)
    rows[3].update(text="", caller_id=" ")
    assert links(U.fuse_replay(frame(spark, rows).limit(0))) == set()
    got = links(U.fuse_replay(frame(spark, rows)))
    assert {x[0] for x in got} == {r["report_id"] for r in rows}


def test_only_a_located_report_refines_the_place(spark):
    df = spark.createDataFrame(
        [("APPROXIMATE", None, "mill", "EXACT", None, "harbour"), ("EXACT", None, "mill", "UNKNOWN", 2.0, None), ("APPROXIMATE", 1.0, "mill", "EXACT", 2.0, "harbour"), ("EXACT", 1.0, "mill", "EXACT", 2.0, "harbour")],
        "i_location_precision string, i_latitude double, i_location_text string, r_location_precision string, r_latitude double, r_location_text string",
    )
    for s in "ir":
        df = df.withColumns({f"{s}_longitude": F.col(f"{s}_latitude"), f"{s}_urgency": F.lit("LOW"), f"{s}_people_count": F.lit(1), f"{s}_incident_type": F.lit("x")})
    got = [tuple(r) for r in U.fuse_pair(df).select("location_text", "latitude", "location_precision").collect()]
    assert got == [("mill", None, "APPROXIMATE"), ("mill", 2.0, "UNKNOWN"), ("harbour", 2.0, "EXACT"), ("mill", 1.0, "EXACT")]
    held = U.fuse_pair(df.withColumn("conflict", F.lit(True)), "conflict")
    assert [r["latitude"] for r in held.collect()] == [None, None, 1.0, 1.0]


def test_vectors_that_cannot_match_are_replayed_apart(spark):
    rnd = random.Random(2)
    rows = [dict(r, vector=[(3.0 if i == k % 4 else 0.0) + rnd.gauss(0, 0.2) for i in range(8)]) for k, r in enumerate(made(300, 12, 21))]
    want = brute(rows, "exact", True)
    assert links(U.fuse_replay(frame(spark, rows), "exact", semantic=True, dim=8)) == want
    narrow = R.narrow_reports(frame(spark, rows), F.lit("all"), True, 8)
    cut = R.apart_by_vectors(narrow)
    assert cut.count() == 300 and cut.select("region").distinct().count() > 1
    blind = narrow.withColumn("vector", F.when(F.col("report_id") != "r00001", F.col("vector")))
    kind = next(r["is_synthetic"] for r in rows if r["report_id"] == "r00001")
    assert R.apart_by_vectors(blind).where(F.col("is_synthetic") == kind).select("region").distinct().count() == 1


def test_few_and_many_open_incidents_are_decided_alike(monkeypatch):
    rnd, rows, got = random.Random(4), [], []
    for k in range(400):
        has = rnd.random() < 0.6
        rows.append({
            "report_id": f"r{k:04d}", "hours": k * 0.01, "lat": 20 + rnd.randrange(9) * 0.006 if has else None, "lon": 85 + rnd.randrange(9) * 0.006 if has else None,
            "place": norm(rnd.choice(WORDS)), "precision": rnd.choice([1, 2, 3]), "vector": None,
        })
    for few in (0, 1000):
        monkeypatch.setattr(R, "FEW", few, raising=False)
        fuser = R.Fuser()
        got.append(([fuser.add(r) for r in rows], fuser.state(4.0)))
    assert got[0] == got[1] and len(got[0][1]) > 5


def test_tables_that_no_later_step_reads_are_deleted(spark):
    import glob

    from muster.runtime import shared_dir

    here = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/muster-*"))
    rows, before = made(200, 8, 11), here()
    out = U.fuse_replay(frame(spark, rows), "exact", slice_rows=40)
    left = {p.split("muster-")[-1].rsplit("-", 1)[0] for p in here() - before}
    assert links(out) == brute(rows, "exact", False) and not left & {"blocks", "replay", "slices"} and "replayed" in left
