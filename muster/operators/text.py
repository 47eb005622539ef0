"""Text jobs over the report table: cleaning, lexicon hits, classification, people, places, responses, urgency.

Lexicons are small tables. A report's word runs of the lexicon's lengths meet them in one broadcast hash join, so the cost
follows the number of words, not words times terms.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from muster.config import DEFAULT, INCIDENT_TYPES, OTHER, RESPONSES, Config
from muster.functions import scalars as S
from muster.operators.aggregates import harmonic_confidence
from muster.operators.hooks import isolated
from muster.operators.lexscan import entity_spans
from muster.runtime import arrow_batches, broadcast_if_small, materialize

WORD = r"[\p{L}\p{N}']+"
MAX_TERM_WORDS = 4
PLAN_TERMS = 5_000  # a lexicon of so many terms is looked for while a text's words are read


# -- cleaning ------------------------------------------------------------------------------------------------------


def strip_markup(text: Column) -> Column:
    """Scripts, styles, comments and tags become a space."""
    for pattern in (r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", r"(?is)<(script|style)\b.*$", r"(?s)<!--.*?-->", r"(?s)</?[a-zA-Z][^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def tidy_spaces(text: Column) -> Column:
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f​-‏ -‮⁠﻿]", " ")
    text = F.regexp_replace(text, r"[\s ]+", " ")
    return F.trim(F.regexp_replace(text, r" +([!?,.:;])", "$1"))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def clean_reports(df: DataFrame, most: int = 4000) -> DataFrame:
    """``clean``, ``modified``, ``truncated`` and ``clean_error`` beside the input; nothing is dropped."""
    arrow_batches(df.sparkSession)
    whole = tidy_spaces(_unescape(strip_markup(_nfkc(F.col("text")))))
    out = df.withColumn("_c", whole)
    error = F.when(F.col("text").isNull() | (F.trim("text") == ""), "EMPTY").when(F.length("_c") < 3, "TOO_SHORT")
    return out.withColumns({
        "clean": F.when(error.isNull(), F.trim(F.substring("_c", 1, most))), "modified": F.coalesce(F.col("_c") != F.col("text"), F.lit(False)),
        "truncated": F.coalesce(F.length("_c") > most, F.lit(False)), "clean_error": error,
    }).drop("_c")


# -- lexicon hits --------------------------------------------------------------------------------------------------


def word_runs(text: Column, longest: int = MAX_TERM_WORDS) -> Column:
    """All distinct runs of one to ``longest`` words. The words are bound once, as a lambda's argument."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def runs(w: Column, n: int) -> Column:
        if n == 1:
            return w
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    bound = F.transform(F.array(words), lambda w: F.concat(*[runs(w, n) for n in range(1, longest + 1)]))
    return F.array_distinct(bound[0])


def term_runs(text: Column, terms: list[str], longest: int = MAX_TERM_WORDS) -> Column:
    """The distinct ones of ``terms`` that are word runs of ``text``. A run is only put together where its first word begins a term."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    by = {n: sorted({t for t in terms if t.count(" ") + 1 == n}) for n in range(1, longest + 1)}

    def runs(w: Column, n: int) -> Column:
        if n == 1:
            return F.array_intersect(w, listed(by[1]))
        heads = sorted({t.split(" ")[0] for t in by[n]})
        starts = F.filter(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.element_at(w, i).isin(*heads))
        whole = F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        there = (F.size(w) >= n) & F.arrays_overlap(w, listed(heads))
        return F.when(there, F.array_intersect(whole, listed(by[n]))).otherwise(listed([]))

    some = [n for n in by if by[n]]
    if not some:
        return listed([])
    return F.transform(F.array(words), lambda w: F.concat(*[runs(w, n) for n in some]))[0]


def lexicon_hits(df: DataFrame, lexicon: DataFrame, key: str = "report_id", text: str = "text", longest: int = MAX_TERM_WORDS) -> DataFrame:
    """``(key, <lexicon columns>)``: every term that a report contains, once. ``lexicon.term`` is in lower case."""
    few = [r["term"] for r in lexicon.select("term").where("term is not null").distinct().limit(PLAN_TERMS + 1).collect()]
    found = term_runs(F.col(text), few, longest) if len(few) <= PLAN_TERMS else word_runs(F.col(text), longest)
    runs = df.select(key, F.explode(found).alias("term"))
    return runs.join(broadcast_if_small(lexicon, 200_000), "term")


def keyword_scores(df: DataFrame, lexicon: DataFrame, key: str = "report_id", text: str = "text", longest: int = MAX_TERM_WORDS) -> DataFrame:
    """``(key, class, score)``: phrases count 2, keywords 1, saturating at 2.5."""
    weight = F.when(F.col("tier") == "phrase", 2.0).otherwise(1.0)
    hits = lexicon_hits(df, lexicon, key, text, longest)
    return hits.groupBy(key, "class").agg(F.round(F.least(F.lit(1.0), F.sum(weight) / 2.5), 4).alias("score"))


def prototype_scores(df: DataFrame, protos: DataFrame, key: str = "report_id", dim: int = 64) -> DataFrame:
    """Largest cosine of each report with each class' prototypes ``(class, proto)``; prototypes are few and broadcast."""
    pairs = df.select(key, "embedding").crossJoin(broadcast_if_small(protos))
    return pairs.select(key, "class", S.cosine(F.col("embedding"), F.col("proto"), dim).alias("cos")).groupBy(key, "class").agg(F.max("cos").alias("cos"))


def semantic_scores(df: DataFrame, protos: DataFrame, key: str = "report_id", dim: int = 64) -> DataFrame:
    raw = (F.col("cos") - 0.20) / 0.50
    return prototype_scores(df, protos, key, dim).select(key, "class", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4).alias("score"))


# Which of two near-equal hazards is the primary one.
PRECEDENCE = (
    "FIRE_WILDFIRE_EXPLOSION", "STRUCTURAL_COLLAPSE", "EARTHQUAKE_LANDSLIDE", "FLOOD_FLASH_FLOOD", "SEVERE_WEATHER_STORM",
    "CIVIL_UNREST_ACTIVE_THREAT", "MEDICAL_EMERGENCY", "UTILITY_INFRASTRUCTURE_FAILURE", "OTHER_GENERAL_INCIDENT",
)


def classify_map(scores: Column, cfg: Config = DEFAULT) -> Column:
    """``(incident_type, confidence, type_status, secondary_hazard)`` from a map of class scores; absent classes score 0.

    Each step is bound once, as a lambda's argument, so that no expression repeats the one before.
    """
    bind = lambda x, f: F.transform(F.array(x), f)[0]
    order = F.array(*map(F.lit, PRECEDENCE))

    def ranked(m: Column) -> Column:
        of = lambda k: F.coalesce(m[k], F.lit(0.0))
        every = F.array(*[F.struct((-of(k)).alias("neg"), F.lit(i).alias("i"), F.lit(k).alias("class")) for i, k in enumerate(INCIDENT_TYPES)])
        return F.slice(F.array_sort(every), 1, 2)

    def chosen(r: Column) -> Column:
        top, sec = r[0], r[1]
        t, s = -top["neg"], -sec["neg"]
        swap = (F.abs(t - s) < 0.03) & (t > 0.10) & (F.array_position(order, sec["class"]) < F.array_position(order, top["class"]))
        conflict = (s >= 0.35) & (s >= 0.70 * t) & (top["class"] != OTHER) & (sec["class"] != OTHER)
        return F.struct(
            F.when(swap, sec["class"]).otherwise(top["class"]).alias("l"), F.when(swap, s).otherwise(t).alias("t"), F.when(swap, t).otherwise(s).alias("s"),
            F.when(conflict, sec["class"]).alias("h"),
        )

    def judged(x: Column) -> Column:
        weak = x["t"] < 0.35
        conf = (
            F.when(weak, F.greatest(F.lit(0.20), F.least(F.lit(0.48), x["t"]))).when(x["l"] == OTHER, F.least(F.lit(0.70), x["t"]))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.10), x["t"] + 0.05 * (x["t"] - x["s"]))))
        )
        conf = F.round(conf, 2)
        status = F.when(weak | (conf < cfg.review_confidence), "NEEDS_REVIEW").otherwise("SUCCESS")
        return F.struct(F.when(weak, OTHER).otherwise(x["l"]).alias("incident_type"), conf.alias("confidence"), status.alias("type_status"), x["h"].alias("secondary_hazard"))

    return bind(bind(bind(F.coalesce(scores, F.create_map().cast("map<string,double>")), ranked), chosen), judged)


def classify(df: DataFrame, scores: DataFrame, key: str = "report_id", cfg: Config = DEFAULT) -> DataFrame:
    """Label, confidence, status and secondary hazard from ``scores(key, class, score)``; absent classes score 0."""
    found = scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("m"))
    return df.select(key).join(found, key, "left").select(key, classify_map(F.col("m"), cfg).alias("c")).select(key, "c.*")


def hybrid_scores(keyword: DataFrame, semantic: DataFrame, key: str = "report_id") -> DataFrame:
    both = keyword.select(key, "class", (F.col("score") * 0.4).alias("s")).unionByName(semantic.select(key, "class", (F.col("score") * 0.6).alias("s")))
    return both.groupBy(key, "class").agg(F.round(F.sum("s"), 4).alias("score"))


# -- people and places ---------------------------------------------------------------------------------------------

# Our own signals: signal, term.
RISK_TERMS = (
    ("TRAPPED", "trapped"), ("TRAPPED", "stuck inside"), ("INJURED", "injured"), ("INJURED", "hurt"), ("CASUALTY", "dead"), ("UNCONSCIOUS", "unconscious"),
    ("MISSING", "missing"), ("DROWNING", "drowning"), ("CHILDREN", "children"), ("CHILDREN", "child"), ("ELDERLY", "elderly"), ("PATIENTS", "patients"),
    ("MULTIPLE_PEOPLE", "several people"), ("MULTIPLE_PEOPLE", "many people"), ("MULTIPLE_PEOPLE", "multiple people"), ("MULTIPLE_PEOPLE", "group of people"),
)


def terms(spark, rows, names: str) -> DataFrame:
    return spark.createDataFrame(list(rows), names)


def risk_signals(df: DataFrame, lexicon: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    return lexicon_hits(df, lexicon, key, text).groupBy(key).agg(F.array_sort(F.collect_set("signal")).alias("signals"))


_NUM = r"(?:\d{1,3}(?:,\d{3})*|\d+|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty)(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?)"
_PEOPLE = r"(people|persons?|residents?|children|kids|adults?|workers|passengers|students|patients|victims|men|women)"
_COUNT = re.compile(rf"\b(?:(exactly|at least|about|around|approximately|up to|maybe|over|more than)\s+)?({_NUM})\s+(?:\w+\s+)?{_PEOPLE}\b", re.I)
_TOTAL = re.compile(rf"\b(?:a\s+)?total of\s+({_NUM})\b", re.I)
_NOT_PEOPLE = re.compile(rf"\b(?:room|floor|apartment|unit|route|highway|exit|gate|block|call|phone)\s+#?\d+\b|\b\d{{3}}[- ]\d{{3,4}}\b|\b\d{{1,2}}:\d{{2}}\b|\b{_NUM}\s+(?:minutes?|hours?|days?|miles?|km|meters?|feet|cars?|houses?)\b", re.I)
_SURE = {"exactly": 0.92, "at least": 0.80, "over": 0.80, "more than": 0.80, "about": 0.75, "around": 0.75, "approximately": 0.75, "up to": 0.65, "maybe": 0.60}


def _number(token: str) -> int | None:
    token = token.lower().replace(",", "")
    if token.isdigit():
        return int(token) if int(token) <= 10_000 else None
    parts = re.split(r"[- ]", token)
    return sum(S.WORD_VALUES[p] for p in parts) if all(p in S.WORD_VALUES for p in parts) else None


def count_people(text: str) -> tuple[int | None, float | None, str | None]:
    """Count, confidence and warning of one text: a single count, a stated total, disjoint groups summed, else the most."""
    masked = _NOT_PEOPLE.sub(lambda m: " " * len(m[0]), text)
    found = [(n, m[3].lower(), _SURE.get((m[1] or "").lower(), 0.92)) for m in _COUNT.finditer(masked) if (n := _number(m[2])) is not None]
    if not found:
        return None, None, None
    if len(found) == 1:
        return found[0][0], found[0][2], None
    if (total := _TOTAL.search(masked)) and (n := _number(total[1])) is not None:
        return n, 0.92, None
    kinds = {"children" if k in ("children", "kids") else "adults" if k.startswith(("adult", "men", "women")) else k for _, k, _ in found}
    if len(found) == 2 and kinds == {"children", "adults"}:
        return found[0][0] + found[1][0], min(found[0][2], found[1][2]), None
    n, _, sure = max(found)
    return n, sure, "MULTIPLE_COUNTS"


def people_at_risk(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    arrow_batches(df.sparkSession)

    @F.pandas_udf("people_count int, people_confidence double, people_warning string")
    def counted(texts: pd.Series) -> pd.DataFrame:
        rows = [count_people(t or "") for t in texts]
        out = pd.DataFrame(rows, columns=["people_count", "people_confidence", "people_warning"])
        return out.astype({"people_count": "Int32"})

    return df.select(key, counted(text).alias("p")).select(key, "p.*")


def vocab_entities(df: DataFrame, gazetteer: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """Entities by vocabulary alone: ``gazetteer(term, entity_type)``."""
    return lexicon_hits(df, gazetteer, key, text).select(key, "entity_type", "term")


_COMPOUND = re.compile(r"\b((?:[A-Z][\w']+\s+){1,3}(?:Street|Road|Avenue|Bridge|Hospital|School|Station|Square|Park|Market|Tower|River|Lane|Mall))\b")
_ROAD = re.compile(r"\b((?:NH|SH|US|I|A|M|E|B)-?\d{1,4})\b")


def rule_spans(t: str) -> list[tuple[int, int, str]]:
    """Compound names and road codes."""
    return [(m.start(1), m.end(1), "LANDMARK") for m in _COMPOUND.finditer(t)] + [(m.start(1), m.end(1), "ROAD") for m in _ROAD.finditer(t)]


def extract_entities(df: DataFrame, gazetteer: DataFrame, key: str = "report_id", text: str = "text", ner: Callable[[list[str]], list] | None = None) -> DataFrame:
    """``(key, entities)``: compound names, road codes, terms of a gazetteer of any size, and what ``ner`` finds; longest first,
    none overlapping."""
    return entity_spans(df, gazetteer.select(F.lower("term").alias("term"), "entity_type"), rule_spans, ner, key, text).select(key, "entities")


NAME = r"((?:[A-Z][\w']+)(?:\s+[A-Z][\w']+){0,3})"
# Ordered rules: pattern, precision, confidence. The first that matches is the place.
PLACE_RULES = (
    (rf"(?:corner|intersection|junction) of {NAME} and {NAME}", "EXACT", 0.90),
    (rf"between {NAME} and {NAME}", "APPROXIMATE", 0.75),
    (rf"\d+ (?:km|miles|meters) (?:from|north of|south of|east of|west of) {NAME}", "APPROXIMATE", 0.70),
    (rf"(?:inside|at) (?:the )?{NAME}", "EXACT", 0.85),
    (rf"(?:near|on|along|behind|outside) (?:the )?{NAME}", "APPROXIMATE", 0.75),
)


def place_of(text: Column) -> Column:
    """The first rule's place with precision and confidence, else null; never coordinates."""
    hit = F.lit(None).cast("struct<text:string,precision:string,confidence:double>")
    for pattern, precision, sure in PLACE_RULES:
        whole = F.regexp_extract(text, pattern, 0)
        groups = [F.regexp_extract(text, pattern, g) for g in range(1, pattern.count(NAME) + 1)]
        place = F.struct(F.array_join(F.array(*groups), " and ").alias("text"), F.lit(precision).alias("precision"), F.lit(sure).alias("confidence"))
        hit = F.coalesce(hit, F.when(whole != "", place))
    return hit


def extract_location(df: DataFrame, entities: DataFrame | None = None, key: str = "report_id", text: str = "text") -> DataFrame:
    """The first rule's place with precision and confidence, else the first entity; never coordinates."""
    out = df.select(key, place_of(F.col(text)).alias("p"))
    if entities is not None:
        first = F.struct(F.col("entities")[0]["text"].alias("text"), F.lit("APPROXIMATE").alias("precision"), F.lit(0.6).cast("double").alias("confidence"))
        joined = out.join(entities, key, "left")
        out = joined.select(key, F.coalesce("p", F.when(F.size("entities") > 0, first)).alias("p"))
    return out.select(key, F.col("p.text").alias("place"), F.coalesce("p.precision", F.lit("UNKNOWN")).alias("place_precision"), F.col("p.confidence").alias("place_confidence"))


# -- responses and urgency -----------------------------------------------------------------------------------------

# Our own tables: category, tier, term. Ids in negations exist in the other rows.
RESPONSE_TERMS = (
    ("SEARCH_AND_RESCUE", "strong", "trapped"), ("SEARCH_AND_RESCUE", "strong", "rescue team"), ("SEARCH_AND_RESCUE", "supporting", "stranded"), ("SEARCH_AND_RESCUE", "negation", "no one trapped"),
    ("MEDICAL_EMS", "strong", "ambulance"), ("MEDICAL_EMS", "strong", "not breathing"), ("MEDICAL_EMS", "supporting", "injured"), ("MEDICAL_EMS", "negation", "no injuries"),
    ("FIRE_HAZMAT", "strong", "fire"), ("FIRE_HAZMAT", "strong", "gas leak"), ("FIRE_HAZMAT", "supporting", "smoke"), ("FIRE_HAZMAT", "negation", "no fire"),
    ("POLICE_SECURITY", "strong", "gunman"), ("POLICE_SECURITY", "supporting", "fight"), ("PUBLIC_WORKS_UTILITY", "strong", "power line"), ("PUBLIC_WORKS_UTILITY", "supporting", "outage"),
    ("ANY", "doubt", "maybe"), ("ANY", "doubt", "possibly"), ("ANY", "doubt", "might be"),
)


def required_responses(df: DataFrame, lexicon: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """``(key, responses)``: categories with confidence of 0.50 or more, in canonical order. A negated category is absent."""
    hits = lexicon_hits(df, lexicon, key, text)
    n = lambda tier: F.count_if(F.col("tier") == tier)
    doubt = hits.where("tier = 'doubt'").select(key).distinct().withColumn("doubt", F.lit(True))
    per = hits.where("class <> 'ANY'").groupBy(key, "class").agg(n("strong").alias("s"), n("supporting").alias("p"), n("negation").alias("no"))
    per = per.join(doubt, key, "left").where("no = 0 and s + p > 0")
    strong = F.when(F.col("s") >= 2, 0.94).otherwise(0.92)
    conf = F.when(F.col("s") > 0, F.when(F.col("doubt"), F.greatest(F.lit(0.55), strong - 0.22)).otherwise(strong)).otherwise(
        F.when(F.col("doubt"), F.greatest(F.lit(0.50), F.lit(0.72) - 0.18)).otherwise(0.72)
    )
    place = F.array_position(F.array(*map(F.lit, RESPONSES)), F.col("class"))
    kept = per.withColumn("c", F.round(conf, 2)).where("c >= 0.5")
    one = F.struct(place.alias("i"), F.col("class").alias("type"), F.col("c").alias("confidence"))
    arr = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["type"], x["confidence"]))
    return kept.groupBy(key).agg(arr.alias("responses"))


# Our own tables: dimension, signal, base score, term.
URGENCY_TERMS = (
    ("life", "TRAPPED", 85.0, "trapped"), ("life", "INJURED", 50.0, "injured"), ("life", "UNCONSCIOUS", 80.0, "unconscious"), ("life", "DROWNING", 85.0, "drowning"),
    ("life", "MISSING", 45.0, "missing"), ("velocity", "ACTIVE_FIRE", 70.0, "fire"), ("velocity", "ACTIVE_FLOODING", 65.0, "flood"), ("velocity", "COLLAPSE", 75.0, "collapsed"),
    ("vulnerable", "CHILDREN_AT_RISK", 85.0, "children"), ("vulnerable", "ELDERLY_AT_RISK", 80.0, "elderly"), ("vulnerable", "PATIENTS_AT_RISK", 85.0, "patients"),
    ("negation", "TRAPPED", 0.0, "no one trapped"), ("negation", "INJURED", 0.0, "no injuries"), ("distress", "PLEA", 15.0, "please help"), ("distress", "SOS", 20.0, "sos"),
    ("temporal", "NOW", 15.0, "spreading"), ("temporal", "NOW", 15.0, "rapidly"), ("history", "HISTORICAL", 0.0, "last year"), ("contained", "CONTAINED", 0.0, "under control"),
    ("hedge", "HEDGE", 0.0, "might be"), ("hedge", "HEDGE", 0.0, "someone said"), ("novulnerable", "NONE", 0.0, "no children"),
)


def score_urgency(df: DataFrame, lexicon: DataFrame, key: str = "report_id", text: str = "text", count: str = "people_count") -> DataFrame:
    """Three dimensions, score and label, from signal hits minus the negated ones; one shuffle by report."""
    hits = lexicon_hits(df.select(key, text), lexicon, key, text)
    hits = hits.groupBy(key).agg(F.collect_set(F.struct("dim", "signal", "base")).alias("h"))  # at most the lexicon
    negated = F.transform(F.filter("h", lambda x: x["dim"] == "negation"), lambda x: x["signal"])
    hits = hits.withColumn("negated", negated)
    kept = F.filter("h", lambda x: ~F.coalesce((x["dim"] == "life") & F.array_contains("negated", x["signal"]), F.lit(False)))
    live = hits.select(key, F.inline(kept))
    is_ = lambda d: F.col("dim") == d
    top = lambda d: F.coalesce(F.max(F.when(is_(d), F.col("base"))), F.lit(0.0))
    many = lambda d: F.least(F.lit(15.0), F.greatest(F.lit(0), F.count_distinct(F.when(is_(d), F.col("signal"))) - 1) * 5.0)
    has = lambda d: F.count_if(is_(d)) > 0
    g = live.groupBy(key).agg(
        top("life").alias("l"), many("life").alias("lm"), top("velocity").alias("v"), many("velocity").alias("vm"), top("vulnerable").alias("u"), many("vulnerable").alias("um"),
        top("distress").alias("d"), top("temporal").alias("t"), has("history").alias("past"), has("contained").alias("contained"), has("negation").alias("neg"),
        has("hedge").alias("hedge"), has("novulnerable").alias("nov"),
    )
    j = df.select(key, text, count).join(g, key, "left").fillna(0.0).fillna(False)
    n = F.col(count)
    steps = F.when(n >= 20, 50.0).when(n >= 10, 45.0).when(n >= 5, 35.0).when(n >= 2, 25.0).when(n == 1, 15.0).otherwise(0.0)
    cap = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    life = F.when(F.col("l") > 0, F.col("l") + steps + F.col("lm") + F.col("d")).otherwise(F.col("d"))
    speed = F.col("v") + F.col("vm") + F.when((F.col("v") > 0) & ~F.col("past") & ~F.col("contained"), F.col("t")).otherwise(0.0)
    speed = F.when(F.col("contained"), F.least(F.lit(15.0), speed * 0.15)).when(F.col("past"), F.least(F.lit(10.0), speed * 0.10)).otherwise(speed)
    frail = F.when(F.col("nov"), 0.0).otherwise(F.col("u") + F.col("um"))
    out = j.withColumns({"life_safety": F.round(cap(life), 2), "velocity": F.round(cap(speed), 2), "vulnerability": F.round(cap(frail), 2)})
    out = out.withColumn("urgency_score", F.round(cap(0.5 * F.col("life_safety") + 0.3 * F.col("velocity") + 0.2 * F.col("vulnerability")), 2))
    return out.withColumn("urgency", S.priority_level(F.col("urgency_score")))


def urgency_confidence(scored: DataFrame, text: str = "text", count: str = "people_count") -> Column:
    strong = sum(((F.col(c) >= 50).cast("int") for c in ("life_safety", "velocity", "vulnerability")), F.lit(0))
    plus = lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), w).otherwise(0.0)
    short = (F.size(F.split(F.trim(text), r"\s+")) <= 3) | (F.length(text) < 20)
    still = (F.col("contained") | F.col("past"))
    conf = (
        0.70 + plus(F.col(count) > 0, 0.10) + plus(strong >= 2, 0.08) + plus(F.col("d") > 0, 0.05) + plus((F.col("neg") & (F.col("l") == 0)) | still, 0.10)
        - plus(F.col("hedge"), 0.20) - plus(short, 0.15) - plus(still & (F.col("v") > 0), 0.10)
    )
    return F.round(F.greatest(F.lit(0.10), F.least(F.lit(0.98), conf)), 2)


def resolve_status(overall: Column, failed: Column, conflict: Column, fatal: Column, cfg: Config = DEFAULT) -> Column:
    """FAILED, then conflict or low confidence to review, then PARTIAL, then SUCCESS."""
    return (
        F.when(fatal, "FAILED").when(conflict, "NEEDS_REVIEW").when(overall < cfg.review_confidence, "NEEDS_REVIEW")
        .when(overall.isNotNull(), F.when(failed, "PARTIAL").otherwise("SUCCESS")).when(failed, "PARTIAL").otherwise("NEEDS_REVIEW")
    )


# -- vectors and the whole -----------------------------------------------------------------------------------------


def hashed_vectors(texts: list[str | None], dim: int = 64) -> list[list[float] | None]:
    """Unit vectors of hashed word and letter-trigram counts; null for a text without words."""
    import zlib

    out: list[list[float] | None] = []
    for t in texts:
        words = re.findall(r"\w+", (t or "").lower())
        if not words:
            out.append(None)
            continue
        v = np.zeros(dim)
        for w in words:
            for g in [w, *(w[i : i + 3] for i in range(len(w) - 2))]:
                h = zlib.crc32(g.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
        norm = float(np.sqrt((v * v).sum()))
        out.append((v / norm).tolist() if norm else None)
    return out


def embed(df: DataFrame, model: Callable[[list[str | None]], list] = hashed_vectors, key: str = "report_id", text: str = "text") -> DataFrame:
    """One vector a text by a pluggable batch model; a text that it fails on has none, the others of its batch have theirs."""
    arrow_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v for v, _ in isolated(model, list(texts))], dtype=object)

    return df.select(key, vectors(text).alias("embedding"))


def enrich(df: DataFrame, lexicon: DataFrame, risk: DataFrame, responses: DataFrame, urgency: DataFrame, key: str = "report_id", text: str = "text", cfg: Config = DEFAULT,
           scores: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Enrichment of clean texts: type, people, signals, place, responses, urgency, overall confidence and status.

    ``scores(key, class, score)`` default to the keywords'; with ``entities`` the place may fall back on one. Ids are unique and not null.
    """
    kind = classify(df, keyword_scores(df, lexicon, key, text) if scores is None else scores, key, cfg)
    people = materialize(people_at_risk(df, key, text), "people")  # read twice, counted once
    base = df.join(people, key)
    scored = score_urgency(base, urgency, key, text)
    scored = scored.withColumn("urgency_confidence", urgency_confidence(scored, text)).select(key, "urgency", "urgency_score", "urgency_confidence")
    out = (
        base.join(kind, key).join(scored, key).join(extract_location(df, entities, key, text), key)
        .join(risk_signals(df, risk, key, text), key, "left").join(required_responses(df, responses, key, text), key, "left")
    )
    overall = harmonic_confidence([F.col("confidence"), F.col("urgency_confidence"), F.col("place_confidence"), F.col("people_confidence")], cfg)
    out = out.withColumn("overall_confidence", overall)
    status = resolve_status(F.col("overall_confidence"), F.lit(False), F.lit(False), F.col(text).isNull() | (F.trim(text) == ""), cfg)
    return out.withColumn("processing_status", status)


def prototype_vectors(texts: DataFrame, model: Callable[[list[str | None]], list] = hashed_vectors) -> DataFrame:
    """``(class, proto)`` of ``texts(class, text)`` by the model that also embeds the reports; null vectors are left out."""
    return embed(texts, model, "class").where("embedding is not null").withColumnRenamed("embedding", "proto")


def enrich_full(df: DataFrame, lexicon: DataFrame, risk: DataFrame, responses: DataFrame, urgency: DataFrame, gazetteer: DataFrame, protos: DataFrame,
                model: Callable[[list[str | None]], list] = hashed_vectors, lightweight: bool = False, dim: int = 64,
                key: str = "report_id", text: str = "text", cfg: Config = DEFAULT) -> DataFrame:
    """The whole enrichment of raw reports, one row each: clean, vector, type, entities, place, people, responses, urgency, status.

    ``protos(class, proto)`` come from :func:`prototype_vectors` with the same model. ``lightweight`` needs no vectors: keywords
    alone give the type. A step that fails leaves nulls and a warning: without a vector the keywords decide and the status is
    PARTIAL at best; a text that can't be cleaned is FAILED. A second hazard asks for review. Ids are unique and not null; other columns are not read.
    """
    cleaned = clean_reports(df.select(key, F.col(text).alias("text")))
    base = materialize(cleaned.select(key, F.col("clean").alias("text"), "modified", "truncated", "clean_error"), "enrich-clean")
    scores = keyword_scores(base, lexicon, key)
    if lightweight:
        vectors = base.select(key, F.lit(None).cast("array<float>").alias("embedding"))
    else:
        vectors = materialize(embed(base, model, key), "enrich-vectors")
        seen = vectors.where("embedding is not null")
        both = hybrid_scores(scores.join(seen.select(key), key, "left_semi"), semantic_scores(seen, protos, key, dim), key)
        scores = both.unionByName(scores.join(seen.select(key), key, "left_anti"))
    found = materialize(extract_entities(base, gazetteer, key), "enrich-entities")
    out = enrich(base.select(key, "text"), lexicon, risk, responses, urgency, key, "text", cfg, scores, found)
    out = out.join(base.drop("text"), key).join(vectors, key).join(found, key)
    lost = F.lit(not lightweight) & F.col("embedding").isNull() & F.col("text").isNotNull()
    named = F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type")))
    place = F.struct(F.col("place").alias("text"), F.lit("PLACE").alias("type"))
    known = F.exists("entities", lambda e: e["text"] == F.col("place"))
    warnings = F.array(
        F.col("clean_error"), F.when(F.col("truncated"), "TRUNCATED"), F.col("people_warning"), F.when(F.col("secondary_hazard").isNotNull(), "SECONDARY_HAZARD"),
        F.when(lost, "EMBEDDING_UNAVAILABLE"),
    )
    status = resolve_status(F.col("overall_confidence"), lost, F.col("secondary_hazard").isNotNull(), F.col("text").isNull(), cfg)
    return out.withColumns({
        "entities": F.when(F.col("place").isNotNull() & ~known, F.concat(named, F.array(place))).otherwise(named),
        "warnings": F.array_distinct(F.array_compact(warnings)), "processing_status": status,
    })
