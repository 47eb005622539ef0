"""Lexicon hits with their places, in one pass over a text and without a shuffle: for batches and streams alike.

All lexicons are one automaton over words: a tree by first, second, ... word, with terms of any length. A hit knows its
words, characters and clause, and whether a negation of its label stands in the same clause or a doubt within reach.
What follows from the hits of a row (scores, signals, responses, urgency) are column expressions over that array.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.config import DEFAULT, RESPONSES, Config
from muster.functions import scalars as S
from muster.operators.hooks import isolated
from muster.runtime import arrow_batches, broadcast_if_small

WORDS = regex.compile(r"[\p{L}\p{N}']+")
CLAUSE = regex.compile(r"[.;!?\n]")
TURNS = frozenset(("but", "however", "although", "though", "while"))  # words that open a clause
REACH = 35  # characters between a hit and a doubt about it
MOST_TERMS = 200_000  # entries of an automaton that is sent to the tasks
HITS = "array<struct<src:string,label:string,tier:string,base:double,term:string,first:int,last:int,start:int,end:int,clause:int,negated:boolean,doubtful:boolean>>"

Entry = tuple[str, str, str, float, str]  # src, label, tier, base, term


class Automaton:
    """Terms of any number of words, found at every place where they stand."""

    def __init__(self, entries: list[Entry]):
        self.root: dict = {}
        for e in entries:
            node = self.root
            for w in WORDS.findall(e[4].lower()):
                node = node.setdefault(w, {})
            if node is not self.root:
                node.setdefault(None, []).append(e)

    def find(self, words: list[str]) -> Iterator[tuple[int, int, Entry]]:
        """``(first word, word after the last, entry)``."""
        root, n = self.root, len(words)
        for i, w in enumerate(words):
            node, j = root.get(w), i + 1
            while node is not None:
                for e in node.get(None, ()):
                    yield i, j, e
                if j == n:
                    break
                node, j = node.get(words[j]), j + 1


def clauses(text: str, spans: list[tuple[int, int]], words: list[str]) -> list[int]:
    """The number of each word's clause."""
    out, k, end = [], 0, 0
    for (a, b), w in zip(spans, words):
        if out and (CLAUSE.search(text, end, a) or w in TURNS):
            k += 1
        out.append(k)
        end = b
    return out


def hits_of(text: str, automaton: Automaton) -> list[dict]:
    """All hits of one text in order, but those inside a negative term of their own label."""
    low = text.lower()
    if len(low) != len(text):  # a letter that grows in lower case would shift the places
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    spans = [m.span() for m in WORDS.finditer(low)]
    words = [low[a:b] for a, b in spans]
    found = list(automaton.find(words))
    if not found:
        return []
    clause = clauses(text, spans, words)
    negative = [(i, j, e[:2]) for i, j, e in found if e[2] == "negative"]
    denied = {(e[0], e[1], clause[i]) for i, j, e in found if e[2] == "negation"}
    doubts = [(spans[i][0], spans[j - 1][1], clause[i]) for i, j, e in found if e[2] == "doubt"]
    out = []
    for i, j, (src, label, tier, base, term) in found:
        if tier not in ("negative", "negation", "doubt") and any(own == (src, label) and max(a, i) < min(b, j) for a, b, own in negative):
            continue
        start, end, c = spans[i][0], spans[j - 1][1], clause[i]
        doubt = any(k == c and max(start - b, a - end) <= REACH for a, b, k in doubts)
        out.append({"src": src, "label": label, "tier": tier, "base": base, "term": term, "first": i, "last": j - 1, "start": start, "end": end, "clause": c, "negated": (src, label, c) in denied, "doubtful": doubt})
    return out


def entries(keywords: DataFrame | None = None, risk: DataFrame | None = None, responses: DataFrame | None = None, urgency: DataFrame | None = None) -> list[Entry]:
    """The lexicons' rows as one list; at most ``MOST_TERMS``, else an error: :func:`positional_hits` joins larger ones."""
    out: list[Entry] = []
    for src, table, columns in (("keyword", keywords, ("class", "tier")), ("risk", risk, ("signal", None)), ("response", responses, ("class", "tier")), ("urgency", urgency, ("signal", "dim"))):
        if table is not None:
            label, tier = columns
            base = F.col("base") if "base" in table.columns else F.lit(0.0)
            rows = table.select(F.lit(src), F.col(label), F.col(tier) if tier else F.lit("strong"), base.cast("double"), "term")
            out += [tuple(r) for r in rows.limit(MOST_TERMS + 1).collect()]
    if len(out) > MOST_TERMS:
        raise ValueError(f"an automaton takes at most {MOST_TERMS} terms; positional_hits joins more")
    # the doubts of the responses are everyone's; urgency's negations are a dimension of their own
    return sorted(out)


def hits_column(text: Column, found: list[Entry], spark) -> Column:
    """The array of hits of each text; empty for null, empty and other texts without a term."""
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(found)

    @F.pandas_udf(HITS)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(shared.value)
        for texts in batches:
            yield pd.Series([hits_of(t or "", automaton) for t in texts], dtype=object)

    return scanned(F.coalesce(text, F.lit("")))


def _of(hits: Column, src: str, *tiers: str) -> Column:
    return F.filter(hits, lambda h: (h["src"] == src) & (h["tier"].isin(*tiers) if tiers else F.lit(True)))


def _labelled(hits: Column, src: str, label: str) -> Column:
    return F.filter(hits, lambda h: (h["src"] == src) & (h["label"] == label))


def with_hits(df: DataFrame, found: list[Entry], text: str = "text", name: str = "__h") -> DataFrame:
    """``df`` with the array of hits as a column of its own, for the functions below."""
    return df.withColumn(name, hits_column(F.col(text), found, df.sparkSession))


def keyword_map(hits: Column) -> Column:
    """Class -> keyword score, as ``text.keyword_scores``: a term counts once."""
    own = F.array_distinct(F.transform(_of(hits, "keyword"), lambda h: F.struct(h["label"].alias("label"), h["tier"].alias("tier"), h["term"].alias("term"))))
    classes = F.array_distinct(F.transform(own, lambda h: h["label"]))
    weight = lambda h: F.when(h["tier"] == "phrase", 2.0).otherwise(1.0)
    total = lambda k: F.aggregate(F.filter(own, lambda h: h["label"] == k), F.lit(0.0), lambda s, h: s + weight(h))
    return F.map_from_arrays(classes, F.transform(classes, lambda k: F.round(F.least(F.lit(1.0), total(k) / 2.5), 4)))


def signals_of(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_of(hits, "risk"), lambda h: h["label"])))


def responses_of(hits: Column) -> Column:
    """Responses of one row in canonical order, as ``(type, confidence)``; null if there are none.

    A category that is denied anywhere needs a strong hit in a clause that doesn't deny it. A doubt counts for the hits
    within its reach, and lowers the confidence if one of those that count is doubtful.
    """
    out = []
    for c in RESPONSES:
        mine = _labelled(hits, "response", c)
        strong = F.filter(mine, lambda h: h["tier"] == "strong")
        inside = lambda h, s: (s["first"] <= h["first"]) & (h["last"] <= s["last"])
        extra = F.filter(mine, lambda h: (h["tier"] == "supporting") & ~F.exists(strong, lambda s: inside(h, s)))
        denied = F.exists(mine, lambda h: h["tier"] == "negation")
        alone = F.exists(strong, lambda h: ~h["negated"])
        doubt = F.when(F.size(strong) > 0, F.exists(strong, lambda h: h["doubtful"])).otherwise(F.exists(extra, lambda h: h["doubtful"]))
        high = F.when(F.size(strong) >= 2, 0.94).otherwise(0.92)
        conf = F.when(F.size(strong) > 0, F.when(doubt, F.greatest(F.lit(0.55), high - 0.22)).otherwise(high)).otherwise(
            F.when(doubt, F.greatest(F.lit(0.50), F.lit(0.72) - 0.18)).otherwise(0.72)
        )
        there = ((F.size(strong) > 0) | (F.size(extra) > 0)) & (~denied | alone)
        out.append(F.when(there, F.struct(F.lit(c).alias("type"), F.round(conf, 2).alias("confidence"))))
    found = F.array_compact(F.array(*out))
    return F.when(F.size(found) > 0, found)


def urgency_of(hits: Column, count: Column) -> Column:
    """``(life_safety, velocity, vulnerability, urgency_score, urgency)`` of one row.

    A signal counts if one of its hits stands in a clause that doesn't deny it. History, containment and denied
    vulnerability hold for the whole report.
    """
    own = _of(hits, "urgency")
    has = lambda d: F.exists(own, lambda h: h["tier"] == d)

    def live(dim: str) -> Column:
        return F.filter(own, lambda h: (h["tier"] == dim) & ~h["negated"])

    top = lambda d: F.coalesce(F.array_max(F.transform(live(d), lambda h: h["base"])), F.lit(0.0))
    many = lambda d: F.least(F.lit(15.0), F.greatest(F.lit(0), F.size(F.array_distinct(F.transform(live(d), lambda h: h["label"]))) - 1) * 5.0)
    n = F.coalesce(count, F.lit(0))
    steps = F.when(n >= 20, 50.0).when(n >= 10, 45.0).when(n >= 5, 35.0).when(n >= 2, 25.0).when(n == 1, 15.0).otherwise(0.0)
    cap = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 2)
    life = cap(F.when(top("life") > 0, top("life") + steps + many("life") + top("distress")).otherwise(top("distress")))
    speed = top("velocity") + many("velocity") + F.when((top("velocity") > 0) & ~has("history") & ~has("contained"), top("temporal")).otherwise(0.0)
    speed = cap(F.when(has("contained"), F.least(F.lit(15.0), speed * 0.15)).when(has("history"), F.least(F.lit(10.0), speed * 0.10)).otherwise(speed))
    frail = cap(F.when(has("novulnerable"), 0.0).otherwise(top("vulnerable") + many("vulnerable")))
    score = cap(0.5 * life + 0.3 * speed + 0.2 * frail)
    return F.struct(life.alias("life_safety"), speed.alias("velocity"), frail.alias("vulnerability"), score.alias("urgency_score"), S.priority_level(score).alias("urgency"))


def enrich_rows(df: DataFrame, found: list[Entry], text: str = "text", cfg: Config = DEFAULT) -> DataFrame:
    """``df`` with type, signals, responses, people, urgency and place of each row: no shuffle, so it runs on a stream in append
    mode, and gives a batch the same rows.
    """
    from muster.operators.text import classify_map, count_people, place_of

    arrow_batches(df.sparkSession)

    @F.pandas_udf("people_count int, people_confidence double, people_warning string")
    def counted(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([count_people(t or "") for t in texts], columns=["people_count", "people_confidence", "people_warning"])
        return out.astype({"people_count": "Int32"})

    base = with_hits(df, found, text).withColumn("__p", counted(F.coalesce(text, F.lit(""))))
    base = base.withColumn("__c", classify_map(keyword_map(F.col("__h")), cfg)).withColumn("__u", urgency_of(F.col("__h"), F.col("__p.people_count")))
    return base.withColumn("signals", signals_of(F.col("__h"))).withColumn("responses", responses_of(F.col("__h"))).withColumn("__l", place_of(F.col(text))).select(
        *[F.col(f"`{c}`") for c in df.columns], "__c.*", "signals", "responses", "__p.*", "__u.*",
        F.col("__l.text").alias("place"), F.coalesce("__l.precision", F.lit("UNKNOWN")).alias("place_precision"),
    )


# -- spans ---------------------------------------------------------------------------------------------------------


def known_runs(text: str, terms: dict[str, list[str]], sizes: dict[str, list[int]]) -> list[tuple[int, int, str]]:
    """Spans of runs of words that are terms, in order; ``sizes`` has the lengths of the terms that begin with a word."""
    low = text.lower()
    spans = [m.span() for m in WORDS.finditer(low)]
    words = [low[a:b] for a, b in spans]
    out = []
    for i, w in enumerate(words):
        for n in sizes.get(w, ()):
            if i + n <= len(words):
                out += [(spans[i][0], spans[i + n - 1][1], kind) for kind in terms.get(" ".join(words[i : i + n]), ())]
    return sorted(out)


def small_gazetteer(gazetteer: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[int]]] | None:
    """The terms with their types and the lengths by first word for :func:`known_runs`; None beyond ``MOST_TERMS``."""
    rows = gazetteer.where("term is not null").select("term", "entity_type").distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        return None
    terms: dict[str, list[str]] = {}
    sizes: dict[str, set[int]] = {}
    for term, kind in rows:
        words = term.split(" ")
        terms.setdefault(term, []).append(kind)
        sizes.setdefault(words[0], set()).add(len(words))
    return terms, {w: sorted(n) for w, n in sizes.items()}


def positional_hits(df: DataFrame, gazetteer: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """``(key, spans)`` of ``gazetteer(term, entity_type)`` of any size: runs of words meet the terms in a join.

    Only runs as long as some term are cut. The gazetteer is broadcast if its count allows, else both sides shuffle.
    Terms are in lower case with single spaces.
    """
    arrow_batches(df.sparkSession)
    size = F.size(F.split("term", " "))
    sizes = sorted(r[0] for r in gazetteer.select(size.alias("n")).distinct().collect())

    @F.pandas_udf("array<struct<term:string,start:int,end:int>>")
    def runs(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            low = (t or "").lower()
            spans = [m.span() for m in WORDS.finditer(low)]
            words = [low[a:b] for a, b in spans]
            out.append([{"term": " ".join(words[i : i + n]), "start": spans[i][0], "end": spans[i + n - 1][1]} for n in sizes for i in range(len(words) - n + 1)])
        return pd.Series(out, dtype=object)

    cut = df.select(key, F.explode(runs(text)).alias("r")).select(key, "r.*")
    known = broadcast_if_small(gazetteer.select("term", "entity_type").distinct(), MOST_TERMS)
    met = cut.join(known, "term")
    one = F.struct("start", "end", F.col("entity_type").alias("type"))
    return met.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("spans"))


def apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that don't overlap, the longest first, then the first: each is checked against its two neighbours only."""
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda x: (x[0] - x[1], x[0], x[2])):
        i = bisect_left(kept, (a, b, kind))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
            insort(kept, (a, b, kind))
    return kept


def entity_spans(df: DataFrame, gazetteer: DataFrame, rules: Callable[[str], list[tuple[int, int, str]]], ner: Callable[[list[str]], list] | None = None,
                 key: str = "report_id", text: str = "text") -> DataFrame:
    """``(key, entities, entity_error)``: gazetteer terms of any number and length, ``rules`` and an optional span model.

    ``ner`` gives for each text of a batch its spans ``(start, end, type)``. A text that it fails on keeps the other spans
    and has the error's name. Spans out of the text are left out. Ids are unique and not null.
    A gazetteer of up to ``MOST_TERMS`` goes to the tasks, so a text is read once and nothing is shuffled; a larger one meets
    the runs of words in a join.
    """
    arrow_batches(df.sparkSession)
    small = small_gazetteer(gazetteer)
    shared = df.sparkSession.sparkContext.broadcast(small) if small is not None else None

    def spans_of(batch: list[str], joined: pd.Series | None) -> list[list[tuple[int, int, str]]]:
        if joined is None:
            return [known_runs(t, *shared.value) for t in batch]
        return [[] if known is None else [(s["start"], s["end"], s["type"]) for s in known] for known in joined]

    def rows_of(texts: pd.Series, joined: pd.Series | None) -> pd.DataFrame:
        batch = [t or "" for t in texts]
        seen = isolated(ner, batch) if ner else [([], None)] * len(batch)
        rows = []
        for t, own, (more, error) in zip(batch, spans_of(batch, joined), seen):
            own += [(int(a), int(b), str(k)) for a, b, k in more or () if 0 <= a < b <= len(t)]
            rows.append(([{"text": t[a:b], "type": k, "start": a, "end": b} for a, b, k in apart(own + rules(t))], error))
        return pd.DataFrame({"entities": pd.Series([r[0] for r in rows], dtype=object), "entity_error": pd.Series([r[1] for r in rows], dtype=object)})

    kind = "entities array<struct<text:string,type:string,start:int,end:int>>, entity_error string"
    if shared is not None:
        alone = F.pandas_udf(lambda texts: rows_of(texts, None), kind, F.PandasUDFType.SCALAR)
        return df.select(key, alone(text).alias("e")).select(key, "e.*")
    merged = F.pandas_udf(lambda texts, spans: rows_of(texts, spans), kind, F.PandasUDFType.SCALAR)
    found = positional_hits(df.select(key, text), gazetteer, key, text)
    return df.select(key, text).join(found, key, "left").select(key, merged(text, "spans").alias("e")).select(key, "e.*")
