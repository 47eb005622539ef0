"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain. The
index holds, for the trigrams that some query needs, the texts that have them. Intersecting the postings gives the
candidates, which alone are fetched and matched. A rule without mandatory trigrams (a bare character class) scans
every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.runtime import materialize

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

MAX_STRINGS = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; a match whose ``group`` is shorter than ``least`` drops."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def tight(self) -> str:
        """The pattern as matched. A bare run (a class, or a literal and a class) keeps its maximal run whole, so its
        length may be asked for in the pattern itself; other rules must consume short matches first."""
        if self.group == 0 and self.least:
            body = re.fullmatch(r"(\w*)(\[[^\]]+\])\+", self.pattern)
            if body:
                return f"{body[1]}{body[2]}{{{self.least - len(body[1])},}}"
        return self.pattern


# The base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9_.=-]{20,}"),
)
RULES = BASE_RULES + EXTRA_RULES


def _strings(item) -> set[str] | None:
    """The finite set of strings one parsed item stands for, or None."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg)}
    if op is sre.IN:
        out = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value))
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        sides = [_sequence(x) for x in arg[1]]
        return None if any(s is None for s in sides) else set().union(*sides)
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        inner = _sequence(arg[2])
        if inner is not None:
            return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n)}
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        s = _strings(item)
        if s is None or len(out) * len(s) > MAX_STRINGS * 64:
            return None
        out = {(a + b).lower() for a in out for b in s}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND over OR over sets of trigrams (lower-cased A-Z): all of some set of each OR must occur. Empty: no query."""
    query, run = [], {""}

    def close() -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in sets:
            query.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))

    for item in sre_parse.parse(pattern):
        s = _strings(item)
        joined = None if s is None else {(a + b).lower() for a in run for b in s}
        if joined is None or len(joined) > MAX_STRINGS:
            close()
            run = {""} if joined is None else {x.lower() for x in s}
        else:
            run = joined
    close()
    return query


def fold(text: Column) -> Column:
    """Lower case for the index. Other letters may fold too: that can add candidates, which are verified, but lose none."""
    return F.lower(text)


def text_key(text: Column) -> Column:
    """128 bits of the text: equal texts share their postings."""
    return F.unhex(F.md5(text.cast("binary")))


def build_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """``texts(key, text)`` -> postings ``(trigram, key)``, one for each of ``trigrams`` that a text has."""
    # bound as a lambda's argument, the folded text is made once and not once a trigram
    have = F.transform(
        F.array(fold(F.col("text"))), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in trigrams]))
    )
    return (
        texts.select("key", have[0].alias("grams"))
        .where(F.size("grams") > 0)
        .select("key", F.explode("grams").alias("trigram"))
        .distinct()
    )


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]]) -> DataFrame:
    """Intersect postings: ``(key, kinds)`` with the rules whose whole Boolean query holds for the text."""
    grams = F.collect_set("trigram").alias("g")  # at most the number of trigrams in all queries
    held = index.groupBy("key").agg(grams)

    def holds(query: list[list[frozenset[str]]]) -> Column:
        every = F.lit(True)
        for choice in query:
            some = F.lit(False)
            for grams in choice:
                some = some | (F.size(F.array_intersect("g", F.array(*map(F.lit, sorted(grams))))) == len(grams))
            every = every & some
        return every

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return held.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of ``(start, kind_rank, end)`` in code points, end exclusive: matches, and lengths of what lies between."""
    pattern = F.lit(rule.tight)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, rule.tight, -1), F.length)
    keep = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("out"))
    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(h).alias("h"), g.alias("g")))
    real = F.filter(pairs, lambda p: p["h"].isNotNull())
    spans = F.aggregate(
        real,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + p["g"] + p["h"]).alias("at"),
            F.concat(
                acc["out"], F.array(F.struct((acc["at"] + p["g"]).alias("start"), p["h"].alias("size")))
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    zipped = F.zip_with(
        spans,
        keep,
        lambda s, k: F.struct(
            s["start"].alias("start"), F.lit(rule.kind).alias("kind"), (s["start"] + s["size"]).alias("end"), F.length(k).alias("n")
        ),
    )
    found = F.transform(
        F.filter(zipped, lambda z: z["n"] >= rule.least), lambda z: F.struct(z["start"], z["kind"], z["end"])
    )
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return F.when(F.rlike(text, pattern), found).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` for every row: array of ``(start, kind, end)`` by start, then by the rules' order.

    Null texts count as empty. Repeated rows give repeated results; equal texts share postings. Other columns of
    ``docs`` are not read. Spans of one kind never overlap; spans of different kinds may.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("key", text_key(F.col("text")))
    trigrams = sorted({g for q in indexed.values() for choice in q for grams in choice for g in grams})
    index = build_index(rows.select("key", "text"), trigrams)
    found = materialize(candidates(index, indexed), "candidates")
    full = [rule_spans(F.col("text"), r) for r in rules if r.kind not in indexed]
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    scanned = rows.select("id", "key", (F.concat(*full) if full else empty).alias("bare"))
    # only candidates' texts move; each distinct text is verified once
    fetched = rows.select("key", "text").join(found, "key").dropDuplicates(["key"])
    checked = fetched.select(
        "key",
        F.concat(
            *[
                F.when(F.array_contains("kinds", r.kind), rule_spans(F.col("text"), r)).otherwise(empty)
                for r in rules
                if r.kind in indexed
            ]
        ).alias("verified"),
    ).where(F.size("verified") > 0)
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    both = F.concat("bare", F.coalesce("verified", empty))
    keyed = F.transform(both, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("r"), s["kind"].alias("kind"), s["end"].alias("end")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return scanned.join(checked, "key", "left").select("id", ordered.alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(r.kind) for r in BASE_RULES],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """DuckDB: the same spans, every rule on every text."""
    cases = []
    for i, r in enumerate(RULES):
        pattern = r.tight.replace("'", "''")
        cases.append(
            f"""SELECT doc_id, rid, {i} AS r, '{r.kind}' AS kind,
      unnest(h) AS h, unnest(g[1:len(h)]) AS g, unnest(k) AS n, generate_subscripts(h, 1) AS pos FROM (
      SELECT doc_id, rid, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS h,
        list_transform(regexp_extract_all(t, '{pattern}', {r.group}), lambda x: length(x)) AS k,
        list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS g
      FROM d WHERE regexp_matches(t, '{pattern}'))"""
        )
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)
    kinds = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    sums = ", ".join(f"sum((kind = '{r.kind}')::BIGINT)::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
m AS ({' UNION ALL '.join(cases)}),
s AS (SELECT doc_id, rid, r, kind, n, (sum(g + h) OVER (PARTITION BY rid, r ORDER BY pos) - h)::BIGINT AS a,
  (sum(g + h) OVER (PARTITION BY rid, r ORDER BY pos))::BIGINT AS b FROM m),
f AS (SELECT * FROM s WHERE n >= CASE kind {least} END),
o AS (SELECT rid, {sums},
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r) AS spans,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r) FILTER (WHERE kind IN ({kinds})), '') AS base
  FROM f GROUP BY rid)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (rid)"""


OP2_SQL = _oracle()
