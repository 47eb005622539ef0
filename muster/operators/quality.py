"""Validation to valid and quarantined rows, filters, and timestamps."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.config import INCIDENT_TYPES, RELATIONS, SOURCES, STATUSES, URGENCIES


def assign_report_id(df: DataFrame) -> DataFrame:
    made = F.concat(F.lit("rep-"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12))
    return df.withColumn("report_id", F.coalesce(F.nullif(F.trim("report_id"), F.lit("")), made))


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose condition holds; an unknown condition does not count."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def report_reasons() -> Column:
    c = F.col
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return reasons(
        ("TEXT_TOO_SHORT", size < 3), ("TEXT_TOO_LONG", F.length("text") > 4000),
        ("BAD_SOURCE", c("source").isNull() | ~c("source").isin(*SOURCES)),
        ("BAD_LATITUDE", ~c("latitude").between(-90, 90)), ("BAD_LONGITUDE", ~c("longitude").between(-180, 180)),
        ("SIMULATOR_NOT_SYNTHETIC", (c("source") == "simulator") & ~c("is_synthetic")), ("MANUAL_SYNTHETIC", (c("source") == "manual") & c("is_synthetic")),
    )


def validate_reports(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with reasons); one pass each, nothing is dropped."""
    marked = df.withColumn("reasons", report_reasons())
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def hint_reasons(lat: Column, lon: Column, precision: Column) -> Column:
    return reasons(
        ("PAIR_INCOMPLETE", lat.isNull() != lon.isNull()),
        ("UNKNOWN_WITH_COORDINATES", (precision == "UNKNOWN") & (lat.isNotNull() | lon.isNotNull())),
        ("EXACT_WITHOUT_COORDINATES", (precision == "EXACT") & (lat.isNull() | lon.isNull())),
    )


def check_constraints(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row for each violated rule."""
    return df.select(F.col(key).alias("row_id"), F.explode(reasons(*rules)).alias("rule"))


def incident_rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("status_known", ~c("status").isin(*STATUSES)), ("urgency_known", ~c("urgency").isin(*URGENCIES)), ("type_known", ~c("incident_type").isin(*INCIDENT_TYPES)),
        ("people_not_negative", c("people_at_risk_count") < 0), ("sources_positive", c("independent_source_count") < 1), ("coordinates_paired", c("latitude").isNull() != c("longitude").isNull()),
    ]


def link_rules() -> list[tuple[str, Column]]:
    return [("relation_known", ~F.col("relationship_type").isin(*RELATIONS)), ("similarity_in_range", ~F.col("similarity_score").between(0, 1))]


def prediction_reasons() -> Column:
    out = []
    for c in ("type_confidence", "urgency_confidence", "location_confidence"):
        out.append((f"{c}_not_finite", F.isnan(c) | (F.abs(F.col(c)) == float("inf"))))
        out.append((f"{c}_out_of_range", ~F.col(c).between(0, 1) & ~F.isnan(c)))
    out.append(("status_unknown", ~F.col("processing_status").isin("SUCCESS", "PARTIAL", "FAILED", "NEEDS_REVIEW")))
    return reasons(*out)


def normalise_predictions(df: DataFrame, col: str = "payload") -> DataFrame:
    """Nested or flat prediction JSON -> one flat row with upper-case labels, defaults and the at-risk flag."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(col, p) for p in paths])
    count = get("$.people_at_risk.count", "$.people_count").try_cast("int")
    return df.select(
        "report_id",
        F.upper(F.coalesce(get("$.incident_type.label", "$.type"), F.lit("OTHER_GENERAL_INCIDENT"))).alias("incident_type"),
        F.upper(F.coalesce(get("$.urgency.label", "$.level"), F.lit("LOW"))).alias("urgency"),
        F.coalesce(get("$.urgency.confidence", "$.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        count.alias("people_count"), F.coalesce(count > 0, F.lit(False)).alias("at_risk"),
        F.get_json_object(col, "$").isNotNull().alias("valid"),
    )


# Names that must not reach a model with a report.
FORBIDDEN_KEYS = ("groundtruth", "label", "incidentgroup", "relationtype", "answer", "scenariotruth")
FORBIDDEN_TOKENS = ("duplicate", "corroborating", "hardnegative", "groundtruth")


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def audit_leakage(df: DataFrame, key: str, metadata: str) -> DataFrame:
    """Leak rows: a forbidden or ``expected`` key, or a forbidden token in a value."""
    each = df.select(F.col(key).alias("row_id"), F.explode(F.map_entries(metadata)).alias("e"))
    name, value = _plain(F.col("e.key")), _plain(F.coalesce("e.value", F.lit("")))
    bad_key = name.isin(*FORBIDDEN_KEYS) | name.startswith("expected")
    bad_value = value.isin(*FORBIDDEN_TOKENS)
    marked = each.select("row_id", F.col("e.key").alias("name"), F.when(bad_key, "KEY").when(bad_value, "VALUE").alias("leak"))
    return marked.where("leak is not null")


def validate_feed(df: DataFrame, col: str = "raw") -> DataFrame:
    keys = F.json_object_keys(F.col(col))
    whole = F.coalesce(F.size(F.array_intersect(keys, F.array(*map(F.lit, ("event", "payload", "timestamp"))))) == 3, F.lit(False))
    return df.withColumn("verdict", F.when(keys.isNull(), "MALFORMED_NON_JSON").when(whole, "OK").otherwise("MALFORMED"))


def csv_set(text: str | None, known: tuple[str, ...]) -> list[str] | None:
    """A comma list as upper-case names; an unknown one is an error, nothing means no filter."""
    names = [x.strip().upper() for x in (text or "").split(",") if x.strip()]
    if bad := [x for x in names if x not in known]:
        raise ValueError(f"unknown values: {bad}")
    return names or None


def filter_incidents(df: DataFrame, status: str | None = None, level: str | None = None) -> DataFrame:
    for col, text, known in (("status", status, STATUSES), ("priority_level", level, URGENCIES)):
        if names := csv_set(text, known):
            df = df.where(F.col(col).isin(names))
    return df


def search(df: DataFrame, q: str, cols: tuple[str, ...]) -> DataFrame:
    hit, low = F.lit(False), q.strip().lower()
    for name in cols:
        if dict(df.dtypes)[name].startswith("array"):
            hit = hit | F.coalesce(F.exists(name, lambda x: F.contains(F.lower(x), F.lit(low))), F.lit(False))
        else:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(low)), F.lit(False))
    return df.where(hit) if low else df


def filter_feed(df: DataFrame, category: str) -> DataFrame:
    kinds = {"INCIDENTS": ("INCIDENT_CREATED", "INCIDENT_UPDATED"), "STATUS": ("STATUS_CHANGED",)}
    return df if category == "ALL" else df.where(F.col("event").isin(*kinds[category]))


def scope_run(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix))


def mapped_only(df: DataFrame) -> DataFrame:
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(good("latitude") & good("longitude"))


def overridden_only(df: DataFrame, flag: str = "overridden") -> DataFrame:
    return df.where(F.col(flag))


def normalise_ts(raw: Column) -> Column:
    """ISO text, ``Z``, offset, zoneless (taken as UTC) or a unix number -> struct of time, warning and formatted text."""
    text = F.trim(raw.cast("string"))
    number = F.rlike(text, F.lit(r"^\d{9,11}(\.\d+)?$"))
    zoned = F.rlike(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    ts = F.when(number, F.timestamp_seconds(text.try_cast("double"))).otherwise(F.try_to_timestamp(text))
    warning = F.when(ts.isNull(), "INVALID_TIMESTAMP").when(~number & ~zoned, "NAIVE_ASSUMED_UTC")
    return F.struct(ts.alias("ts"), warning.alias("warning"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


def rebase_ts(df: DataFrame, ts: str, origin: str) -> DataFrame:
    """Shift all times so that the first is ``origin``; gaps stay."""
    first = df.agg(F.min(ts).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn(ts, F.timestamp_micros(F.unix_micros(F.lit(origin).cast("timestamp")) + F.unix_micros(ts) - F.unix_micros("_first"))).drop("_first")


# Names of labels that a public report must not carry, as keys or as values.
TRUTH_KEYS = (
    "ground_truth", "incident_group", "relation_type", "expected_incident_type", "expected_urgency", "expected_people_at_risk", "expected_people_count", "expected_direction",
    "expected_needs_review", "expected_location_text", "expected_latitude", "expected_longitude", "expected_required_response", "expected_actionable", "notes",
    "true_urgency", "true_hazard", "true_group",
)


def plain_name(text: str) -> str:
    """Letters and digits of the compatibility form, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if c.isalnum())


_TRUTH = frozenset(map(plain_name, TRUTH_KEYS))
_PREFIX = re.compile(r"\s*expected[_:.=-]", re.I)


def truth_leaks(value: object, path: str = "") -> list[tuple[str, str]]:
    """``(path, KEY or VALUE)`` of every leak in a nested value. The key ``notes`` is one, the word is none."""
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            at = f"{path}.{k}" if path else str(k)
            name = plain_name(str(k))
            if name in _TRUTH or name.startswith("expected"):
                out.append((at, "KEY"))
            out += truth_leaks(v, at)
        return out
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in truth_leaks(v, f"{path}[{i}]")]
    if isinstance(value, str) and (plain_name(value) in _TRUTH - {"notes"} or _PREFIX.match(unicodedata.normalize("NFKD", value))):
        return [(path, "VALUE")]
    return []


def audit_nested(df: DataFrame, key: str, metadata: str) -> DataFrame:
    """``(row_id, name, leak)`` of JSON metadata of any depth; text that is no JSON is one value. Nulls leak nothing."""

    @F.pandas_udf("array<struct<name:string,leak:string>>")
    def walked(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                value = None if t is None else json.loads(t)
            except ValueError:
                value = t
            out.append([{"name": p, "leak": k} for p, k in truth_leaks(value)])
        return pd.Series(out, dtype=object)

    return df.select(F.col(key).alias("row_id"), F.explode(walked(metadata)).alias("x")).select("row_id", "x.*")
