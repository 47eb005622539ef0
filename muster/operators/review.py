"""Review actions, field overrides, location overlay, fallbacks and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.config import DEFAULT, INCIDENT_TYPES, PRECISIONS, RESPONSES, STATUSES, TRANSITIONS, URGENCIES, Config
from muster.functions import scalars as S
from muster.operators.aggregates import canonical_responses
from muster.operators.queue import scored


def overlay_location(pred: Column, hint: Column) -> Column:
    """A caller's full pair wins with its text and precision; otherwise the hint only fills what is missing."""
    full = hint["latitude"].isNotNull() & hint["longitude"].isNotNull()
    text = F.when(full, F.coalesce(hint["raw_text"], pred["text"])).otherwise(F.coalesce(pred["text"], hint["raw_text"]))
    precision = F.when(full, F.coalesce(hint["precision"], F.lit("EXACT"))).otherwise(F.coalesce(pred["precision"], hint["precision"]))
    return F.struct(
        F.when(full, hint["latitude"]).otherwise(pred["latitude"]).alias("latitude"),
        F.when(full, hint["longitude"]).otherwise(pred["longitude"]).alias("longitude"),
        text.alias("text"), precision.alias("precision"),
    )


def fallback_prediction(reports: DataFrame) -> DataFrame:
    """A prediction row for a failed analysis: nothing but the caller's place."""
    place = F.struct(
        "latitude", "longitude", F.col("location_text").alias("text"),
        F.when(F.col("latitude").isNotNull(), "EXACT").when(F.col("location_text").isNotNull(), "APPROXIMATE").otherwise("UNKNOWN").alias("precision"),
    )
    return reports.select(
        "report_id", F.lit("FAILED").alias("processing_status"), F.array(F.lit("ANALYSIS_FAILED")).alias("warnings"),
        F.lit(None).cast("string").alias("incident_type"), F.lit(None).cast("string").alias("urgency"), place.alias("location"),
    )


def explain_priority(incidents: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Score, level, factors as an array of structs, and the sentence that names them."""
    s = scored(incidents, cfg)
    n = F.col("independent_source_count")
    count = F.col("people_at_risk_count")
    rows = (
        ("urgency", F.coalesce("urgency", F.lit("not known")), cfg.w_urgency, S.urgency_points(F.col("urgency"), cfg)),
        ("people", F.when(count > 0, count.cast("string")).otherwise("none named"), cfg.w_people, S.people_points(count)),
        ("sources", n.cast("string"), cfg.w_corroboration, S.corroboration_points(n, cfg)),
        ("hazard", F.coalesce("incident_type", F.lit("not known")), cfg.w_hazard, S.hazard_points(F.col("incident_type"), cfg)),
    )
    factors = F.array(*[
        F.struct(F.lit(name).alias("factor"), value.alias("value"), F.lit(w).alias("weight"), F.round(p * w, 2).alias("contribution")) for name, value, w, p in rows
    ])
    said = F.array_join(F.transform(F.col("factors"), lambda f: F.format_string("%s %s adds %.2f", f["factor"], f["value"], f["contribution"])), "; ")
    text = F.when(F.col("status") == "RESOLVED", "closed, so it ranks last with 0").otherwise(
        F.concat(F.col("priority_level"), F.lit(" at "), F.format_string("%.2f", "priority_score"), F.lit(": "), said)
    )
    return s.withColumn("factors", factors).withColumn("explanation", text).select("incident_id", "priority_score", "priority_level", "factors", "explanation")


def review_verdict(current: Column, target: Column, notes: Column) -> Column:
    """Null if the action is accepted, else why not."""
    allowed = F.lit(False)
    for state, to in TRANSITIONS.items():
        if to:
            allowed = allowed | ((current == state) & target.isin(*to))
    return (
        F.when(F.length(F.trim(F.coalesce(notes, F.lit("")))) < 5, "NOTES_TOO_SHORT")
        .when(current == target, "NO_CHANGE")
        .when(target.isin("NEW", "ANALYZING") | ~target.isin(*STATUSES), "TARGET_NOT_ALLOWED")
        .when(~allowed, "TRANSITION_NOT_ALLOWED")
    )


def review_once(state: DataFrame, actions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """At most one action an incident: verdict, new status and score, on one join."""
    j = state.join(actions, "incident_id")
    j = j.withColumn("rejected", review_verdict(F.col("status"), F.col("target"), F.col("notes")))
    status = F.when(F.col("rejected").isNull(), F.col("target")).otherwise(F.col("status"))
    out = scored(j.withColumn("status", status).withColumn("confidence", F.lit(None).cast("double")), cfg)
    closed = F.col("status").isin("RESOLVED", "FALSE_REPORT")
    return out.withColumn("priority_score", F.when(closed, 0.0).otherwise(F.col("priority_score"))).withColumn(
        "priority_level", F.when(closed, "LOW").otherwise(F.col("priority_level"))
    )


def apply_reviews(state: DataFrame, actions: DataFrame) -> DataFrame:
    """Several actions an incident, in order of (at, action_id): each sees the state the one before left.

    The actions of one incident are folded in order inside the JVM; they are made by people, so an array holds them.
    """
    step = F.struct("at", "action_id", "target", "notes")
    groups = actions.groupBy("incident_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    rows = groups.join(state.select("incident_id", "status"), "incident_id")
    done = "array<struct<action_id:string,previous_status:string,status:string,rejected:string>>"

    def follow(acc: Column, x: Column) -> Column:
        why = review_verdict(acc["now"], x["target"], x["notes"])
        now = F.when(why.isNull(), x["target"]).otherwise(acc["now"])
        row = F.struct(x["action_id"].alias("action_id"), acc["now"].alias("previous_status"), now.alias("status"), why.alias("rejected"))
        return F.struct(now.alias("now"), F.concat(acc["done"], F.array(row)).cast(done).alias("done"))

    start = F.struct(F.col("status").alias("now"), F.array().cast(done).alias("done"))
    walked = rows.select("incident_id", F.aggregate("steps", start, follow)["done"].alias("d"))
    return walked.select("incident_id", F.explode("d").alias("r")).select("incident_id", "r.*")


# The fields that an operator may override.
OVERRIDABLE = ("incident_type", "urgency", "people_at_risk_count", "location", "required_response", "priority_score")
CLEARABLE = ("incident_type", "people_at_risk_count")  # null is a value for them
LOCATION = "text string, latitude double, longitude double, precision string"


def override_value(field: Column, value: Column) -> Column:
    """The value as it is applied, as text or JSON; null if it is not valid, or is null itself."""
    upper, place, listed = F.upper(F.trim(value)), F.from_json(value, LOCATION), F.from_json(value, "array<string>")
    precision = F.upper(F.coalesce(place["precision"], F.lit("UNKNOWN")))
    known = precision.isin(*PRECISIONS) & F.coalesce(place["latitude"].between(-90, 90), F.lit(True)) & F.coalesce(place["longitude"].between(-180, 180), F.lit(True))
    object_ = F.startswith(F.trim(value), F.lit("{")) & F.try_parse_json(value).isNotNull()
    where = F.to_json(F.struct(place["text"].alias("text"), place["latitude"].alias("latitude"), place["longitude"].alias("longitude"), precision.alias("precision")))
    names = F.transform(listed, lambda r: F.upper(F.trim(r)))
    whole = F.startswith(F.trim(value), F.lit("[")) & F.forall(names, lambda r: F.coalesce(r.isin(*RESPONSES), F.lit(False)))
    count, score = F.expr("try_cast(new_value as int)"), F.expr("try_cast(new_value as double)")
    return (
        F.when((field == "urgency") & upper.isin(*URGENCIES), upper).when((field == "incident_type") & upper.isin(*INCIDENT_TYPES), upper)
        .when((field == "people_at_risk_count") & (count >= 0), count.cast("string")).when((field == "location") & object_ & known, where)
        .when((field == "required_response") & whole, F.to_json(canonical_responses(F.array_distinct(names))))
        .when((field == "priority_score") & score.between(0, 100), F.round(score, 2).cast("string"))
    )


LEDGER_ROWS = 500_000  # about so many overrides go to a task


def override_ledger(state: DataFrame, actions: DataFrame) -> DataFrame:
    """Every override ``actions(incident_id, field, new_value, reason, at, override_id)`` with what it did, in order of (at,
    override_id): ``previous_value`` as the accepted ones before left it, ``applied_value``, and ``rejected`` (null: accepted).

    A field's overrides depend on each other only, so they are a window by incident and field. Overrides of unknown
    incidents are rejected. A state without some field's columns has null there.
    """
    kinds = {
        "incident_type": "string", "urgency": "string", "people_at_risk_count": "int", "location_text": "string", "latitude": "double", "longitude": "double",
        "location_precision": "string", "required_response": "array<string>", "priority_score": "double",
    }
    has = [(F.col(c) if c in state.columns else F.lit(None)).cast(kind).alias(f"s_{c}") for c, kind in kinds.items()]
    # an action carries the one value that it overrides, not the whole state: sorts hold narrow rows, in as many tasks as the table needs
    tasks = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-actions.count() // LEDGER_ROWS))
    j = actions.repartition(tasks, "incident_id").join(state.select("incident_id", F.lit(True).alias("known"), *has), "incident_id", "left")
    s = lambda c: F.col(f"s_{c}")
    place = F.to_json(F.struct(s("location_text").alias("text"), s("latitude").alias("latitude"), s("longitude").alias("longitude"), s("location_precision").alias("precision")))
    here = lambda f: F.col("field") == f
    now = (
        F.when(here("location"), place).when(here("required_response"), F.to_json(s("required_response")))
        .when(here("people_at_risk_count"), s("people_at_risk_count").cast("string")).when(here("priority_score"), s("priority_score").cast("string"))
        .when(here("incident_type"), s("incident_type")).when(here("urgency"), s("urgency"))
    )
    j = j.select(*actions.columns, "known", F.when(F.col("known"), now).alias("now"))
    value = override_value(F.col("field"), F.col("new_value"))
    cleared = F.col("field").isin(*CLEARABLE) & F.col("new_value").isNull()
    rejected = (
        F.when(F.col("known").isNull(), "UNKNOWN_INCIDENT").when(F.length(F.trim(F.coalesce("reason", F.lit("")))) < 5, "REASON_TOO_SHORT")
        .when(~F.coalesce(F.col("field").isin(*OVERRIDABLE), F.lit(False)), "FIELD_NOT_ALLOWED").when(value.isNull() & ~cleared, "VALUE_NOT_VALID")
    )
    j = j.withColumn("rejected", rejected).withColumn("applied_value", F.when(F.col("rejected").isNull(), value))
    before = Window.partitionBy("incident_id", "field").orderBy("at", "override_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("rejected").isNull(), F.struct("applied_value")), ignorenulls=True).over(before)
    previous = F.when(last.isNotNull(), last["applied_value"]).otherwise(F.col("now"))
    return j.select("incident_id", "override_id", "field", previous.alias("previous_value"), "applied_value", "rejected", "reason", "at")


def apply_overrides(state: DataFrame, actions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The state after all accepted overrides: the last one of each field wins, the score is recomputed without a confidence, and a
    manual score stands as given. Location and responses change the columns that the state has for them."""
    good = override_ledger(state, actions).where("rejected is null")
    last = good.groupBy("incident_id").agg(*[
        F.max_by(F.struct("applied_value"), F.when(F.col("field") == f, F.struct("at", "override_id"))).alias(f"o_{f}") for f in OVERRIDABLE
    ])
    j = state.join(last, "incident_id", "left")
    new = {f: F.col(f"o_{f}.applied_value") for f in OVERRIDABLE}
    pick = lambda f, column, value: F.when(F.col(f"o_{f}").isNotNull(), value).otherwise(F.col(column))
    place = F.from_json(new["location"], LOCATION)
    changed = {
        "urgency": pick("urgency", "urgency", new["urgency"]), "incident_type": pick("incident_type", "incident_type", new["incident_type"]),
        "people_at_risk_count": pick("people_at_risk_count", "people_at_risk_count", new["people_at_risk_count"].cast("int")), "confidence": F.lit(None).cast("double"),
    }
    for column, part in (("location_text", "text"), ("latitude", "latitude"), ("longitude", "longitude"), ("location_precision", "precision")):
        if column in state.columns:
            changed[column] = pick("location", column, place[part])
    if "required_response" in state.columns:
        changed["required_response"] = pick("required_response", "required_response", F.from_json(new["required_response"], "array<string>"))
    touched = F.coalesce(*[F.col(f"o_{f}").isNotNull() for f in OVERRIDABLE])
    for f in OVERRIDABLE[1:]:
        touched = touched | F.col(f"o_{f}").isNotNull()
    out = scored(j.withColumns(changed), cfg).withColumn("priority_score", F.coalesce(F.round(new["priority_score"].cast("double"), 2), "priority_score"))
    return out.withColumn("priority_level", S.priority_level(F.col("priority_score"), cfg)).withColumn("overridden", touched).select(
        *[c for c in out.columns if c not in {*(f"o_{f}" for f in OVERRIDABLE), "overridden", "priority_level"}], "priority_level", "overridden"
    )
