"""Sources: reports, labelled events, tables, lexicons. Sinks: public exports, feeds, scorecards, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster import schemas

PUBLIC_COLUMNS = ("report_id", "text", "source", "is_synthetic", "reported_at", "metadata")
PUBLIC_KEYS = ("caller_id", "source_id", "channel", "region", "language")


def read_reports(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A JSON list, JSON lines or parquet under the report schema."""
    reader = spark.read.schema(schemas.REPORT)
    if fmt == "json_list":
        return reader.option("multiLine", True).json(path)
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def read_report_stream(spark: SparkSession, path: str, fmt: str = "json", files_a_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schemas.REPORT).option("maxFilesPerTrigger", files_a_trigger)
    return reader.format(fmt).load(path)


def read_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scenario events as (reports, labels): what is dispatched and what is expected never share a row."""
    both = spark.read.schema(schemas.LABELLED).json(path)
    reports = both.select("event_id", "delay_seconds", "dispatch.*")
    labels = both.select("event_id", F.col("dispatch.report_id").alias("report_id"), "ground_truth.*")
    return reports, labels


def union_corpora(**corpora: DataFrame) -> DataFrame:
    out = None
    for name, df in corpora.items():
        tagged = df.withColumn("corpus", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_table(df: DataFrame, path: str, day_of: str | None = None) -> None:
    """Append, split by kind and day so that later reads prune; one shuffle by those keep files large."""
    parts = [c for c in ("is_synthetic",) if c in df.columns]
    if day_of:
        df, parts = df.withColumn("day", F.to_date(day_of)), [*parts, "day"]
    df.write.mode("append").partitionBy(*parts).parquet(path) if parts else df.write.mode("append").parquet(path)


# Our own small lexicon: class, tier, term, weight. Phrases count 2, keywords 1.
LEXICON = (
    ("FLOOD_FLASH_FLOOD", "phrase", "water is rising"), ("FLOOD_FLASH_FLOOD", "phrase", "street under water"), ("FLOOD_FLASH_FLOOD", "keyword", "flood"),
    ("FLOOD_FLASH_FLOOD", "keyword", "flooded"), ("FLOOD_FLASH_FLOOD", "keyword", "submerged"),
    ("FIRE_WILDFIRE_EXPLOSION", "phrase", "thick smoke"), ("FIRE_WILDFIRE_EXPLOSION", "keyword", "fire"), ("FIRE_WILDFIRE_EXPLOSION", "keyword", "flames"),
    ("FIRE_WILDFIRE_EXPLOSION", "keyword", "explosion"), ("STRUCTURAL_COLLAPSE", "phrase", "roof caved in"), ("STRUCTURAL_COLLAPSE", "keyword", "collapsed"),
    ("STRUCTURAL_COLLAPSE", "keyword", "rubble"), ("EARTHQUAKE_LANDSLIDE", "keyword", "earthquake"), ("EARTHQUAKE_LANDSLIDE", "keyword", "landslide"),
    ("SEVERE_WEATHER_STORM", "keyword", "storm"), ("SEVERE_WEATHER_STORM", "keyword", "hail"), ("MEDICAL_EMERGENCY", "phrase", "not breathing"),
    ("MEDICAL_EMERGENCY", "keyword", "unconscious"), ("MEDICAL_EMERGENCY", "keyword", "bleeding"), ("CIVIL_UNREST_ACTIVE_THREAT", "keyword", "gunman"),
    ("CIVIL_UNREST_ACTIVE_THREAT", "keyword", "riot"), ("UTILITY_INFRASTRUCTURE_FAILURE", "phrase", "power is out"), ("UTILITY_INFRASTRUCTURE_FAILURE", "keyword", "outage"),
    ("OTHER_GENERAL_INCIDENT", "keyword", "noise"),
)
LEXICON_SCHEMA = "class string, tier string, term string"


def load_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), LEXICON_SCHEMA)


def extend_gazetteer(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Terms (lower-cased, trimmed) of both; an existing term keeps its type."""
    tidy = lambda df, k: df.select(F.lower(F.trim("term")).alias("term"), "entity_type", F.lit(k).alias("k")).where("term <> ''")
    both = tidy(base, 0).unionByName(tidy(extra, 1))
    return both.groupBy("term").agg(F.min(F.struct("k", "entity_type")).alias("m")).select("term", F.col("m.entity_type").alias("entity_type"))


# Scenario families of an outside corpus and our types.
EXTERNAL_TYPES = {
    "flood": "FLOOD_FLASH_FLOOD", "flash flood": "FLOOD_FLASH_FLOOD", "wildfire": "FIRE_WILDFIRE_EXPLOSION", "fire": "FIRE_WILDFIRE_EXPLOSION",
    "explosion": "FIRE_WILDFIRE_EXPLOSION", "collapse": "STRUCTURAL_COLLAPSE", "earthquake": "EARTHQUAKE_LANDSLIDE", "landslide": "EARTHQUAKE_LANDSLIDE",
    "storm": "SEVERE_WEATHER_STORM", "hurricane": "SEVERE_WEATHER_STORM", "medical": "MEDICAL_EMERGENCY", "shooting": "CIVIL_UNREST_ACTIVE_THREAT",
    "riot": "CIVIL_UNREST_ACTIVE_THREAT", "outage": "UTILITY_INFRASTRUCTURE_FAILURE",
}


def map_external_type(df: DataFrame, col: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Our type for a corpus' scenario name; unknown names are general incidents."""
    table = mapping or EXTERNAL_TYPES
    rows = df.sparkSession.createDataFrame(list(table.items()), "_name string, incident_type string")
    joined = df.withColumn("_k", F.lower(F.trim(col))).join(F.broadcast(rows), F.col("_k") == F.col("_name"), "left")
    return joined.withColumn("incident_type", F.coalesce("incident_type", F.lit("OTHER_GENERAL_INCIDENT"))).drop("_k", "_name")


def allow_metadata(metadata: Column, keys: tuple[str, ...] = PUBLIC_KEYS) -> Column:
    return F.map_filter(metadata, lambda k, v: k.isin(*keys))


def public_rows(df: DataFrame) -> DataFrame:
    kept = [c for c in PUBLIC_COLUMNS if c in df.columns]
    out = df.select(*kept)
    return out.withColumn("metadata", allow_metadata(F.col("metadata"))) if "metadata" in kept else out


def export_public(df: DataFrame, path: str) -> None:
    public_rows(df).write.mode("overwrite").json(path)


def rows_as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("row"))


def to_feed(changes: DataFrame) -> DataFrame:
    """``changes(incident_id, is_new, status, previous_status, at)`` -> envelopes; a changed status adds a second one."""
    payload = F.to_json(F.struct("incident_id", "status"))
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    main = F.struct(F.when(F.col("is_new"), "INCIDENT_CREATED").otherwise("INCIDENT_UPDATED").alias("event"))
    more = F.when(~F.col("is_new") & (F.col("status") != F.col("previous_status")), F.struct(F.lit("STATUS_CHANGED").alias("event")))
    events = F.array_compact(F.array(main, more))
    return changes.select(F.explode(events).alias("e"), payload.alias("payload"), stamp.alias("timestamp")).select("e.event", "payload", "timestamp")


def write_scorecard(df: DataFrame, path: str) -> None:
    """Metric rows ``(suite, metric, value, n)`` as JSON."""
    df.select("suite", "metric", "value", "n").write.mode("overwrite").json(path)
