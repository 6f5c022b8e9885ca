"""Sources and sinks beside Spark's own: event documents, taxonomies, settings, results."""

from __future__ import annotations

import importlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.operators.csv_rows import EVENT_COLUMNS

MAX_INPUT = 10 * 1024 * 1024
EVENTS = ", ".join(f"{c} string" for c in EVENT_COLUMNS)


def files(spark: SparkSession, path: str, pattern: str = "*.{pdf,docx}") -> DataFrame:
    """Files under a path: path, modificationTime, length, content. Filters on length are pushed to the listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Events from CSV files with a header; blank cells are null, others are kept as they are, broken rows keep their text in ``_corrupt``."""
    rows = spark.read.csv(path, schema=EVENTS + ", _corrupt string", header=True, multiLine=True, escape='"', columnNameOfCorruptRecord="_corrupt")
    return rows.withColumns({c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in EVENT_COLUMNS})


def events_yaml(spark: SparkSession, text: str, max_input: int = MAX_INPUT) -> DataFrame:
    """Events of one YAML document that holds CSV text under ``events_csv``; a surplus cell makes the whole input invalid."""
    import csv
    import io

    if len(text) > max_input:
        raise ValueError("input too large")
    doc = importlib.import_module("yaml").safe_load(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("events_csv"), str):
        raise ValueError("input must be a mapping with events_csv")
    out = []
    for i, row in enumerate(csv.DictReader(io.StringIO(doc["events_csv"]))):
        if None in row:
            raise ValueError("a row has too many cells")
        out.append((i, *[(row.get(c) if row.get(c) and row[c].strip() else None) for c in EVENT_COLUMNS]))
    return spark.createDataFrame(out, "event_seq int, " + EVENTS)


def taxonomy_jdbc(spark: SparkSession, url: str, table: str = "occupations", **options: str) -> DataFrame:
    """Taxonomy rows of a database; the null test and the columns are pushed down."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return taxonomy(rows)


def taxonomy(rows: DataFrame, name: str = "occupations", source: str = "database") -> DataFrame:
    """Any table with the taxonomy's columns, nulls as empty text, with its constant columns."""
    kept = rows.where(F.col("preferred_label").isNotNull())
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    seq = [F.col("rec_seq")] if "rec_seq" in rows.columns else []
    return kept.select(text("uri"), "preferred_label", "alt_labels", text("isco_code"), text("definition"), F.lit(name).alias("taxonomy"), F.lit(source).alias("source"), *seq)


def settings(path: str | None) -> dict:
    """Settings of a JSON file; a missing file gives defaults, anything but an object is refused."""
    if not path or not Path(path).exists():
        return {}
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(doc, dict):
        raise ValueError("settings must be a JSON object")
    return doc


def to_yaml(df: DataFrame) -> str:
    """A small result (one document's) as YAML; tables are written with ``df.write``."""
    return importlib.import_module("yaml").safe_dump([r.asDict(recursive=True) for r in df.collect()], allow_unicode=True, sort_keys=False)


def append_cache(resolved: DataFrame, path: str, ttl_seconds) -> None:
    """Appends results with their time of expiry, for a later anti join."""
    expires = F.current_timestamp() + F.make_interval(secs=ttl_seconds.cast("decimal(18,6)"))
    resolved.withColumn("expires_at", expires).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("expires_at") > F.current_timestamp())
