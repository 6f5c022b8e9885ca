"""Queries of the general training-data operators: timestamps (p4), failing rows (p6), intervals (p7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.operators import csv_rows, intervals, timestamps
from vitalake.plans import date_sql
from vitalake.session import table

OPEN_ENDS = ("", "present", "current", "now")
OPEN_DAY = "2025-01-01"
PLAIN = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?\z"


#: Candidate offset histories of feeds without a zone; the first wins ties.
ZONES = ("UTC", "Europe/Berlin", "Europe/Amsterdam", "America/New_York", "America/Chicago", "Asia/Kolkata", "Asia/Tokyo", "Asia/Dubai")


def event_values(spark: SparkSession, d: str) -> DataFrame:
    """The dates of resume events, one per row."""
    e = table(spark, d, "resume_events").select("event_id", "resume_id", "type", "start_date", "end_date", "feed", "feed_zone", "ingested_at")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("start_date", "end_date")]))
    return e.select(F.lit("resume_events").alias("src"), F.col("event_id").alias("row_id"), fields.alias("x"), "feed", "feed_zone", F.col("ingested_at").alias("seen")).select("src", "row_id", "x.field", "x.value", "feed", "feed_zone", "seen")


def pdf_values(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pdf_results")
    return p.select(F.lit("pdf_results").alias("src"), F.col("pdf_id").alias("row_id"), F.lit("creation_date").alias("field"), F.col("metadata.creation_date").alias("value"), "feed", "feed_zone", F.col("received_at").alias("seen"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # values without a digit name no date, and values in the plain form are no cases: neither is parsed
    rows = event_values(spark, d).unionByName(pdf_values(spark, d)).where(F.col("value").rlike("[0-9۰-۹٠-٩]") & ~F.col("value").rlike(PLAIN))
    # UTC, which the tables' description names for feeds without a zone, is the prior of the estimate
    done = timestamps.normalise(rows, "value", "feed", "feed_zone", "seen", unzoned=ZONES)
    return done.where(F.col("value_utc").isNotNull()).select("src", "row_id", "field", timestamps.iso_utc(F.col("value_utc")).alias("utc"))


def p4_zones(spark: SparkSession, d: str) -> DataFrame:
    """Every feed with the zone estimated from its local times and ingestion times, beside the declared one."""
    rows = event_values(spark, d).unionByName(pdf_values(spark, d)).where(F.col("value").isNotNull())
    timed = rows.where(F.col("value").rlike(timestamps.TIMED)).withColumn("__ts_df", F.lit(True))
    read = timestamps.walls(timed, "value", "__ts_df").where("__ts_p.h is not null and __ts_p.zone = ''")
    est = timestamps.estimate_zones(read.select("feed", "seen", F.col("__ts_w").alias("wall")), ZONES)
    declared = rows.groupBy("feed").agg(F.min("feed_zone").alias("declared"), F.count(F.lit(1)).alias("n_values"))
    return declared.join(est, "feed", "left").select("feed", "declared", "n_values", "est_zone", "violations", "informative")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_event_lines").where("line_no <> 1").select("line_id", "line")
    return csv_rows.judge_records(rows, "line").where("reason is not null").select("line_id", "reason")


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid records as typed events."""
    rows = table(spark, d, "raw_event_lines").where("line_no <> 1").select("line_id", "file_id", "line_no", "line")
    return csv_rows.judge_records(rows, "line").where("reason is null").select("line_id", "file_id", "line_no", "record.*")


def feeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What all values of a feed say about it: (feed, day_first) and (feed, est_zone)."""
    every = event_values(spark, d).unionByName(pdf_values(spark, d))
    orders = timestamps.gathered(timestamps.feed_orders(every.select("feed", timestamps.clean(F.col("value")).alias("s"), "seen")))
    return orders, timestamps.gathered(timestamps.feed_zones(every.withColumnRenamed("feed_zone", "zone"), ZONES, orders))


def _job_days(spark: SparkSession, d: str) -> DataFrame:
    """(resume_id, d0, d1): first and last day of each job; order of day and month and missing zones are those of the whole feed, as in p4."""
    orders, zones = feeds(spark, d)
    e = table(spark, d, "resume_events").select("resume_id", "type", "start_date", "end_date", "feed", "feed_zone", "ingested_at")
    text = lambda c: F.lower(csv_rows.strip(F.coalesce(c, F.lit(""))))
    jobs = e.where(text("type").isin("work", "internship"))
    jobs = timestamps.normalise(jobs, ["start_date", "end_date"], "feed", "feed_zone", "ingested_at", orders=orders, zones=zones)
    day = lambda c: F.date_from_unix_date(F.floor(F.col(c) / 86400).cast("int"))
    end = F.when(text("end_date").isin(*OPEN_ENDS), F.lit(OPEN_DAY).cast("date")).otherwise(day("end_date_utc"))
    return jobs.select("resume_id", day("start_date_utc").alias("d0"), end.alias("d1"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(_job_days(spark, d), "resume_id", F.col("d0"), F.col("d1"))


QUERIES = {"p4_found": p4_found, "p4_zones": p4_zones, "p6_found": p6_found, "p6_loaded": p6_loaded, "p7_found": p7_found}

_FIELD = r'(?:"(?:[^"]|"")*"|[^",][^,]*|)'
_RECORDS = f"""t AS (SELECT *, regexp_replace(line, '\\r$', '') AS l FROM raw_event_lines WHERE line_no <> 1), f AS (SELECT *, regexp_extract_all(l || ',', '{_FIELD},') AS a FROM t),
w AS (SELECT *, list_transform(a, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-3], '""', '"') ELSE x[:-2] END) AS v FROM f),
r AS (SELECT *, CASE WHEN l IS NULL THEN 'column_count' WHEN NOT regexp_full_match(l, '(?s){_FIELD}(?:,{_FIELD})*') THEN 'quoting' WHEN len(a) <> 6 THEN 'column_count' WHEN lower(trim(v[1])) NOT IN ('work', 'internship', 'education', 'certificate', 'project', 'skill') THEN 'type'
 WHEN trim(coalesce(v[6], '')) <> '' AND (NOT json_valid(v[6]) OR json_type(CASE WHEN json_valid(v[6]) THEN v[6] END) <> 'OBJECT' OR regexp_matches(v[6], ',\\s*[}}\\]]|\\bNaN\\b|\\bInfinity\\b')) THEN 'payload' END AS reason FROM w)"""
ORACLES = {
    "p4_found": date_sql.FOUND,
    "p4_zones": date_sql.zones(ZONES),
    "p6_found": f"WITH {_RECORDS} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p6_loaded": f"WITH {_RECORDS} SELECT line_id, file_id, line_no, " + ", ".join(f"CASE WHEN trim(v[{i}], ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN v[{i}] END AS {c}" for i, c in enumerate(csv_rows.EVENT_COLUMNS, 1)) + " FROM r WHERE reason IS NULL",
    "p7_found": date_sql.PERIODS,
}
