"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

``session_window`` with a row-specific duration merges overlapping intervals natively. Of the intervals of an
entity that begin on the same day only the longest is kept before: that runs map-side, and bounds the rows of a hot
entity by the days they begin on, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"


def _sessions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, d0, d1 (day numbers, inclusive). An interval lasts until noon of its last day, so that
    intervals merge exactly if they share a day and not if one begins the day after the other ends."""
    start = F.timestamp_seconds(F.col("d0") * 86400)
    hours = F.concat(((F.col("d1") - F.col("d0")) * 24 + 12).cast("string"), F.lit(" hours"))
    merged = rows.withColumn("t", start).withColumn("dur", hours).groupBy(*keys, F.session_window("t", F.col("dur")).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    day = lambda c: F.floor(F.unix_seconds(c) / 86400).cast("int")
    return merged.select(*keys, day(F.col("w.start")).alias("d0"), day(F.col("w.end")).alias("d1"))


def merge_days(df: DataFrame, entity: str, first: Column, last: Column) -> DataFrame:
    """(entity, d0, d1): continuous periods per entity, as days since 1970, both ends included.

    ``first`` and ``last`` are dates. Rows with a null entity, a missing end or an end before the start
    are left out; repeated rows change nothing; an empty table gives an empty result.
    """
    rows = df.select(F.col(entity), F.unix_date(first).alias("d0"), F.unix_date(last).alias("d1")).where(F.col(entity).isNotNull() & (F.col("d0") <= F.col("d1")))
    return _sessions(rows.groupBy(entity, "d0").agg(F.max("d1").alias("d1")), [entity])


def periods_and_gaps(df: DataFrame, entity: str, first: Column, last: Column) -> DataFrame:
    """(entity, kind, from_day, to_day): kind ``period`` per merged interval, ``gap`` from the end of one to the start of the next."""
    merged = merge_days(df, entity, first, last)
    nxt = F.lead("d0").over(Window.partitionBy(entity).orderBy("d0"))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("d0").alias("a"), F.col("d1").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.col("d1").alias("a"), F.col("next").alias("b")),
    )
    rows = merged.withColumn("next", nxt).select(entity, F.explode(both).alias("x")).where("x.b is not null")
    text = lambda c: F.date_from_unix_date(c).cast("string")
    return rows.select(entity, F.col("x.kind").alias("kind"), text(F.col("x.a")).alias("from_day"), text(F.col("x.b")).alias("to_day"))
