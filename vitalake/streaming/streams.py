"""Streaming forms: the stateless operators run unchanged on streams, counts need a watermark, periods keep state.

Nothing is collected; late rows beyond the watermark are dropped by it alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.config import TextConfig
from vitalake.functions import text as T
from vitalake.operators import csv_rows


def table_stream(spark: SparkSession, path: str, schema, max_files: int = 16) -> DataFrame:
    """A directory of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def judged_records(stream: DataFrame, line: str) -> DataFrame:
    """CSV records with their reason, as they arrive."""
    return csv_rows.judge_records(stream, line)


def processed_texts(stream: DataFrame, text: str, cfg: TextConfig = T.CFG) -> DataFrame:
    return T.post_process(stream, text, cfg)


def windowed_counts(stream: DataFrame, time: str, kind: Column, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(from, to, kind, n): counts per window and kind; windows close once the watermark has passed them."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "kind", "n")


def running_periods(stream: DataFrame, entity: str) -> DataFrame:
    """(entity, n_periods, n_days): continuous periods so far, per entity, after each batch.

    ``stream`` has the entity and day numbers d0 and d1. The state of an entity is its merged periods, which are
    bound by the days of its span, not by its rows.
    """
    kind = dict(stream.dtypes)[entity]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spans = list(zip(*state.get)) if state.exists else []
        for b in batches:
            ok = b[b["d0"].notna() & b["d1"].notna() & (b["d0"] <= b["d1"])]
            spans += list(zip(ok["d0"].astype(int), ok["d1"].astype(int)))
        merged: list[list[int]] = []
        for a, z in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        state.update(([int(a) for a, _ in merged], [int(z) for _, z in merged]))
        yield pd.DataFrame({entity: [key[0]], "n_periods": [len(merged)], "n_days": [sum(z - a + 1 for a, z in merged)]})

    return stream.select(entity, "d0", "d1").groupBy(entity).applyInPandasWithState(fold, f"{entity} {kind}, n_periods int, n_days bigint", "a array<int>, z array<int>", "update", "NoTimeout")
