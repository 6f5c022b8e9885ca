"""Rows that fail to parse: load the valid CSV records, set the others apart with a reason.

Records are read permissively with ``from_csv`` under an explicit schema that keeps the raw text of a corrupt
record. What the parser calls corrupt is reclassified: broken quoting, the number of fields. The parser is too
forgiving about quotes, so a record it took is judged for strict quoting as well if it holds any quote or line
break; all others are good as it read them. Last come the casts of the values. All of it is Catalyst expressions,
linear in the length of a record; a record never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.operators.timestamps import fence

#: The event types, and the columns of an event record.
EVENT_TYPES = ("work", "internship", "education", "certificate", "project", "skill")
EVENT_COLUMNS = ("type", "title", "level", "start_date", "end_date", "payload")
#: Records with more commas than the parser takes are read by :func:`fold_record` alone.
MOST_COMMAS = 20_000
_BLANK = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def _piece(open_: Column, piece: Column) -> tuple[Column, ...]:
    """What a piece between two commas does: (inside quotes, its text without the quote that begins it, closes, closes cleanly)."""
    begins = piece.startswith('"') & ~open_
    body = F.when(begins, F.substr(piece, F.lit(2))).otherwise(piece)
    bare = F.replace(body, F.lit('""'), F.lit(""))
    quote = F.instr(bare, '"')
    inside = open_ | begins
    closes = inside & (quote > 0)
    return inside, body, closes, closes & (quote == F.length(bare))


def judge_quotes(line: Column) -> Column:
    """Struct (open, bad, n): whether a quoted field never closes, whether text follows a closing quote, the number of fields.

    A field is quoted if its first character is a quote; a doubled quote inside stands for one.
    """
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("bad"), F.lit(0).alias("n"))

    def step(acc: Column, piece: Column) -> Column:
        inside, _, closes, clean = _piece(acc["open"], piece)
        stays = inside & ~closes
        return F.struct(stays.alias("open"), (acc["bad"] | (closes & ~clean)).alias("bad"), (acc["n"] + F.when(stays, 0).otherwise(1)).alias("n"))

    return F.aggregate(F.split(line, ",", -1), start, step)


def fold_record(line: Column, most: int) -> Column:
    """The values of a record's first ``most`` fields, quotes undone."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("fields"), F.lit("").alias("buf"))

    def step(acc: Column, piece: Column) -> Column:
        inside, body, closes, clean = _piece(acc["open"], piece)
        text = F.replace(F.when(clean, F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body), F.lit('""'), F.lit('"'))
        joined = F.when(acc["open"], F.concat(acc["buf"], F.lit(","), text)).otherwise(text)
        stays = inside & ~closes
        grown = F.concat(acc["fields"], F.array(F.when(inside, joined).otherwise(piece)))
        return F.struct(stays.alias("open"), F.when(stays | (F.size(acc["fields"]) >= most), acc["fields"]).otherwise(grown).alias("fields"), F.when(stays, joined).otherwise(F.lit("")).alias("buf"))

    return F.aggregate(F.split(line, ",", -1), start, step, lambda a: a["fields"])


def is_json_object(text: Column) -> Column:
    """Whether the text is one strict JSON object and nothing else; duplicate names are no fault."""
    s = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    shut = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    one = F.size(F.try_variant_get(shut, "$", "array<variant>")) == 1
    return s.startswith("{") & s.endswith("}") & F.coalesce(one, F.lit(False))


def judge_records(df: DataFrame, line: str, types: Sequence[str] = EVENT_TYPES, columns: Sequence[str] = EVENT_COLUMNS) -> DataFrame:
    """``df`` with ``record`` (struct of the columns, null unless valid), ``reason`` (null if valid) and ``corrupt``.

    The reasons in order: ``quoting``, ``column_count``, ``type``, ``payload``. A null line counts as
    ``column_count``; one carriage return at the end belongs to the line's end. Blank values become null
    in ``record``. ``corrupt`` keeps the raw text of failed records.
    """
    schema = ", ".join(f"{c} string" for c in [*columns, "_corrupt"])
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    few = F.length("__text") - F.length(F.replace("__text", F.lit(","), F.lit(""))) <= MOST_COMMAS
    rows = df.withColumn("__text", text).withColumn("__csv", fence(F.from_csv(F.when(few, F.col("__text")), schema, options)))
    # the parser took the record as a whole; without quotes and line breaks there is nothing it could forgive
    rows = rows.withColumn("__whole", F.col("__csv").isNotNull() & F.col("__csv._corrupt").isNull() & (F.col("__text") != ""))
    rows = rows.withColumn("__q", fence(F.when(~F.coalesce("__whole", F.lit(False)) | F.col("__text").rlike('["\\n\\r]'), judge_quotes(F.col("__text")))))
    q, n = F.col("__q"), len(columns)
    kept = F.array(*[F.coalesce(F.col("__csv")[c], F.lit("")) for c in columns])
    strict = q.isNotNull() & ~q["open"] & ~q["bad"] & (q["n"] == n)
    rows = rows.withColumn("__v", fence(F.when(F.col("__whole"), kept).when(strict, fold_record(F.col("__text"), n))))
    value = lambda i: F.get("__v", F.lit(i))
    kind, payload = F.lower(strip(value(0))), value(n - 1)
    reason = (
        F.when(F.col("__text").isNull(), "column_count")
        .when(q["open"] | q["bad"], "quoting")
        .when(q["n"] != n, "column_count")
        .when(~kind.isin(*types), "type")
        .when((strip(payload) != "") & ~is_json_object(payload), "payload")
    )
    rows = rows.withColumn("reason", reason)
    record = F.struct(*[F.when(strip(value(i)) != "", value(i)).alias(c) for i, c in enumerate(columns)])
    rows = rows.withColumn("record", F.when(F.col("reason").isNull(), record)).withColumn("corrupt", F.when(F.col("reason").isNotNull(), F.coalesce("__csv._corrupt", line)))
    return rows.drop("__text", "__csv", "__whole", "__q", "__v")
