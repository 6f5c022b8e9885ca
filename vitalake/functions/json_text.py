"""JSON inside free text: the first object, and the schema of an extracted record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The shape of an extracted record.
RECORD = (
    "struct<personal_information:struct<name:string,email:string,phone:string,website:string,location:string>,"
    "experience:array<struct<type:string,company:string,title:string,duration_months:double,description:string,responsibilities:array<string>,achievements:array<string>,technologies:array<string>>>,"
    "education:array<struct<institution:string,degree:string,field:string,duration_months:double,achievements:array<string>>>,"
    "projects:array<struct<name:string,description:string,duration_months:double,technologies:array<string>,achievements:array<string>>>,"
    "skills:array<struct<name:string>>,"
    "certificates:array<struct<name:string,issuer:string,date:string,description:string>>>"
)


def after_marker(c: Column, marker: str = "<|output|>") -> Column:
    """What follows the last marker, trimmed; the whole text where there is none."""
    return F.regexp_replace(F.substring_index(c, marker, -1), r"(?U)^\s+|\s+$", "")


def _first(text: str) -> str:
    depth, begin = 0, -1
    at = 0
    while True:
        a, z = text.find("{", at), text.find("}", at)
        if a < 0 and z < 0:
            return text
        if a >= 0 and (z < 0 or a < z):
            if begin < 0:
                begin = a
            depth, at = depth + 1, a + 1
        else:
            depth, at = depth - 1, z + 1
            if depth == 0 and begin >= 0:
                return text[begin:at]


@F.pandas_udf(StringType())
def first_object(s: pd.Series) -> pd.Series:
    """The first span of balanced braces; the text itself where none closes. Braces inside strings count, null stays null."""
    return s.map(lambda t: _first(t) if isinstance(t, str) else None)


def parse_record(c: Column) -> Column:
    """Struct (record, error): the record is null and the error set where the text is no such JSON."""
    whole = F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT")
    got = F.when(whole, F.from_json(c, RECORD))
    return F.struct(got.alias("record"), F.when(c.isNotNull() & got.isNull(), "invalid JSON").alias("error"))
