"""Structured records from document text: a pluggable extractor per worker, its output parsed under one schema.

An extractor turns texts into JSON texts. A language model would be one (it is loaded once per worker by its
factory); none can run here, so a rule-based baseline is the default. Null and empty texts give an empty
record; output that is no such JSON keeps an error and a null record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.config import TextConfig
from vitalake.functions import json_text
from vitalake.functions import text as T

MARKER = "<|output|>"


class Extractor(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def prompt(text: Column, rules: str = "Return one JSON object with the fields of the schema. Use null where the text says nothing.") -> Column:
    """Rules, schema, text and marker, in this order, so that what is cut off by a length limit is never the rules."""
    return F.concat(F.lit(f"{rules}\nSchema: {json_text.RECORD}\nText:\n"), F.coalesce(text, F.lit("")), F.lit(f"\n{MARKER}"))


_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_PHONE = re.compile(r"\+?\d[\d ()./-]{7,}\d")
_WEB = re.compile(r"\b(?:https?://|www\.)\S+")


def rule_extractor() -> Extractor:
    """Contact data by pattern, skills, degrees and certificates by their sections' lines."""

    def lines(section: str) -> list[str]:
        return [x for x in (re.sub(r"^[-*•]\s*", "", y).strip() for y in section.split("\n")) if x]

    def one(doc: str) -> str:
        d = json.loads(doc)
        text, s = d["text"] or "", d["sections"] or {}
        first = lambda p: m.group() if (m := p.search(text)) else None
        person = {"name": None, "email": first(_EMAIL), "phone": first(_PHONE), "website": first(_WEB), "location": None}
        return json.dumps({
            "personal_information": person, "experience": [{"type": "work", "description": x} for x in lines(s.get("work", ""))], "education": [{"degree": x} for x in lines(s.get("education", ""))],
            "projects": [], "skills": [{"name": x} for x in lines(s.get("skills", ""))], "certificates": [{"name": x} for x in lines(s.get("certificates", ""))],
        })

    return lambda docs: [one(x) for x in docs]


def extract(df: DataFrame, key: str, text: str, factory: Callable[[], Extractor] = rule_extractor, prompted: bool = False, cfg: TextConfig = T.CFG) -> DataFrame:
    """(key, record, error): one row per row of ``df``.

    The baseline gets the text and its sections as JSON; with ``prompted`` the extractor gets a prompt, and what
    follows the last marker in its answer is read, up to the end of the first object.
    """
    kind = dict(df.dtypes)[key]
    given = prompt(F.col(text)) if prompted else F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("text"), T.sections(F.coalesce(text, F.lit("")), cfg).alias("sections")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = factory()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "raw": work(list(b["doc"]))})

    raw = df.select(F.col(key).alias("key"), given.alias("doc")).mapInPandas(run, f"key {kind}, raw string")
    parsed = raw.select("key", json_text.parse_record(json_text.first_object(json_text.after_marker(F.col("raw"), MARKER))).alias("p"))
    return parsed.select(F.col("key").alias(key), "p.record", "p.error")
