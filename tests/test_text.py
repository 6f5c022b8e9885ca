import pytest
from pyspark.sql import functions as F

from vitalake.config import TextConfig
from vitalake.functions import json_text
from vitalake.functions import text as T


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "t string")
    r = fn(F.col("t"))
    cols = [c.alias(f"c{i}") for i, c in enumerate(r if isinstance(r, tuple) else (r,))]
    got = tuple(df.select(*cols).collect()[0])
    return got if len(got) > 1 else got[0]


@pytest.mark.parametrize("text,want", [
    ("a\nb.\nc\n\nd\n- e\nf", ("a b.\nc\nd\n- e\nf", 1)), ("Skills\nPython and\nSQL.", ("Skills Python and SQL.", 2)), ("Skills:\nPython and\nSQL.", ("Skills:\nPython and SQL.", 1)),
    ("Skills\n\nPython\nEducation\n- MSc", ("Skills\nPython Education\n- MSc", 0)), ("", ("", 0)), (None, (None, None)),
])
def test_refill(spark, text, want):
    assert one(spark, text, lambda c: T.refill(c, F.lit("en"))) == want


def test_scalars(spark):
    assert one(spark, "a  b \t\n\n\n\nc", T.squeeze) == ("a b\n\nc", 5)
    assert one(spark, " a \n\n \nb\n", T.drop_empty) == ("a\nb", 2)
    assert one(spark, "ﬁx oﬃce", lambda c: T.fix_ocr(c, F.lit("en"))) == ("fix office", 2)
    assert one(spark, "ﬁ²", T.nfkc) == "fi2"
    assert one(spark, "۰۱۲" * 3 + "x" * 81, T.detect_script) == "en"
    assert one(spark, "سلام دوست", T.detect_script) == "fa" and one(spark, "", T.detect_script) == "en"
    assert one(spark, "1\n\x0b2\r\n", T.split_lines) == ["1", "", "2"] and one(spark, "", T.split_lines) == []


@pytest.mark.parametrize("text,limit,want", [("hello big world", 11, "hello big\n\n...[TRUNCATED]"), ("helloworldx", 5, "hello\n\n...[TRUNCATED]"), (" abcdef", 4, " abc\n\n...[TRUNCATED]"), ("short", 9, "short")])
def test_truncate(spark, text, limit, want):
    assert one(spark, text, lambda c: T.truncate(c, limit))["text"] == want


def test_sections(spark):
    got = one(spark, "intro\nSKILLS:\nPython\nSQL\nEducation\nMSc\nSkills\nGo", T.sections)
    assert got == {"work": "", "education": "MSc", "skills": "Go", "certificates": ""}
    assert one(spark, "Skills\nPython\nSkills\n", T.sections)["skills"] == "Python"
    assert one(spark, "Technical Skills :\nX", T.sections)["skills"] == "X"


def test_pipeline(spark):
    df = spark.createDataFrame([(1, "Skills:\nﬁre and\nice.\n3 / 4\n", "clash"), (2, None, "x"), (3, "", "x"), (4, "y" * 50, "x")], "id int, text string, stats string")
    got = {r["id"]: r for r in T.post_process(df.drop("stats"), "text", TextConfig(max_text_length=40)).collect()}
    assert got[1]["sections"]["skills"] == "fire and ice.\n3 / 4" and got[1]["stats"]["unicode_changes" if "unicode_changes" in got[1]["stats"] else "normalize_unicode"] == 1
    assert got[2]["error"] == "text is null" and got[2]["processed"] is None and got[3]["processed"] == "" and got[4]["error"] == "text too long"
    T.register_stage("shout", lambda t, _: (F.upper(t), F.lit(1)))
    r = T.post_process(df.where("id = 1"), "text", TextConfig(stages=("shout", "unknown"))).collect()[0]
    assert r["processed"].startswith("SKILLS") and r["stats"]["shout"] == 1
    assert T.post_process(df.limit(0), "text").count() == 0


@pytest.mark.parametrize("text,want", [('x {"a":{"b":1}} y {"c":2}', '{"a":{"b":1}}'), ('} {"a":1}', '} {"a":1}'), ('{"a":1', '{"a":1'), ('{"a":"}"}', '{"a":"}'), (None, None), ("", "")])
def test_first_json(spark, text, want):
    assert one(spark, text, json_text.first_object) == want


def test_record_parsing(spark):
    r = one(spark, '{"skills": [{"name": "sql"}]}', json_text.parse_record)
    assert r["record"]["skills"][0]["name"] == "sql" and r["error"] is None
    assert one(spark, "not json", json_text.parse_record)["error"] == "invalid JSON"
    assert one(spark, "a <|output|> b ", json_text.after_marker) == "b"
