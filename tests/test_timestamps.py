from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitalake.operators import timestamps as ts

SEEN = datetime(2024, 6, 1)
SCHEMA = "id int, v string, feed string, zone string, seen timestamp"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, SEEN) for i, r in enumerate(rows)], SCHEMA)
    out = ts.normalise(df, "v", "feed", "zone", "seen", **kw).select("id", ts.iso_utc(F.col("v_utc")).alias("u")).collect()
    return [r["u"] for r in sorted(out, key=lambda r: r["id"])]


CASES = [
    ("2020-01-02", None, "2020-01-02T00:00:00Z"),
    ("2020-01-02T03:04:05Z", "Asia/Tokyo", "2020-01-02T03:04:05Z"),
    ("2020-01-02 03:04:05", "Asia/Tokyo", "2020-01-01T18:04:05Z"),
    ("2020-01-02T03:04:05.999+05:45", None, "2020-01-01T21:19:05Z"),
    ("2012-09-16 19:32:25 CEST", "Asia/Tokyo", "2012-09-16T17:32:25Z"),
    ("Sun, 11 Mar 2012 02:55:59 -0500", None, "2012-03-11T07:55:59Z"),
    ("Sat Feb  3 02:30:37 2018", None, "2018-02-03T02:30:37Z"),
    ("D:20170514055626Z00'00'", None, "2017-05-14T05:56:26Z"),
    ("D:20160204001016-05'00'", None, "2016-02-04T05:10:16Z"),
    ("D:201910", None, "2019-10-01T00:00:00Z"),
    ("29-Nov-02", None, "2002-11-29T00:00:00Z"),
    ("Nov '71", None, "1971-11-01T00:00:00Z"),
    ("13. März 2005", None, "2005-03-13T00:00:00Z"),
    ("21 août 2016", None, "2016-08-21T00:00:00Z"),
    ("22nd of September 2010", None, "2010-09-22T00:00:00Z"),
    ("2009-W53-5", None, "2010-01-01T00:00:00Z"),
    ("2010-W53-1", None, None),
    ("1264940257473", None, "2010-01-31T12:17:37Z"),
    ("1657751426", "Asia/Tokyo", "2022-07-13T22:30:26Z"),
    ("۱۹۹۹/۰۶/۰۹", None, "1999-06-09T00:00:00Z"),
    ("20151202T202429", "Europe/Berlin", "2015-12-02T19:24:29Z"),
    ("05/2014", None, "2014-05-01T00:00:00Z"),
    ("2019-02-30", None, None), ("31.11.2016", None, None), ("00/00/0000", None, None), ("2014-13-01", None, None), ("soon", None, None), ("20xx", None, None), ("", None, None), (None, None, None),
    ("2020-01-02 25:00:00", None, None),
    ("x" * 100_000, None, None), ("9" * 100_000, None, None), ("1 " * 50_000, None, None), ("\x012020-01-02", None, None),
    ("Wednesday, 2 January 2020", None, "2020-01-02T00:00:00Z"), ("Donnerstag, 2. Januar 2020", None, "2020-01-02T00:00:00Z"), ("jeudi 2 janvier 2020", None, "2020-01-02T00:00:00Z"), ("Thursday, January 2, 2020 03:04", None, "2020-01-02T03:04:00Z"),
    ("Do., 2. Jan. 2020", None, "2020-01-02T00:00:00Z"), ("until 2 January 2020", None, None), ("  2020-01-02" + " " * 300 + "03:04:05  ", None, "2020-01-02T03:04:05Z"), ("2020-01-02T03:04:05." + "9" * 200 + "Z", None, "2020-01-02T03:04:05Z"),
    ("1900-02-29", None, None), ("2000-02-29", None, "2000-02-29T00:00:00Z"), ("1600-12-31", None, "1600-12-31T00:00:00Z"), ("02/29/2019", None, None), ("13/13/2019", None, None), ("3/4/2019 12:05 AM", None, "2019-04-03T00:05:00Z"), ("3/4/2019 13:05 PM", None, None),
]


def test_forms(spark):
    got = run(spark, [(v, "a", z) for v, z, _ in CASES])
    assert got == [u for *_, u in CASES]


def test_days_of_all_dates(spark):
    every = spark.range(-354_000, 370_000, 37).select(F.date_from_unix_date(F.col("id").cast("int")).alias("x"), "id")
    bad = every.where(ts._days(F.year("x"), F.month("x"), F.day("x")) != F.col("id"))
    assert bad.count() == 0 and every.where(ts._days(F.year("x"), F.month("x"), F.day("x")).isNull()).count() == 0


def test_clock_changes_take_the_offset_before(spark):
    rows = [("2021-03-28 02:30", "b", "Europe/Berlin"), ("2021-10-31 02:30", "b", "Europe/Berlin"), ("2021-03-14 02:30", "b", "America/New_York"), ("2021-11-07 01:30", "b", "America/New_York")]
    assert run(spark, rows) == ["2021-03-28T01:30:00Z", "2021-10-31T00:30:00Z", "2021-03-14T07:30:00Z", "2021-11-07T05:30:00Z"]


def test_order_of_a_feed(spark):
    rows = [("05/23/2011", "us", None), ("03/04/2011", "us", None), ("23.5.2011", "eu", None), ("03/04/2011", "eu", None), ("03/04/2011", None, None)]
    assert [x[:10] for x in run(spark, rows)] == ["2011-05-23", "2011-03-04", "2011-05-23", "2011-04-03", "2011-04-03"]


def test_missing_zones_are_estimated(spark):
    # ingested ten minutes after the event, clocks of Tokyo: read as UTC they would lie in the future
    rows = [(i, f"2021-05-{d:02d} 20:00:00", "t", None, datetime(2021, 5, d, 11, 10)) for i, d in enumerate(range(1, 21))]
    df = spark.createDataFrame(rows, SCHEMA)
    zones = ["UTC", "America/New_York", "Asia/Tokyo", "Europe/Berlin"]
    got = ts.normalise(df, "v", "feed", "zone", "seen", unzoned=zones).select(ts.iso_utc(F.col("v_utc")).alias("u")).collect()
    assert {r["u"][11:] for r in got} == {"11:00:00Z"}
    # without evidence the first candidate stands
    late = [(i, f"2021-05-{d:02d} 20:00:00", "t", None, datetime(2022, 5, d)) for i, d in enumerate(range(1, 21))]
    got = ts.normalise(spark.createDataFrame(late, SCHEMA), "v", "feed", "zone", "seen", unzoned=zones).select(ts.iso_utc(F.col("v_utc")).alias("u")).collect()
    assert {r["u"][11:] for r in got} == {"20:00:00Z"}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", day_first string, s string, x int")
    assert ts.normalise(df, "v", "feed", "zone", "seen").count() == 0
    df = spark.createDataFrame([(1, "2020-05", "f", "Not/AZone", SEEN, "keep", "s", 3)], SCHEMA + ", day_first string, s string, x int")
    row = ts.normalise(df, "v", "feed", "zone", "seen").collect()[0]
    assert row["day_first"] == "keep" and row["s"] == "s" and row["v_utc"] == 1588291200
    with pytest.raises(Exception):
        ts.normalise(df, "missing", "feed", "zone", "seen").collect()
