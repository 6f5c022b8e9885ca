import pytest

from vitalake.operators import career

SCHEMA = "resume_id int, event_id int, event_seq int, type string, title string, level string, start_date string, end_date string, payload string, n int"
ROWS = [
    ("work", "Developer", "junior", "2015-01-01", "2016-12-31"), (" WORK ", "Developer II", "mid", "2016-06-01", "2018-06-01"), ("work", "Engineer", "senior", "2019-01-01", "2020-01-01"),
    ("internship", "Engineer", "mid", "2020-03-01", "2020-09-01"), ("work", "Team Lead", "lead", "2021-01-01", None), ("work", "Ghost", "lead", "not-a-date", "2021-01-01"),
    ("skill", "Python", None, None, None), ("skill", "SQL", None, None, None), ("education", "MSc", None, None, None), ("hobby", "Chess", None, None, None),
]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(1, i, i, *r, None, 0) for i, r in enumerate(ROWS)] + [(2, 100, 1, "skill", "x", None, None, None, "{}", 0), (None, 101, 1, "work", "x", None, "2020", None, None, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_worked_case(spark, events):
    m = {r["resume_id"]: r for r in career.scores(career.metrics(events, "2022-01-01")).collect()}
    assert set(m) == {1, 2}
    r = m[1]
    want = {
        "num_jobs": 4, "years": 5.916010, "avg_months": 17.748029, "min_months": 6.044678, "max_months": 40.965834, "stability_index": 1.128271, "unique_roles": 3, "variety": 0.75, "promotions": 2, "demotions": 1,
        "skills": 2, "trend_slope": -5.594652, "correlation": -0.935373, "first_level": 1, "current_level": 4, "level_growth": 3, "gap_months": 13.009198, "growth": 46.428571, "stability": 86.990802, "skill": 8.451643,
        "direction": 70.0, "learning_velocity": 0.338066, "seniority": 43.788374, "momentum": 34.507453, "risk": 75.0,
    }
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-5), k
    none = m[2]
    assert none["num_jobs"] == 0 and none["skills"] == 1 and none["years"] is None and none["stability"] == 0.0 and none["trend_slope"] is None


def test_labels_and_nested_result(spark, events):
    r = {x["resume_id"]: x for x in career.analyze(events, "2022-01-01").collect()}[1]
    assert tuple(r["interpretation"]) == ("Moderate career progression", "Stable employment history", "Career growth momentum is weak", "High career risk")
    assert r["intelligence"]["growth"] == 46.43 and r["formula_version"] == "1.0.0"


def test_merge_keeps_the_first_and_open_ends(spark, events):
    m = career.merged_jobs(career.jobs(events, "2022-01-01")).orderBy("job_no").collect()
    assert [(r["title"], str(r["start_day"]), str(r["end_day"])) for r in m] == [("developer", "2015-01-01", "2018-06-01"), ("engineer", "2019-01-01", "2020-01-01"), ("engineer", "2020-03-01", "2020-09-01"), ("team lead", "2021-01-01", "None")]


def test_edges(spark):
    same = [(3, i, i, "work", "a", "x", "2010-01-01", "2010-01-01", None, 0) for i in range(5)]
    touch = [(4, 1, 1, "work", "a", "mid", "2010-01-01", "2011-01-01", "[1]", 0), (4, 2, 2, "work", "b", "vp", "2011-01-01", "2012-01-01", "{bad", 0)]
    df = spark.createDataFrame(same + touch, SCHEMA)
    m = {r["resume_id"]: r for r in career.metrics(df, "2022-01-01").collect()}
    assert m[3]["num_jobs"] == 1 and m[3]["years"] is None and m[3]["trend_slope"] is None
    assert m[4]["num_jobs"] == 1 and m[4]["promotions"] == 0
    sizes = {r["event_id"]: r["p"] for r in df.where("resume_id = 4").select("event_id", career.parse_payload(df["payload"]).alias("p")).collect()}
    assert sizes == {1: None, 2: {}}
    assert career.analyze(df.limit(0), "2022-01-01").count() == 0


def test_dates_of_any_form_and_late_deliveries(spark):
    """Any readable form counts, an unreadable end is not an open one, and of repeated deliveries the last holds."""
    from datetime import datetime

    rows = [
        (1, 1, 0, "work", "a", "mid", "03/2015", "31.12.2015", 1), (2, 1, 1, "Work", "b", "mid", "2016", "soon", 1), (3, 1, 2, "work", "c", "mid", "5 May 2017", "Present", 1), (4, 1, 3, "skill", "x", None, None, None, 1),
        (5, 1, 3, "skill", "x", None, None, None, 2), (6, 1, 2, "work", "c", "senior", "5 May 2017", "now", 2), (7, 1, None, "skill", "y", None, None, None, 1), (8, 1, None, "skill", "y", None, None, None, 1), (9, None, 0, "work", "a", "mid", "2015", "", 1),
    ]
    df = spark.createDataFrame([(*r[:8], "f", None, datetime(2024, 1, r[8])) for r in rows], "event_id bigint, resume_id bigint, event_seq int, type string, title string, level string, start_date string, end_date string, feed string, feed_zone string, ingested_at timestamp")
    got = {(r["event_id"], str(r["start_day"]), str(r["eff_end"]), r["level"]) for r in career.jobs(career.latest(df), "2025-01-01").collect()}
    assert got == {(1, "2015-03-01", "2015-12-31", "mid"), (6, "2017-05-05", "2025-01-01", "senior")}
    m = career.metrics(df, "2025-01-01").collect()
    assert len(m) == 1 and m[0]["skills"] == 3 and m[0]["num_jobs"] == 2
