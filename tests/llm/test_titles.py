import pytest

from vitalake.llm import titles as t

OCC = [
    ("o/1", "Harbour Crane Operator", '["Port Hoisting Operator", "Hafenkranbediener"]', 1, "x"), ("o/1", "Harbour Crane Operator", '["Port Hoisting Operator", "Hafenkranbediener"]', 2, "x"), ("o/2", "Harbour Crane Analyst", "Port Hoisting Analyst|Team Lead", 3, "x"),
    ("o/3", "Soil Chemistry Trainer", "Ground Analysis Trainer ; Team Lead", 4, None), ("o/4", "Court Language Supervisor", None, 5, None), ("o/5", "Soil Chemistry Department Head", "", 6, None), (None, "Ghost", "a", 7, None), ("o/6", None, "[]", 8, None),
]
CASES = {
    "Harbour Crane Operator": "o/1", "  harbour   crane operators ": "o/1", "HARBOUR CRANE OP.": "o/1", "Oper@tor - H4rbour Cr4ne": "o/1", "hARBOURcRANEoPERATOR": "o/1", "HarbourCraneOperator": "o/1", "harbourcraneoperator": "o/1", "Hrbr Crn Oprtr": "o/1", "Harbuor Cranne Operater": "o/1",
    "Hаrbоur Crаnе Operator": "o/1", "Ｈａｒｂｏｕｒ Ｃｒａｎｅ Ａｎａｌｙｓｔ": "o/2", "Senior Harbour Crane Analyst (m/f/d), part-time": "o/2", "Analyst for harbour crane @ Pebble & Reed": "o/2", "Hafenkranbedienerin": "o/1", "hafnkranbedienr": "o/1", "Port_Hoisting_Analyst_/_7_yrs": "o/2",
    "team-lead": "ambiguous", "TEAM LEAD": "ambiguous", "Soil Chemistry Supv.": "none", "Court Language Supv.": "o/4", "Sl Chmstry Dprtmnt Hd": "o/5", "Harbour Crane Poet": "none", "Volcano Operator": "none", "???": "none", "x" * 5000: "none", "y" * 300_000: "none", "Port Hoisting Operator " + "z " * 20_000: "o/1", "Soil Chemistry Critic": "none",
}


def test_titles(spark):
    ref = spark.createDataFrame(OCC, "uri string, preferred_label string, alt_labels string, rec_seq int, title string")
    rows = [(i, x, "clash", "clash") for i, x in enumerate(CASES)] + [(900, None, "", ""), (901, "  \t", "", ""), (902, "Team Lead", "", ""), (902, "Team Lead", "", "")]
    df = spark.createDataFrame(rows, "id bigint, typed string, uri string, entry string")
    got = t.resolve(df, "id", "typed", ref, "uri", "preferred_label", "alt_labels").collect()
    by = {r["id"]: r["uri"] for r in got}
    assert {x: by[i] for i, x in enumerate(CASES)} == CASES
    assert 900 not in by and 901 not in by and sum(r["id"] == 902 for r in got) == 2
    assert t.resolve(df.limit(0), "id", "typed", ref, "uri", "preferred_label", "alt_labels").count() == 0
    assert {r["uri"] for r in t.resolve(df, "id", "typed", ref.limit(0), "uri", "preferred_label", "alt_labels").collect()} == {"none"}


@pytest.mark.parametrize("a,b,want", [("abc", "abc", 0), ("abc", "acb", 1), ("abcd", "abxd", 1), ("ab", "abcde", 3), ("kitten", "sitting", 3)])
def test_distance(a, b, want):
    assert t.distance(a, b, 5) == want


def test_join_keys_meet_within_two_edits():
    words = ["supervisor", "crane", "technician", "kiln", "thermodynamics", "qualitätssicherung", "straßenbahnbetriebshofleiter", "donaudampfschifffahrtselektrizitätenhauptbetriebswerk", "ab" * 60 + "cd" * 60]
    for w in words:
        ref = t.keys(w, True)
        for i in range(len(w)):
            for j in range(i):
                assert t.keys(w[:j] + w[j + 1 : i] + w[i + 1 :], False) & ref
            assert t.keys(w[:i] + "q" + w[i + 1 :], False) & ref
            for j in {0, i // 2, i, len(w) - 1}:
                assert t.keys(w[:j] + "q" + w[j:i] + "x" + w[i:], False) & ref or j > i


def test_both_rankings_agree(spark, monkeypatch):
    ref = spark.createDataFrame(OCC, "uri string, preferred_label string, alt_labels string, rec_seq int, title string")
    df = spark.createDataFrame(list(enumerate(CASES)), "id bigint, typed string")
    one = {tuple(r)[:3] for r in t.resolve(df, "id", "typed", ref, "uri", "preferred_label", "alt_labels").collect()}
    monkeypatch.setattr(t, "MOST_ENTRIES", 1)
    two = {tuple(r)[:3] for r in t.resolve(df, "id", "typed", ref, "uri", "preferred_label", "alt_labels").collect()}
    assert one == two
