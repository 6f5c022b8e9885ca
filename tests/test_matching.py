import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalake.config import MatchConfig
from vitalake.functions import scorers
from vitalake.operators import matching

TAX = [("occ/1", "Software Engineer", '["software developer","programmer"]', 1), ("occ/2", "Data Scientist", "data analyst;programmer", 2), ("occ/3", "Product Manager", None, 3), ("occ/3", "Product Manager", None, 4)]
RATIO = MatchConfig(scorer="ratio")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=14), st.text("abcé ", max_size=14))
def test_ratio_against_the_table_method(a, b):
    want = 200 * lcs(a, b) / (len(a) + len(b)) if a and b else 0
    assert scorers.ratio(a, b) == pytest.approx(want)
    for f in scorers.SCORERS.values():
        assert 0 <= f(a, b) <= 100


def test_known_scores():
    assert scorers.ratio("softwere ingineer", "software engineer") == pytest.approx(88.2353, abs=1e-4)
    assert scorers.ratio("data scientest", "data scientist") == pytest.approx(92.8571, abs=1e-4)
    assert scorers.token_sort_ratio("b a", "a b") == 100 and scorers.token_set_ratio("a b b", "a b c") == 100 and scorers.partial_ratio("abc", "xxabcxx") == 100
    assert scorers.scorer("nonsense") is scorers.weighted_ratio


@pytest.fixture(scope="module")
def resolved(spark):
    titles = ["softwere ingineer", "data scientest", "product manajer", "software engineer", "software-engineer", "software  engineer", "", "quantum potato architect", "Programmer", "data analyst", None, "x" * 300, "software engineers"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    tax = spark.createDataFrame(TAX, "uri string, preferred_label string, alt_labels string, rec_seq int")
    return {r["id"]: r for r in matching.resolve(df, "id", F.col("title"), tax, RATIO).collect()}


def test_cascade(resolved):
    assert len(resolved) == 13
    want = {0: ("review", "occ/1", 88.24, 0.8547), 1: ("review", "occ/2", 92.86, 0.876), 12: ("review", "occ/1", 97.14, 0.9225)}
    for i, (status, uri, sim, conf) in want.items():
        r = resolved[i]
        assert (r["status"], r["uri"], r["similarity"], r["confidence"], r["match_type"]) == (status, uri, sim, conf, "fuzzy")
    for i in (3, 4, 5):
        assert (resolved[i]["status"], resolved[i]["uri"], resolved[i]["confidence"], resolved[i]["match_type"]) == ("accepted", "occ/1", 1.0, "exact")
    for i in (2, 6, 7, 10):
        assert resolved[i]["status"] == "unresolved" and resolved[i]["similarity"] == 0 and resolved[i]["standardized"] is None
    assert resolved[8]["status"] == "ambiguous" and resolved[8]["standardized"] is None and len(resolved[8]["alternatives"]) == 2
    assert resolved[9]["match_type"] == "alias" and resolved[9]["uri"] == "occ/2"
    assert "longer" in resolved[11]["error"]


def test_confidence_and_ttl(spark):
    rows = [(95.0, 10.0, 0.8375), (95.0, 5.0, 0.775), (80.0, 3.0, 0.6375), (74.99, 74.99, 0.8124)]
    df = spark.createDataFrame(rows, "s double, m double, want double")
    assert df.where(matching.confidence(F.col("s"), F.col("m")) != F.col("want")).count() == 0
    t = spark.createDataFrame([("unresolved",), ("ambiguous",), ("review",), ("accepted",)], "s string").select(matching.ttl(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in t] == [300, 300, 3600, 3600]


def test_cache_key(spark):
    text = '{"limit": 5, "query": "data scientist", "threshold": 70.0, "version": "v1"}'
    got = spark.range(1).select(matching.cache_key(F.lit("data scientist")).alias("k")).collect()[0]["k"]
    assert got == "occupation:v1:" + hashlib.sha256(text.encode()).hexdigest() and got.endswith("17e37b2ce7923485c0e28763f4c22ec9adecb0355fe031103623dca779407792")


def test_normalise(spark):
    df = spark.createDataFrame([("ﬁ Straße",), ("é-_a!b",), (None,)], "t string").select(matching.normalise("t").alias("n")).collect()
    assert [r["n"] for r in df] == ["fi strasse", "é _a b", None]


def test_empty_tables_and_settings(spark):
    tax = spark.createDataFrame([], "uri string, preferred_label string, alt_labels string, rec_seq int")
    df = spark.createDataFrame([(1, "a b")], "id int, title string")
    assert matching.resolve(df, "id", F.col("title"), tax, RATIO).collect()[0]["status"] == "unresolved"
    assert matching.resolve(df.limit(0), "id", F.col("title"), tax, RATIO).count() == 0
    with pytest.raises(ValueError):
        MatchConfig(review_threshold=95.0)
    with pytest.raises(ValueError):
        MatchConfig(label_weight=0.0, alias_weight=0.0)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdé ", min_size=1, max_size=10), st.lists(st.text("abcdé ", min_size=1, max_size=10), max_size=30, unique=True))
def test_bound_loses_nothing(q, texts):
    texts = sorted(texts)
    want = sorted((-scorers.ratio(q, t), t) for t in texts)[:5]
    assert matching._Bound(texts).best(q, 5) == want


def test_best_scores_against_scoring_every_text():
    r = random.Random(2)
    pool = "senior junior data engineer engineering manager nurse cook chef de partie system systems analyst ingenieur ärztin of the head".split()
    texts = sorted({" ".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(150)} | {"cook cook", "a", "x" * 90})
    queries = [" ".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(30)] + ["enginer data", "cook", "nurse nurse nurse", "zzz", "data " * 20, "ë"]
    queries += ["".join(c for c in x if r.random() > 0.15).strip() or "a" for x in r.sample(texts, 30)]
    for score in (scorers.ratio, scorers.weighted_ratio):
        bound = matching._Bound(texts, score)
        for q in queries:
            every = sorted((-score(q, t), t) for t in texts)
            most = bound.bounds(q)
            assert all(score(q, t) <= m + 1e-9 for t, m in zip(texts, most)), q
            assert bound.best(q, 7) == every[:7]
            assert [x for x in bound.best(q, 7, 70.0) if x[0] <= -70] == [x for x in every[:7] if x[0] <= -70]


def test_registered_queries_use_the_default_scorer(spark, monkeypatch):
    from vitalake.plans import reference

    tables = {
        "resolution_results": spark.createDataFrame([(1, "engineer, software (senior)")], "result_id bigint, input string"),
        "occupations": spark.createDataFrame([("occ/1", "software engineer", '["software engineer senior grade"]', 1)], "uri string, preferred_label string, alt_labels string, rec_seq int"),
    }
    monkeypatch.setattr(reference, "table", lambda spark, d, name: tables[name])
    got = reference.occ_resolve(spark, "").collect()[0]
    assert got["uri"] == "occ/1" and got["match_type"] == "fuzzy"


def test_aliases_equal_to_the_label_and_ties(spark):
    tax = spark.createDataFrame([("o/1", "data engineer", '["data engineer"]', 1, "25"), ("o/2", "abcdef one", None, 2, None), ("o/3", "abcdef two", None, 3, None)], "uri string, preferred_label string, alt_labels string, rec_seq int, isco_code string")
    df = spark.createDataFrame([(1, "data enginer"), (2, "abcdef")], "id int, title string")
    got = {r["id"]: r for r in matching.resolve(df, "id", F.col("title"), tax, RATIO, threshold=50.0).collect()}
    assert (got[1]["status"], got[1]["uri"], got[1]["similarity"], got[1]["isco_code"], got[1]["source"]) == ("accepted", "o/1", 96.0, "25", "database")
    # equal scores: the label that comes last in the alphabet first
    low = {r["id"]: r for r in matching.resolve(df, "id", F.col("title"), tax, RATIO, threshold=40.0).collect()}[2]
    assert low["uri"] == "o/3" and [a["uri"] for a in low["alternatives"]] == ["o/2"] and low["second_best_similarity"] == 75.0
    assert [len(r["alternatives"]) for r in matching.resolve(df, "id", F.col("title"), tax, RATIO, threshold=40.0, limit=1).where("id = 2").collect()] == [0]


def test_cache(spark, tmp_path):
    tax = spark.createDataFrame(TAX, "uri string, preferred_label string, alt_labels string, rec_seq int")
    df = spark.createDataFrame([(1, "software engineer"), (2, "Software-Engineer"), (3, "quantum potato"), (4, None)], "id int, title string")
    out, entries = matching.resolve_cached(df, "id", F.col("title"), tax, None, RATIO)
    assert {(r["id"], r["uri"], r["cache_hit"]) for r in out.collect()} == {(1, "occ/1", False), (2, "occ/1", False), (3, None, False), (4, None, False)}
    entries.write.parquet(str(tmp_path / "cache"))
    kept = spark.read.parquet(str(tmp_path / "cache"))
    assert kept.count() == 3 and {round((r["expires_at"] - r["resolved_at"]).total_seconds()) for r in kept.collect()} == {300, 3600}
    more = df.unionByName(spark.createDataFrame([(5, "data analyst")], "id int, title string"))
    out, entries = matching.resolve_cached(more, "id", F.col("title"), tax, kept, RATIO)
    assert {(r["id"], r["uri"], r["cache_hit"]) for r in out.collect()} == {(1, "occ/1", True), (2, "occ/1", True), (3, None, True), (4, None, True), (5, "occ/2", False)}
    assert entries.count() == 1 and {(r["status"], r["cache_hits"], r["cache_misses"]) for r in matching.summary(out).groupBy("status").agg(F.sum("cache_hits").alias("cache_hits"), F.sum("cache_misses").alias("cache_misses")).collect()} == {("accepted", 2, 1), ("unresolved", 2, 0)}
    late = kept.withColumn("expires_at", F.current_timestamp() - F.expr("interval 1 second"))
    assert not [r for r in matching.resolve_cached(df, "id", F.col("title"), tax, late, RATIO)[0].collect() if r["cache_hit"]]
