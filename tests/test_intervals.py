import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from vitalake.operators import intervals

DAY0 = date(2000, 1, 1)


def brute(rows):
    out = set()
    by = {}
    for e, a, z in rows:
        if e is not None and a is not None and z is not None and a <= z:
            by.setdefault(e, []).append((a, z))
    for e, spans in by.items():
        merged = []
        for a, z in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out |= {(e, "period", str(a), str(z)) for a, z in merged}
        out |= {(e, "gap", str(x[1]), str(y[0])) for x, y in zip(merged, merged[1:])}
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(4000):
        e = 1 if rng.random() < 0.35 else rng.randrange(2, 60)  # one entity holds a third of the rows
        a = DAY0 + timedelta(days=rng.randrange(4000 if e > 1 else 9000))
        rows.append((e, a, a + timedelta(days=rng.choice([0, 0, 1, 2, 30, -3]))))
    rows += rows[:50] + [(None, DAY0, DAY0), (5, None, DAY0), (5, DAY0, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "who int, a date, z date, kind string")
    got = {tuple(r) for r in intervals.periods_and_gaps(df, "who", F.col("a"), F.col("z")).collect()}
    assert got == brute(rows)


def test_touching_days_do_not_merge(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "2020-01-05"), (1, "2020-01-06", "2020-01-09"), (1, "2020-01-09", "2020-01-10")], "e int, a string, z string")
    got = sorted(tuple(r)[1:] for r in intervals.periods_and_gaps(df, "e", F.col("a").cast("date"), F.col("z").cast("date")).collect())
    assert got == [("gap", "2020-01-05", "2020-01-06"), ("period", "2020-01-01", "2020-01-05"), ("period", "2020-01-06", "2020-01-10")]


def test_empty(spark):
    df = spark.createDataFrame([], "e int, a date, z date")
    assert intervals.periods_and_gaps(df, "e", F.col("a"), F.col("z")).count() == 0
