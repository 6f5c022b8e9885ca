import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from vitalake.plans import registry


def level(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, data, name):
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(level(r[c]) for c in cols) for r in rows) == sorted(tuple(level(r[i]) for i in at) for r in rel.fetchall())
