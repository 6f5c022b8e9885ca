import yaml

from vitalake import cli
from vitalake.functions import scorers

GOOD = "events_csv: |\n  type,title,level,start_date,end_date,payload\n  work,Developer,junior,2015-01-01,2016-12-31,\n  work,Engineer,senior,2019-01-01,,\n"


def test_documents(spark):
    out, code = cli.run(GOOD, "2022-01-01", spark)
    doc = yaml.safe_load(out)[0]
    assert code == 0 and doc["raw_metrics"]["num_jobs"] == 2 and doc["raw_metrics"]["promotions"] == 1
    for bad in ("- 1", "events_csv: |\n  type,title\n  a,b,c\n", "{", ""):
        out, code = cli.run(bad, "2022-01-01", spark)
        assert code == 1 and yaml.safe_load(out)["error"]["message"], bad


def test_scorers_from_sql(spark):
    assert set(scorers.register(spark)) == {"sim_ratio", "sim_partial_ratio", "sim_token_sort_ratio", "sim_token_set_ratio", "sim_wratio"}
    row = spark.sql("select sim_ratio('data scientest', 'data scientist') a, sim_wratio('b a', 'a b') b, sim_ratio(null, 'x') c").collect()[0]
    assert round(row["a"], 4) == 92.8571 and row["b"] == 95.0 and row["c"] is None
