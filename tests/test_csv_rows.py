from vitalake.operators import csv_rows as c

OK = "work,Engineer,mid,2020-01-01,,{}"
CASES = {
    OK: None, OK + "\r": None, ' WORK ,"a, b",,,,"{""k"": 1}"': None, 'skill,"two\nlines",,,,': None, 'work,a "quoted" word,,,,': None, '"work","say ""hi""",,,,""': None,
    'work,"open,,,,': "quoting", 'work,"a"b,,,,': "quoting", 'work,"a" ,,,,': "quoting", 'work,a,,,,"': "quoting",
    "work,a,,,": "column_count", "work,a,,,,,": "column_count", "": "column_count",
    "hobby,a,,,,": "type", ",a,,,,": "type", '"",a,,,,': "type", "hobby,a,,,,[1]": "type",
    "work,a,,,,[1]": "payload", "work,a,,,,42": "payload", 'work,a,,,,"{""a"": 1} x"': "payload", 'work,a,,,,"{\'a\': 1}"': "payload", 'work,a,,,,"{""a"": NaN}"': "payload", 'work,a,,,,"{""a"": 1,}"': "payload",
    "work,a,,,,   ": None, 'work,a,,,,"{""a"": {""b"": [1, null]}}"': None,
    'work,"' + "x,y" * 50_000 + '",,,,': None, 'work,"' + '""' * 20_000 + '",,,,': None,
    "," * 30_000: "column_count", 'work,"' + "," * 30_000 + '",,,,': None, "work,a\nb,,,,": None, "work,a\n": "column_count", "   ": "column_count", 'work,"a""",b,,,': None, 'work,"a"",b,,,': "quoting", "work,a,,,,\r\r": None, "#work,a,,,,": "type", "work,\\,,,,": None, 'work,"\\",,,,': None,
}


def test_reasons_and_values(spark):
    rows = [(i, line, "clash", "clash") for i, line in enumerate(CASES)] + [(999, None, None, None), (1000, OK, None, None)]
    df = spark.createDataFrame(rows, "id int, line string, type string, corrupt_note string")
    got = {r["id"]: r for r in c.judge_records(df, "line").collect()}
    assert [got[i]["reason"] for i in range(len(CASES))] == list(CASES.values())
    assert got[999]["reason"] == "column_count" and got[1000]["reason"] is None
    by = {line: got[i] for i, line in enumerate(CASES)}
    assert by['skill,"two\nlines",,,,']["record"]["title"] == "two\nlines"
    assert by['"work","say ""hi""",,,,""']["record"]["title"] == 'say "hi"'
    assert by[' WORK ,"a, b",,,,"{""k"": 1}"']["record"]["payload"] == '{"k": 1}'
    assert by["hobby,a,,,,"]["record"] is None and by["hobby,a,,,,"]["corrupt"] == "hobby,a,,,,"
    assert got[0]["type"] == "clash"
    assert by['work,"' + "," * 30_000 + '",,,,']["record"]["title"] == "," * 30_000 and by["work,a\nb,,,,"]["record"]["title"] == "a\nb" and by['work,"a""",b,,,']["record"]["title"] == 'a"'
    assert by["work,a,,,"]["corrupt"] == "work,a,,,"


def test_empty_table(spark):
    assert c.judge_records(spark.createDataFrame([], "line string"), "line").count() == 0


def test_the_parser_takes_part(spark):
    df = spark.createDataFrame([(1, OK)], "id int, line string")
    plan = c.judge_records(df, "line").where("reason is not null").select("id", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_csv" in plan
