from pyspark.sql import functions as F

from vitalake.streaming import streams


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(1, "work,a,,,,", 0, 9), (1, "work", 5, 20), (2, "hobby,a,,,,", 30, 31), (1, "work,b,,,,", 40, 41), (1, None, None, None)]
    df = spark.createDataFrame(rows, "who int, line string, d0 int, d1 int").withColumn("at", F.timestamp_seconds(F.col("d0") * 86400))
    df.coalesce(1).write.parquet(path)
    live = lambda: streams.table_stream(spark, path, df.schema)
    got = drain(streams.judged_records(live(), "line").select("line", "reason"), "judged", "append")
    assert sorted(str(r["reason"]) for r in got) == ["None", "None", "column_count", "column_count", "type"]
    got = drain(streams.processed_texts(live(), "line").select("processed"), "texts", "append")
    assert len(got) == 5
    got = drain(streams.windowed_counts(live(), "at", F.col("who"), "10 days"), "counts", "complete")
    assert sum(r["n"] for r in got) == 4
    got = {r["who"]: tuple(r)[1:] for r in drain(streams.running_periods(live(), "who"), "periods", "update")}
    assert got == {1: (2, 23), 2: (1, 2)}
