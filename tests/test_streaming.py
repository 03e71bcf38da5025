import datetime as dt

from siftwork.streaming import ingest


def test_streams(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [("a", "x", t, 1), ("a", "x", t + dt.timedelta(days=3), 2), ("b", None, t + dt.timedelta(days=8), 3), ("c", " ", None, 4), (None, "y", t, 5)]
    source = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "k string, txt string, at timestamp, n long")
    df.coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(df.schema).parquet(source)

    q = ingest.append_to(ingest.distinct_records(read(), "k", "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r["k"] or "") for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "a", "b"]

    q = ingest.newest_per_key(read(), "k", "n").writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["k"]: r["n"] for r in spark.table("newest").collect()} == {"a": 2, "b": 3, "c": 4}

    q = ingest.windowed_counts(read(), "at", "k", "txt").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("counts").collect()) == 4
