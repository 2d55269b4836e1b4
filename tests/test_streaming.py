from pyspark.sql import functions as F

from quire import streaming


def stream(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 00:{i:02d}:00") for i in range(0, 50, 4)] + [(7, "2024-01-01 03:00:00"), (7, "2024-01-01 03:00:00")]
    held = spark.createDataFrame(rows, "user int, at string").select("user", F.to_timestamp("at").alias("ts"))
    held.coalesce(1).write.parquet(str(tmp_path / "in"))
    return held, streaming.events(spark, str(tmp_path / "in"), "user int, ts timestamp")


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def test_windows_are_those_of_the_batch(spark, tmp_path):
    batch, live = stream(spark, tmp_path)
    for name, f in (("tumbling", streaming.tumbling), ("sliding", streaming.sliding)):
        assert drained(f(live), name, "complete") == sorted(tuple(r) for r in f(batch).collect())
    assert drained(streaming.sessions(live, "user"), "sessions", "complete") == sorted(tuple(r) for r in streaming.sessions(batch, "user").collect())


def test_repeats_go_once(spark, tmp_path):
    _, live = stream(spark, tmp_path)
    assert len(drained(streaming.without_repeats(live, ["user", "ts"]), "once", "append")) == 14
