from pyspark.sql import functions as F

from tidemark.streaming import events as E

DATA = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path, df):
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(spark, q, name, mode):
    w = q.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    w.awaitTermination()
    return spark.table(name)


def test_first_seen_and_trend_equal_batch(spark, tmp_path):
    ev = spark.read.parquet(DATA).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    s = stream(spark, tmp_path, ev)
    got = run(spark, E.first_seen(s, ["user_id", "event_type"], "ts", "365 days"), "seen_t", "append")
    want = ev.select("user_id", "event_type").distinct()
    assert got.count() == want.count() and got.select("user_id", "event_type").exceptAll(want).count() == 0
    trend = run(spark, E.daily_counts(s, "event_type", "ts", "365 days"), "trend_t", "complete")
    batch = ev.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert trend.exceptAll(batch).count() == 0 and batch.exceptAll(trend).count() == 0


def test_keep_seen_is_insert_only(spark, tmp_path):
    a = spark.createDataFrame([("k1", 1), ("k2", 1)], "key string, first int")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    a.write.parquet(path)
    s = spark.readStream.schema(a.schema).parquet(path)
    E.keep_seen(s, out, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("k1", 2), ("k3", 2)], "key string, first int").write.mode("append").parquet(path)
    E.keep_seen(s, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).drop("batch").collect())) == [("k1", 1), ("k2", 1), ("k3", 2)]
