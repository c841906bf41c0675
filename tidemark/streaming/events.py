"""Streaming forms of the insert-only seen store and of the daily trend; each equals its batch form on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.state import upsert_seen


def first_seen(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark; state of older keys is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """(day, key, n) over tumbling windows of one day."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.to_date("w.start").alias("day"), key, "n")


def keep_seen(stream: DataFrame, path: str, checkpoint: str, key: str = "key") -> StreamingQuery:
    """Each micro-batch adds its unseen keys to the store at path; rows already there are never changed.

    A batch has a folder of its own, batch=N, that a retry of the same batch overwrites, and is compared with earlier batches only.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        seen = spark.read.parquet(path).filter(F.col("batch") < number).select(key) if there else batch.limit(0).select(key)
        fresh = upsert_seen(batch.limit(0), batch.join(seen, key, "left_anti"), key)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
