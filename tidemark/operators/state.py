"""State kept between runs: seen keys, snapshots, reuse of earlier results, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_seen(seen: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The seen store after new rows: insert only, what was there stays as first seen. Of new rows with equal key one is kept."""
    return seen.unionByName(new.join(seen.select(key), key, "left_anti").dropDuplicates([key]).select(*seen.columns))


def flag_new(rows: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    mark = seen.select(key).distinct().withColumn("_s", F.lit(True))
    return rows.join(mark, key, "left").withColumn("is_new", F.col("_s").isNull()).drop("_s")


def snapshot_diff(current: DataFrame, previous: DataFrame, source: str = "source_id", key: str = "key") -> DataFrame:
    """Keys new since the last snapshot; a source without a snapshot only sets its baseline and gives none."""
    based = previous.select(source).distinct()
    return current.select(source, key).distinct().join(based, source, "left_semi").join(previous, [source, key], "left_anti")


def replace_snapshot(previous: DataFrame, current: DataFrame, ok_sources: DataFrame, source: str = "source_id") -> DataFrame:
    """The snapshot table after a run: rows of sources that succeeded are replaced, others kept."""
    return previous.join(ok_sources.select(source), source, "left_anti").unionByName(current.select(*previous.columns).distinct())


def reuse(rows: DataFrame, earlier: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column from the earlier run where it has one, else their own."""
    e = earlier.select(key, F.col(column).alias("_e")).dropDuplicates([key])
    return rows.join(e, key, "left").withColumn(column, F.coalesce("_e", column)).withColumn("reused", F.col("_e").isNotNull()).drop("_e")


def last_feedback(events: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The last value per key; keys whose last value is null or empty are gone (a repeated toggle deletes)."""
    return events.groupBy(key).agg(F.max_by(F.struct(value), F.struct(at, value)).alias("_x")).select(key, F.col(f"_x.{value}").alias(value)).filter(F.coalesce(value, F.lit("")) != "")
