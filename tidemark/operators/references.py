"""References to records that do not exist: direct orphans, and orphans inherited down the foreign-key graph.

A reference is direct-orphaned if no version of the record it names was there at the time of the referring row. A record
that itself holds a direct or inherited orphan of a required kind makes whatever refers to it an inherited orphan; the
cascade is iterated with semi-joins until it adds nothing.

Scale: the fact tables are exploded once and joined on the referenced key with a per-key array of validity intervals, so
each reference stays one row. The planner broadcasts that side only where its known size is under the threshold; beyond
it the join is a shuffle join, whose hot keys AQE splits (the interval side has one row per key, so splitting is safe).
The cascade runs over the dimension tables only; facts are read once more, at its end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


@dataclass(frozen=True)
class Reference:
    """table.field names target.id; at: the column with the row's time, or None for any time."""

    table: str
    key: str
    field: str
    target: str
    at: str | None = None
    period: str | None = None
    many: bool = False


def versions(target: DataFrame) -> DataFrame:
    """One row per id with all its (added_at, removed_at); a null added_at counts as always there."""
    return target.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("_ref")).agg(
        F.collect_set(F.struct(F.col("added_at").alias("a"), F.col("removed_at").alias("r"))).alias("_versions")
    )


def _alive(at: Column) -> Column:
    return F.exists(
        F.col("_versions"),
        lambda v: (v["a"].isNull() | at.isNull() | (v["a"] <= at)) & (v["r"].isNull() | at.isNull() | (v["r"] > at)),
    )


def exploded(rows: DataFrame, ref: Reference) -> DataFrame:
    """(key, ref_id, at, period): one row per reference that is neither null nor empty; repeated rows and elements once."""
    value = F.explode(F.array_distinct(F.col(ref.field))) if ref.many else F.col(ref.field)
    at = F.col(ref.at) if ref.at else F.lit(None).cast("timestamp")
    period = F.date_format(F.col(ref.period), "yyyy-MM") if ref.period else F.lit(None).cast("string")
    return (
        rows.select(F.col(ref.key).cast("string").alias("key"), value.alias("ref_id"), at.alias("at"), period.alias("period"))
        .filter(F.col("key").isNotNull() & F.col("ref_id").isNotNull() & (F.col("ref_id") != ""))
    )


def direct_orphans(rows: DataFrame, target: DataFrame, ref: Reference) -> DataFrame:
    """(tbl, key, field, ref_id, period, kind='direct', depth=0); a key that occurs in several equal rows comes out once."""
    joined = exploded(rows, ref).join(versions(target).withColumnRenamed("_ref", "ref_id"), "ref_id", "left")
    gone = joined.filter(F.col("_versions").isNull() | ~_alive(F.col("at")))
    return (
        gone.groupBy("key", "ref_id")
        .agg(F.min("period").alias("period"))
        .select(F.lit(ref.table).alias("tbl"), "key", F.lit(ref.field).alias("field"), "ref_id", "period", F.lit("direct").alias("kind"), F.lit(0).alias("depth"))
    )


def orphan_cascade(tables: dict[str, DataFrame], refs: list[Reference], rounds: int = 1000) -> DataFrame:
    """All orphans of all references: direct ones, and those inherited because the named record is itself orphaned.

    Tables that some reference targets are iterated to the fixpoint; the others are children only and join its result
    once. A reference that is direct is not listed as inherited as well. Cycles end, as a record is orphaned only once.
    """
    targets = {r.target for r in refs}
    spark = next(iter(tables.values())).sparkSession
    # written once: they are read for the first round, for the result and to tell inherited ones from them
    direct = {r: stored(direct_orphans(tables[r.table], tables[r.target], r), "direct") for r in refs}
    inner = [r for r in refs if r.table in targets]
    empty = spark.createDataFrame([], "tbl string, key string, depth int")
    bad = empty
    for r in inner:
        bad = bad.unionByName(direct[r].select("tbl", "key", "depth"))
    bad = stored(bad.groupBy("tbl", "key").agg(F.min("depth").alias("depth")), "orphans")
    edges = None
    for r in inner:
        e = exploded(tables[r.table], r).select(F.lit(r.table).alias("tbl"), "key", F.lit(r.target).alias("ptbl"), F.col("ref_id").alias("pkey"))
        edges = e if edges is None else edges.unionByName(e)
    if edges is not None:
        edges = stored(edges.distinct(), "edges")
        frontier = bad
        for depth in range(1, rounds + 1):
            parents = frontier.select(F.col("tbl").alias("ptbl"), F.col("key").alias("pkey"))
            new = edges.join(parents, ["ptbl", "pkey"], "left_semi").select("tbl", "key").distinct()
            new = stored(new.join(bad, ["tbl", "key"], "left_anti").withColumn("depth", F.lit(depth)), "orphans")
            if new.isEmpty():
                break
            frontier, bad = new, stored(bad.unionByName(new), "orphans")
        else:
            raise RuntimeError(f"orphan_cascade: orphans still found after {rounds} rounds")
    out = None
    for r in refs:
        lost = bad.filter(F.col("tbl") == r.target).select(F.col("key").alias("ref_id"), F.col("depth").alias("_d"))
        inherited = exploded(tables[r.table], r).join(lost, "ref_id").groupBy("key", "ref_id").agg(F.min("period").alias("period"), F.min("_d").alias("_d"))
        inherited = inherited.join(direct[r].select("key", "ref_id"), ["key", "ref_id"], "left_anti").select(
            F.lit(r.table).alias("tbl"), "key", F.lit(r.field).alias("field"), "ref_id", "period", F.lit("inherited").alias("kind"), (F.col("_d") + 1).alias("depth")
        )
        both = direct[r].unionByName(inherited)
        out = both if out is None else out.unionByName(both)
    return out


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(tbl, field, period, kind, n_refs, n_rows)"""
    return orphans.groupBy("tbl", "field", "period", "kind").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("key").alias("n_rows"))
