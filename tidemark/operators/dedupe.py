"""Greedy de-duplication in feed order.

A row repeats an earlier leader if it has its address, or else its title key of 30 characters or more; only leaders can be
repeated. The rows that can influence each other are the connected components of shared keys; each component is replayed in
order. Components are found without gathering anything, and rows that share no key never reach Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators.components import components
from tidemark.session import stored

LEAST_TITLE = 30


def keyed(rows: DataFrame, seq: str, url: str, title: str) -> DataFrame:
    t = X.title_key(F.col(title))
    return rows.select(F.col(seq).cast("long").alias("seq"), U.normalize_url(F.col(url)).alias("u"), F.when(F.length(t) >= LEAST_TITLE, t).alias("t"))


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    by_url: dict[str, int] = {}
    by_title: dict[str, int] = {}
    leaders = []
    for seq, u, t in zip(pdf["seq"], pdf["u"], pdf["t"]):
        lead = by_url.get(u) if u is not None else None
        if lead is None and t is not None:
            lead = by_title.get(t)
        if lead is None:
            lead = seq
            if u is not None:
                by_url[u] = seq
            if t is not None:
                by_title[t] = seq
        leaders.append(lead)
    return pd.DataFrame({"seq": pdf["seq"].values, "leader": leaders}).astype("int64")


def leaders(rows: DataFrame, seq: str = "seq", url: str = "url", title: str = "title") -> DataFrame:
    """(seq, leader): for each row the row it repeats, itself if it is a leader. Null addresses and short titles repeat nothing."""
    k = stored(keyed(rows, seq, url, title), "keys")

    def star(key: str) -> DataFrame:
        least = k.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("a"), F.max("seq").alias("_m")).filter("a <> _m").drop("_m")
        return k.join(least, key).filter("seq <> a").select("a", F.col("seq").alias("b"))

    comp = components(star("u").unionByName(star("t")))
    many = k.join(comp.withColumnRenamed("id", "seq"), "seq")
    done = many.groupBy("root").applyInPandas(_replay, "seq long, leader long")
    alone = k.join(comp.select(F.col("id").alias("seq")), "seq", "left_anti").select("seq", F.col("seq").alias("leader"))
    return alone.unionByName(done)


def merged(rows: DataFrame, lead: DataFrame) -> DataFrame:
    """A row per leader: union of sources and companies in order of arrival, longest summary, first date, number of rows.

    rows: seq, company_id, source_ids, summary, published. Of summaries of equal length the first wins.
    """
    r = rows.join(lead, "seq")
    arr = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    in_order = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("o"), c.alias("v")))), lambda x: x["v"])))
    own = F.when(F.coalesce("company_id", F.lit("")) != "", F.array("company_id")).otherwise(F.array().cast("array<string>"))
    return r.groupBy("leader").agg(
        F.count(F.lit(1)).alias("n_rows"),
        in_order(arr(F.col("source_ids"))).alias("source_ids"),
        in_order(own).alias("company_ids"),
        F.max_by(F.coalesce("summary", F.lit("")), F.struct(F.length(F.coalesce("summary", F.lit(""))), -F.col("seq"))).alias("summary"),
        F.min_by(F.when(F.coalesce("published", F.lit("")) != "", F.col("published")), F.when(F.coalesce("published", F.lit("")) != "", F.col("seq"))).alias("published"),
    )


def best_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by order, by a single hash aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return g.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])
