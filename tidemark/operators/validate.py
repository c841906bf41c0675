"""Invariants of a run as one table of violation counts. Every check is an aggregate; rows only meet on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
EVENT_TYPES = ("quality_supply", "customer_demand", "partnership_deal", "clinical_regulatory", "market_activity", "regional_expansion", "product_platform", "target_therapy", "corporate_strategy")
TIERS = ("immediate", "daily", "archive")


def _repeats(df: DataFrame, key: str, name: str) -> DataFrame:
    g = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("chk"), "n")


def _orphans(refs: DataFrame, target: DataFrame, name: str) -> DataFrame:
    r = refs.filter("id is not null and id <> ''")
    return r.join(target.select("id").distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("chk"), "n")


def violations(s: DataFrame, sources: DataFrame, companies: DataFrame) -> DataFrame:
    """(chk, n): the number of violations of each check; all zero for a sound run."""
    scalar = s.agg(
        F.count_if(F.col("business_event_type").isNull() | ~F.col("business_event_type").isin(*EVENT_TYPES)).alias("event_type_enum"),
        F.count_if(F.col("tier").isNull() | ~F.col("tier").isin(*TIERS)).alias("tier_enum"),
        F.count_if(F.col("score") < 0).alias("negative_score"),
        F.count_if((F.col("relevance") == "low") & (F.col("tier") != "archive")).alias("low_in_feed"),
    )
    names = scalar.columns
    long = scalar.select(F.explode(F.array(*[F.struct(F.lit(c).alias("chk"), F.col(c).alias("n")) for c in names])).alias("x")).select("x.*")
    ids = lambda c: s.select(F.explode(F.array_distinct(c)).alias("id"))
    parts = [
        _repeats(s, "seq", "duplicate_ids"), _repeats(s, "url", "duplicate_urls"), _repeats(sources, "id", "duplicate_sources"),
        _orphans(ids("matched_company_ids"), companies, "orphan_companies"), _orphans(ids("source_ids"), sources, "orphan_sources"),
        _orphans(companies.select(F.col("parent_company_id").alias("id")), companies, "unknown_parents"),
    ]
    for p in parts:
        long = long.unionByName(p)
    return long
