"""Gates and filters on signals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dates as D
from tidemark.session import small_side


def source_gate(rows: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """rows that pass their source's gate: enabled, required address terms, no excluded title term, a date where one is required, not too old.

    rows: source_id, title, url, pub (date). Rows of unknown sources are dropped; null term lists and limits let pass; a
    row without a date has no age and passes the age limit.
    """
    dim = sources.select(
        F.col("id").alias("source_id"), "enabled", "include_url_terms", "exclude_title_terms", "require_published", "max_age_days"
    ).dropDuplicates(["source_id"])
    low_u, low_t = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    inc, exc = F.coalesce("include_url_terms", F.array().cast("array<string>")), F.coalesce("exclude_title_terms", F.array().cast("array<string>"))
    ok = (
        F.coalesce("enabled", F.lit(True))
        & ((F.size(inc) == 0) | F.exists(inc, lambda t: F.coalesce(low_u.contains(F.lower(t)), F.lit(False))))
        & ~F.exists(exc, lambda t: F.coalesce(low_t.contains(F.lower(t)), F.lit(False)))
        & (~F.coalesce("require_published", F.lit(False)) | F.col("pub").isNotNull())
        & (F.col("max_age_days").isNull() | F.col("pub").isNull() | (D.age_days(F.col("pub"), as_of) <= F.col("max_age_days")))
    )
    return rows.join(small_side(dim), "source_id").filter(ok).select(*rows.columns)


def limit_per_source(rows: DataFrame, sources: DataFrame, order: str) -> DataFrame:
    """The first max_items rows of each source in feed order; sources without a limit give all, so only limited ones are sorted."""
    dim = sources.select(F.col("id").alias("source_id"), "max_items").dropDuplicates(["source_id"])
    r = rows.join(small_side(dim), "source_id", "left")
    w = Window.partitionBy("source_id").orderBy(order)
    some = r.filter("max_items is not null").withColumn("_n", F.row_number().over(w)).filter("_n <= max_items").drop("_n")
    return r.filter("max_items is null").unionByName(some).drop("max_items")


@dataclass
class SignalQuery:
    """The facets of a dashboard query; an empty facet does not restrict. A focused source switches the date window off."""

    as_of: str
    days: int | None = 30
    tiers: list[str] = field(default_factory=list)
    relevance: list[str] = field(default_factory=list)
    signal_types: list[str] = field(default_factory=list)
    event_types: list[str] = field(default_factory=list)
    company: str | None = None
    source: str | None = None
    text: str = ""

    def apply(self, s: DataFrame) -> DataFrame:
        as_of = F.to_date(F.lit(self.as_of))
        out = s
        if self.source:
            out = out.filter(F.array_contains("source_ids", self.source))
        elif self.days is not None:
            out = out.filter(D.in_range(F.col("pub"), as_of, self.days, F.col("signal_type") == "event"))
        for column, wanted in (("tier", self.tiers), ("relevance", self.relevance), ("signal_type", self.signal_types), ("business_event_type", self.event_types)):
            if wanted:
                out = out.filter(F.col(column).isin(*wanted))
        if self.company:
            out = out.filter(F.array_contains("matched_company_ids", self.company))
        if self.text:
            blob = F.lower(F.concat_ws(" ", "title", "summary", "source_label", "business_event_type"))
            out = out.filter(blob.contains(self.text.lower()))
        return out.orderBy(F.desc("score"), "seq")
