"""Aggregates over signals: mixes, source health, companies, coverage, trends, matrices, briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dates as D
from tidemark.session import small_side

SELECTED = ("immediate", "daily")


def mix(s: DataFrame, column: str, out: str = "k") -> DataFrame:
    return s.groupBy(F.col(column).alias(out)).agg(F.count(F.lit(1)).alias("n"))


def multi_mix(s: DataFrame, column: str, out: str = "k") -> DataFrame:
    """Counts over the distinct elements of an array column; an item counts once for each."""
    return mix(s.select(F.explode(F.array_distinct(column)).alias(out)).filter(F.col(out).isNotNull()), out, out)


def tier_counts() -> list[Column]:
    return [F.count_if(F.col("tier") == t).alias(t) for t in ("immediate", "daily", "archive")]


def rate(part: Column, whole: Column, half_even: bool = True) -> Column:
    """Percent as an integer, of part / whole in double arithmetic; 0 for an empty whole."""
    p = (part.cast("double") / whole) * 100
    return F.when(whole == 0, 0).otherwise((F.bround(p, 0) if half_even else F.floor(p + 0.5)).cast("long"))


def by_source(s: DataFrame) -> DataFrame:
    """An item counts for each of its sources. One aggregate, pre-aggregated before the shuffle."""
    e = s.select("seq", "tier", "pub", F.explode(F.array_distinct("source_ids")).alias("source_id"))
    return e.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), *tier_counts(), F.max("pub").alias("last_published"))


def source_health(sources: DataFrame, s: DataFrame) -> DataFrame:
    """A row per source, producing or not, with its status."""
    src = sources.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"), F.coalesce("enabled", F.lit(True)).alias("enabled")).dropDuplicates(["source_id"])
    h = src.join(by_source(s), "source_id", "left").na.fill(0, ["total", "immediate", "daily", "archive"])
    sel = F.col("immediate") + F.col("daily")
    status = F.when(~F.col("enabled"), "pending").when(sel > 0, "productive").when(F.col("total") > 0, "archive_only").otherwise("quiet")
    return h.select("*", sel.alias("selected"), rate(sel, F.col("total")).alias("selected_rate"), status.alias("status"))


STATUS_ORDER = ("error", "pending", "quiet", "archive_only", "productive")


def health_order() -> list[Column]:
    rank = F.coalesce(*[F.when(F.col("status") == x, i) for i, x in enumerate(STATUS_ORDER)], F.lit(len(STATUS_ORDER)))
    return [rank, F.desc("total"), F.asc("source_id")]


def company_source_health(s: DataFrame) -> DataFrame:
    e = s.select("seq", "tier", F.explode(F.array_distinct("matched_company_ids")).alias("company_id"), "source_ids").filter("company_id is not null and company_id <> ''")
    e = e.select("seq", "tier", "company_id", F.explode(F.array_distinct("source_ids")).alias("source_id")).filter("source_id is not null")
    g = e.groupBy("company_id", "source_id").agg(F.count(F.lit(1)).alias("total"), *tier_counts())
    sel = F.col("immediate") + F.col("daily")
    return g.select("*", rate(sel, F.col("total"), half_even=False).alias("selected_rate"), F.when(sel > 0, "productive").otherwise("archive_only").alias("status"))


def signal_trend(s: DataFrame, as_of: str, days: int, keys: list[str], column: str) -> DataFrame:
    """(day, k, n): counts per day and key over the last days, zero-filled; undated and future items count as today."""
    spark = s.sparkSession
    today = F.to_date(F.lit(as_of))
    cal = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    dom = spark.createDataFrame([(k,) for k in keys], "k string")
    age = F.greatest(F.coalesce(D.age_days(F.col("pub"), today), F.lit(0)), F.lit(0))
    n = s.select(F.date_sub(today, age).alias("day"), F.col(column).alias("k")).filter(F.col("day") > F.date_sub(today, days)).groupBy("day", "k").agg(F.count(F.lit(1)).alias("n"))
    return cal.join(dom).join(n, ["day", "k"], "left").na.fill(0, ["n"])


def filled(counts: DataFrame, domain: list[str], key: str = "k") -> DataFrame:
    """counts over a fixed domain, zero where none."""
    dom = counts.sparkSession.createDataFrame([(d,) for d in domain], f"{key} string")
    return dom.join(counts, key, "left").na.fill(0, ["n"])


def company_event_matrix(s: DataFrame, companies: DataFrame, as_of: str, days: int = 90, top: int = 5) -> DataFrame:
    """(company_id, event_type, n, selected, intensity): competitors by their most frequent event types, in long form.

    Of an item's competitors one whose parent is matched too stands for it, else the best ranked (none last, then by id).
    """
    comp = companies.filter("business_role = 'competitor'").select(
        F.col("id").alias("company_id"), "parent_company_id", F.coalesce("competitive_relevance_rank", F.lit(10**6)).alias("rank")
    ).dropDuplicates(["company_id"])
    base = s.filter(D.in_range(F.col("pub"), F.to_date(F.lit(as_of)), days, F.col("signal_type") == "event"))
    e = base.select("seq", "tier", "business_event_type", F.explode(F.array_distinct("matched_company_ids")).alias("company_id"), F.col("matched_company_ids").alias("ids"))
    e = e.join(small_side(comp), "company_id")
    known = comp.select(F.col("company_id").alias("parent_company_id"), F.lit(True).alias("_pk"))
    e = e.join(small_side(known), "parent_company_id", "left")
    brand = F.coalesce(F.col("_pk") & F.array_contains("ids", F.col("parent_company_id")), F.lit(False))
    one = e.groupBy("seq", "tier", "business_event_type").agg(F.min_by("company_id", F.struct((~brand).alias("b"), F.when(brand, 0).otherwise(F.col("rank")).alias("r"), "company_id")).alias("company_id"))
    w = Window.orderBy(F.desc("n"), "business_event_type")
    types = one.groupBy("business_event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).select("business_event_type")
    m = one.join(small_side(types), "business_event_type").groupBy("company_id", "business_event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier").isin(*SELECTED)).alias("selected")
    )
    most = m.agg(F.max("n").alias("_most"))
    return m.join(F.broadcast(most)).select("company_id", F.col("business_event_type").alias("event_type"), "n", "selected", F.ceil(4 * F.col("n") / F.col("_most")).cast("long").alias("intensity"))


def top1(s: DataFrame, facet: str, column: str) -> DataFrame:
    """(facet, label, n): the most frequent value; of ties the one seen first."""
    g = s.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("_f"))
    return g.agg(F.max_by(F.struct("label", "n"), F.struct("n", -F.col("_f"))).alias("x")).select(F.lit(facet).alias("facet"), "x.label", "x.n")


def day_over_day(counts: DataFrame) -> DataFrame:
    """(day, n, previous, delta, direction) of (day, n); a row per day, so one small window."""
    w = Window.orderBy("day")
    c = counts.withColumn("previous", F.lag("n").over(w))
    d = F.col("n") - F.col("previous")
    return c.select("day", "n", "previous", d.alias("delta"), F.when(d > 0, "up").when(d < 0, "down").when(d == 0, "flat").alias("direction"))


def retained(rows: DataFrame, day: str, keep: int) -> DataFrame:
    """rows of the last keep days that occur: the days are ranked, not the rows."""
    days = rows.select(day).distinct().orderBy(F.desc(day)).limit(keep)
    return rows.join(small_side(days), day, "left_semi")


def top_per_key(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark cuts each partition to n rows a key before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)
