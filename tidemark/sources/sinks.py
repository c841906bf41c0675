"""Sinks: JSON and CSV files, a Markdown report, history by day."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.marts import retained


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


#: The columns of the item export, in order.
EXPORT = (
    "id", "tier", "score", "relevance", "event_type", "signal_type", "category", "company", "companies", "region", "role", "title", "url", "source", "sources", "published",
    "event_start", "summary", "reasons", "topics", "explanation", "action", "owner",
)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """All columns quoted, quotes doubled, arrays joined by '; '; with mark a byte order mark before the first column's name."""
    name = lambda i, c: f"\ufeff{c}" if mark and not i else c
    cols = [(F.array_join(c, "; ") if t.startswith("array") else F.col(c).cast("string")).alias(name(i, c)) for i, (c, t) in enumerate(df.dtypes)]
    df.select(*cols).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_rows(df: DataFrame) -> DataFrame:
    """df in the columns of EXPORT; those it lacks are empty."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in EXPORT])


def static_api(s: DataFrame, path: str) -> None:
    """items, daily (selected tiers) and topics (counts by category and signal type) as JSON."""
    write_json(s, f"{path}/items")
    write_json(s.filter(F.col("tier").isin("immediate", "daily")), f"{path}/daily")
    topic = lambda c: s.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("mix"), "k", "n")
    write_json(topic("category").unionByName(topic("signal_type")), f"{path}/topics")


def report_lines(new: DataFrame, archive_most: int = 15) -> DataFrame:
    """(section, place, line): unseen items by tier; of the archive the first by seq, then sorted by score like the others.

    The archive, most of all rows, is cut by a top-k before any window sees it.
    """
    some = new.filter("tier = 'archive'").orderBy("seq").limit(archive_most)
    kept = new.filter("coalesce(tier, '') <> 'archive'").unionByName(some)
    w = Window.partitionBy("tier").orderBy(F.desc("score"), "seq")
    text = F.when(F.length("summary") > 220, F.concat(F.left("summary", F.lit(220)), F.lit("..."))).otherwise(F.col("summary"))
    place = F.row_number().over(w)
    return kept.select(F.col("tier").alias("section"), place.alias("place"), F.format_string("%d. [%s](%s) - %s", place, F.col("title"), F.coalesce("url", F.lit("")), text).alias("line"))


def report_markdown(new: DataFrame) -> DataFrame:
    """(section, text): one text per section, of a bounded number of items for the archive and the selected items for others."""
    g = report_lines(new).groupBy("section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    return g.select("section", F.concat(F.lit("## "), "section", F.lit("\n\n"), F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("text"))


def error_lines(errors: DataFrame) -> DataFrame:
    """(section, place, line): the errors section of a report, from (source_id, error)."""
    w = Window.partitionBy("section").orderBy("source_id", "error")
    e = errors.select(F.lit("errors").alias("section"), "source_id", "error")
    return e.select("section", F.row_number().over(w).alias("place"), F.concat(F.lit("- "), "source_id", F.lit(": "), "error").alias("line"))


def share_page(payload: str, title: str) -> str:
    """A page that holds a run's payload (JSON text) in itself, safe inside its script element. One small document, no data of the corpus."""
    safe = payload.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><script type="application/json" id="payload">{safe}</script>'


def read_config(spark, path: str, key: str, field: str | None = None) -> DataFrame:
    """A JSON configuration file as rows keyed by key: its array field, or the document itself; the first row of a key stays."""
    d = spark.read.json(path, multiLine=True)
    if field:
        d = d.select(F.explode(field).alias("_x")).select("_x.*")
    return d.filter(F.col(key).isNotNull()).dropDuplicates([key])


def write_run(s: DataFrame, day_rows: DataFrame, seen: DataFrame, path: str, dry: bool = False) -> None:
    """A run's outputs; a dry run writes the API and history too and leaves out only the seen store."""
    static_api(s, f"{path}/api")
    write_history(day_rows, f"{path}/history")
    if not dry:
        seen.write.mode("overwrite").parquet(f"{path}/seen")


def write_history(day_rows: DataFrame, path: str, day: str = "date") -> None:
    """A partition per day; days written before are replaced, others stay."""
    day_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_history(spark, path: str, keep: int = 90, day: str = "date") -> DataFrame:
    """The last keep days there are, by count and not by age."""
    return retained(spark.read.parquet(path), day, keep)


def overlay(rows: DataFrame, config: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns taken from config where it has them, else their own."""
    c = config.select(key, *[F.col(x).alias(f"_{x}") for x in columns]).dropDuplicates([key])
    j = rows.join(c, key, "left")
    return j.select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in rows.columns])
