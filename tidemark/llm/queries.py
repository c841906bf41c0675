"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, incremental, leaks, lookalikes, nearsim, resolve, truncation
from tidemark.session import read_table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = lookalikes.repaired(read_table(spark, sf, "candidates"), "candidate_id", ["title", "summary"])
    return found.select(F.col("id").alias("candidate_id"), "field")


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every title and summary in its one form."""
    clean = lookalikes.consistent(read_table(spark, sf, "candidates"), "candidate_id", ["title", "summary"])
    return clean.select(F.col("id").alias("candidate_id"), "field", "clean")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.batch_repeats(read_table(spark, sf, "candidates"), read_table(spark, sf, "incoming_candidates"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearsim.group_pairs(nearsim.groups(read_table(spark, sf, "candidates"), "candidate_id", "title", "summary", "url"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every grouped row with the least id of its group and the group's size."""
    m = nearsim.groups(read_table(spark, sf, "candidates"), "candidate_id", "title", "summary", "url")
    size = m.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return m.join(size, "root").select(F.col("id").alias("candidate_id"), F.col("root").alias("group_id"), "n")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encoded(read_table(spark, sf, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(read_table(spark, sf, "documents"), "doc_id", "text", read_table(spark, sf, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Of each leaked item: the documents that hold it, the longest run, and whether one holds it whole."""
    return _leaks(spark, sf).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("run").alias("longest_run"), F.max(F.col("run") == F.col("item_words")).alias("whole")
    )


def _truncated(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(read_table(spark, sf, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _truncated(spark, sf).filter("cut").select("doc_id")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source: its documents, those cut, those at a field limit, and the rate of cut ones."""
    return _truncated(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("n_cut"), F.count_if("at_limit").alias("n_at_limit"),
        F.round(F.count_if("cut") / F.count(F.lit(1)), 6).alias("cut_rate"),
    )


def p9_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source and rule: the documents cut by it. limit is the histogram's share, ending that of cuts at no limit."""
    return _truncated(spark, sf).filter("cut").groupBy("source", "rule").agg(F.count(F.lit(1)).alias("n"))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve(read_table(spark, sf, "companies"), read_table(spark, sf, "company_relationships"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.found_pairs(_members(spark, sf)).distinct()


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Each record with the organisation it names and how many records name that."""
    m = _members(spark, sf)
    return m.join(m.groupBy("entity").agg(F.count(F.lit(1)).alias("n_records")), "entity")


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p9_found": p9_found, "p9_rates": p9_rates, "p9_rules": p9_rules, "p8_found": p8_found, "p8_items": p8_items, "p7_ids": p7_ids, "p2_found": p2_found, "p3_found": p3_found, "p3_clean": p3_clean, "p6_found": p6_found, "p6_groups": p6_groups}
ORACLE: dict[str, str] = {}
