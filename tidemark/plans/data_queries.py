"""Queries of the data-preparation problems of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import references as R
from tidemark.operators import timestamps as TS
from tidemark.session import read_table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    t = TS.normalise_times(
        read_table(spark, sf, "candidates"), read_table(spark, sf, "sources"), "candidate_id", "published", "source_id", "fetched_at"
    )
    return t.select("candidate_id", TS.utc_text(F.col("at")).alias("published_utc"))


def p4_notation_mix(spark: SparkSession, sf: str) -> DataFrame:
    t = TS.normalise_times(
        read_table(spark, sf, "candidates"), read_table(spark, sf, "sources"), "candidate_id", "published", "source_id", "fetched_at"
    )
    return t.groupBy("fmt").agg(F.count(F.lit(1)).alias("n"), F.min(TS.utc_text(F.col("at"))).alias("first_utc"), F.max(TS.utc_text(F.col("at"))).alias("last_utc"))


MATCHED = R.Reference("candidates", "candidate_id", "matched_company_ids", "companies", "fetched_at", "run_date", True)
SOURCES = R.Reference("candidates", "candidate_id", "source_ids", "sources", "fetched_at", "run_date", True)
GRAPH = [
    MATCHED,
    SOURCES,
    R.Reference("companies", "id", "parent_company_id", "companies"),
    R.Reference("sources", "id", "company_id", "companies"),
    R.Reference("company_relationships", "id", "hub_company_id", "companies"),
    R.Reference("incoming_candidates", "candidate_id", "source_id", "sources", "fetched_at", "fetched_at"),
    R.Reference("incoming_candidates", "candidate_id", "company_id", "companies", "fetched_at", "fetched_at"),
    R.Reference("documents", "doc_id", "source", "sources", "collected_at", "collected_at"),
    R.Reference("documents", "doc_id", "company_id", "companies", "collected_at", "collected_at"),
]


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {r.table: read_table(spark, sf, r.table) for r in GRAPH}


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    refs = [MATCHED, SOURCES] + [r for r in GRAPH if r.table in ("companies", "sources")]
    orphans = R.orphan_cascade({t: read_table(spark, sf, t) for t in ("candidates", "companies", "sources")}, refs)
    return orphans.filter((F.col("tbl") == "candidates") & (F.col("kind") == "direct")).select(
        F.col("key").cast("long").alias("candidate_id"), "field", "ref_id"
    )


def p5_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Every orphan of the whole foreign-key graph, direct and inherited."""
    return R.orphan_cascade(_tables(spark, sf), GRAPH)


def p5_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphan_counts(R.orphan_cascade(_tables(spark, sf), GRAPH))


QUERIES = {
    "p4_found": p4_found, "p4_notation_mix": p4_notation_mix,
    "p5_found": p5_found, "p5_orphans": p5_orphans, "p5_by_period": p5_by_period,
}

P5_SQL = """
WITH refs AS (
  SELECT DISTINCT candidate_id, fetched_at, 'matched_company_ids' AS field, unnest(matched_company_ids) AS ref_id FROM candidates
  UNION SELECT DISTINCT candidate_id, fetched_at, 'source_ids' AS field, unnest(source_ids) AS ref_id FROM candidates),
dims AS (SELECT 'matched_company_ids' AS field, id, added_at, removed_at FROM companies
  UNION ALL SELECT 'source_ids' AS field, id, added_at, removed_at FROM sources)
SELECT DISTINCT candidate_id, field, ref_id FROM refs r
WHERE ref_id IS NOT NULL AND ref_id <> '' AND NOT EXISTS (
  SELECT 1 FROM dims d WHERE d.field = r.field AND d.id = r.ref_id AND d.added_at <= r.fetched_at
  AND (d.removed_at IS NULL OR d.removed_at > r.fetched_at))
"""

#: The whole graph: direct orphans, then the records they spoil, level by level, and what refers to these.
P5_CASCADE = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT * FROM (
  SELECT 'candidates' AS tbl, CAST(candidate_id AS VARCHAR) AS key, 'matched_company_ids' AS field, unnest(matched_company_ids) AS ref_id, 'companies' AS target, fetched_at AS at, strftime(run_date,'%Y-%m') AS period FROM candidates
  UNION ALL SELECT 'candidates', CAST(candidate_id AS VARCHAR), 'source_ids', unnest(source_ids), 'sources', fetched_at, strftime(run_date,'%Y-%m') FROM candidates
  UNION ALL SELECT 'companies', id, 'parent_company_id', parent_company_id, 'companies', NULL, NULL FROM companies
  UNION ALL SELECT 'sources', id, 'company_id', company_id, 'companies', NULL, NULL FROM sources
  UNION ALL SELECT 'company_relationships', id, 'hub_company_id', hub_company_id, 'companies', NULL, NULL FROM company_relationships
  UNION ALL SELECT 'incoming_candidates', CAST(candidate_id AS VARCHAR), 'source_id', source_id, 'sources', fetched_at, strftime(fetched_at,'%Y-%m') FROM incoming_candidates
  UNION ALL SELECT 'incoming_candidates', CAST(candidate_id AS VARCHAR), 'company_id', company_id, 'companies', fetched_at, strftime(fetched_at,'%Y-%m') FROM incoming_candidates
  UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'source', source, 'sources', collected_at, strftime(collected_at,'%Y-%m') FROM documents
  UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'company_id', company_id, 'companies', collected_at, strftime(collected_at,'%Y-%m') FROM documents)
  WHERE ref_id IS NOT NULL AND ref_id <> ''),
dims AS (SELECT 'companies' AS target, id, added_at AS a, removed_at AS r FROM companies UNION ALL SELECT 'sources', id, added_at, removed_at FROM sources),
direct AS (SELECT tbl, key, field, ref_id, min(period) AS period FROM edges e WHERE NOT EXISTS (SELECT 1 FROM dims d WHERE d.target = e.target AND d.id = e.ref_id
  AND (d.a IS NULL OR e.at IS NULL OR d.a <= e.at) AND (d.r IS NULL OR e.at IS NULL OR d.r > e.at)) GROUP BY ALL),
bad(tbl, key, depth) AS (SELECT DISTINCT tbl, key, 0 FROM direct WHERE tbl IN ('companies','sources')
  UNION SELECT e.tbl, e.key, b.depth + 1 FROM bad b JOIN edges e ON e.target = b.tbl AND e.ref_id = b.key WHERE e.tbl IN ('companies','sources') AND b.depth < 60),
worst AS (SELECT tbl, key, min(depth) AS depth FROM bad GROUP BY ALL),
orphans AS (SELECT tbl, key, field, ref_id, period, 'direct' AS kind, 0 AS depth FROM direct
  UNION ALL SELECT e.tbl, e.key, e.field, e.ref_id, min(e.period), 'inherited', min(w.depth) + 1 FROM edges e JOIN worst w ON w.tbl = e.target AND w.key = e.ref_id
  WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.tbl = e.tbl AND d.key = e.key AND d.field = e.field AND d.ref_id = e.ref_id) GROUP BY ALL)
"""
ORACLE = {
    "p5_found": P5_SQL,
    "p5_orphans": P5_CASCADE + "SELECT * FROM orphans",
    "p5_by_period": P5_CASCADE + "SELECT tbl, field, period, kind, count(*) AS n_refs, count(DISTINCT key) AS n_rows FROM orphans GROUP BY ALL",
}
