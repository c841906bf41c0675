"""The graph of relationships as two frames: nodes and typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def graph(relations: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): hub, organisations, topics and competitors. The first of equal nodes and edges stays.

    relations: hub_company_id, organization, relationship_type, topics. Null organisations give no edge.
    """
    r = relations.filter("organization is not null and organization <> ''").select(
        F.concat(F.lit("hub:"), "hub_company_id").alias("hub"), F.concat(F.lit("org:"), F.lower(F.trim("organization"))).alias("org"), F.col("relationship_type").alias("type"), "topics"
    )
    comp = companies.filter("business_role = 'competitor'").select(F.concat(F.lit("company:"), "id").alias("node"))
    hubs = r.select("hub").distinct()
    edges = (
        r.select(F.col("hub").alias("src"), F.col("org").alias("dst"), "type")
        .unionByName(r.select(F.col("org").alias("src"), F.explode("topics").alias("t")).select("src", F.concat(F.lit("topic:"), "t").alias("dst"), F.lit("topic").alias("type")))
        .unionByName(hubs.join(F.broadcast(comp)).select(F.col("hub").alias("src"), F.col("node").alias("dst"), F.lit("competitor").alias("type")))
        .filter("dst is not null")
        .dropDuplicates(["src", "dst", "type"])
    )
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return ends.select("node", F.substring_index("node", ":", 1).alias("kind")), edges


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree), undirected; ends are counted before they meet, so a hub is one row per partition."""
    both = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def induced(nodes: DataFrame, edges: DataFrame, visible: Column) -> tuple[DataFrame, DataFrame]:
    """The visible nodes and the edges with both ends visible."""
    n = nodes.filter(visible)
    e = edges.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    return n, e


def neighbours(edges: DataFrame, focus: str) -> DataFrame:
    """(node, type): the other ends of the edges of one node."""
    out = edges.filter(F.col("src") == focus).select(F.col("dst").alias("node"), "type")
    back = edges.filter(F.col("dst") == focus).select(F.col("src").alias("node"), "type")
    return out.unionByName(back).distinct()
