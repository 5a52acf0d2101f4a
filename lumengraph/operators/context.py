"""Context budgets, markers and the payload for a client."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_relations(relations: DataFrame, node_scores: DataFrame) -> DataFrame:
    """Adds ``ord``: by the endpoints' summed scores, largest first; input order among equals."""
    h = node_scores.select("query_id", F.col("id").alias("head_id"), F.col("score").alias("hs"))
    t = node_scores.select("query_id", F.col("id").alias("tail_id"), F.col("score").alias("ts"))
    scored = relations.join(h, ["query_id", "head_id"], "left").join(t, ["query_id", "tail_id"], "left")
    total = F.coalesce("hs", F.lit(0.0)) + F.coalesce("ts", F.lit(0.0))
    return scored.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(total.desc(), "input_ord"))).drop("hs", "ts")


def triple_budget(lines: DataFrame, max_chars: int = 6000) -> DataFrame:
    """Lines (query_id, ord, line) that fit half of the budget, a newline after each counted: adds marker G1, G2, ..."""
    w = Window.partitionBy("query_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.withColumn("used", F.sum(F.length("line") + 1).over(w)).where(F.col("used") <= max_chars // 2)
    return kept.withColumn("marker", F.concat(F.lit("G"), F.row_number().over(Window.partitionBy("query_id").orderBy("ord")).cast("string")))


def passage_budget(passages: DataFrame, used: DataFrame, max_chars: int = 6000) -> DataFrame:
    """Longest prefix of passages (query_id, ord, block) within the budget left by ``used`` (query_id, chars): markers S1, ..."""
    w = Window.partitionBy("query_id").orderBy("ord")
    before = F.coalesce(F.sum(F.length("block") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = before + F.length("block") <= F.lit(max_chars) - F.coalesce("chars", F.lit(0))
    sized = passages.join(used, "query_id", "left").withColumn("fits", fits.cast("int"))
    # a prefix: nothing after the first passage that doesn't fit
    prefix = F.min("fits").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("prefix", prefix).where("prefix = 1").withColumn("marker", F.concat(F.lit("S"), F.row_number().over(w).cast("string"))).drop("fits", "prefix", "chars")


def payload(nodes: DataFrame, edges: DataFrame, evidence_per_node: int = 5, evidence_per_edge: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for a client: truncated evidence lists; an edge's confidence is its least evidence's."""
    n = nodes.select("id", "name", "type", F.slice("evidences", 1, evidence_per_node).alias("evidences"))
    confidence = F.array_min(F.transform("evidences", lambda e: e["confidence"]))
    e = edges.select("id", "head_id", "type", "tail_id", F.slice("evidences", 1, evidence_per_edge).alias("evidences"), confidence.alias("confidence"))
    return n, e
