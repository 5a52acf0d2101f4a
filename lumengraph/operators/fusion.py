"""Score normalisation, graph chunk scores, rank and score fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minmax(score: Column, *keys: str) -> Column:
    """Between 0 and 1 within the keys; 1 where all scores are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high <= low, F.lit(1.0)).otherwise((score - low) / (high - low))


def peak(score: Column, *keys: str) -> Column:
    """Over the largest within the keys."""
    top = F.max(score).over(Window.partitionBy(*keys))
    return F.when(top > 0, score / top).otherwise(score)


def summed(order: str, score: str) -> Column:
    """An aggregate: the sum of the scores from the smallest ``order`` to the largest, whatever the partitions; null scores don't count.

    A plain sum adds partial sums in the order in which they arrive, so totals that are equal, and the ranks that they
    decide, may differ from run to run in the last bit. Groups must fit a task.
    """
    rows = F.array_sort(F.collect_list(F.when(F.col(score).isNotNull(), F.struct(F.col(order).alias("o"), F.col(score).cast("double").alias("s")))))
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda total, x: total + x["s"]))


def chunk_scores(edge_evidence: DataFrame, node_evidence: DataFrame, node_scores: DataFrame) -> DataFrame:
    """(query_id, chunk_id, graph): both endpoints' scores times confidence per edge evidence, a fifth of a node's per node evidence."""
    h = node_scores.select("query_id", F.col("id").alias("head_id"), F.col("score").alias("hs"))
    t = node_scores.select("query_id", F.col("id").alias("tail_id"), F.col("score").alias("ts"))
    by_edge = edge_evidence.join(h, "head_id").join(t, ["query_id", "tail_id"]).select("query_id", "chunk_id", ((F.col("hs") + F.col("ts")) * F.col("confidence")).alias("s"))
    by_node = node_evidence.join(node_scores, "id").select("query_id", "chunk_id", (F.col("score") * 0.2).alias("s"))
    return by_edge.unionByName(by_node).groupBy("query_id", "chunk_id").agg(F.sum("s").alias("graph"))


def first_seen(evidence: DataFrame, limit: int) -> DataFrame:
    """Chunks (query_id, chunk_id, ord) in order of first appearance, at most ``limit`` per query: (…, place)."""
    first = evidence.groupBy("query_id", "chunk_id").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "chunk_id"))
    return first.withColumn("place", place).where(F.col("place") <= limit)


def weighted(candidates: DataFrame, semantic: DataFrame, graph: DataFrame, w_semantic: float = 0.65, w_graph: float = 0.35, k: int = 6) -> DataFrame:
    """(query_id, rank, chunk_id, score): min-max normalised scores of the candidates, weighted; missing is 0."""
    joined = candidates.select("query_id", "chunk_id").distinct().join(semantic, ["query_id", "chunk_id"], "left").join(graph, ["query_id", "chunk_id"], "left")
    both = joined.withColumn("s", F.coalesce(minmax(F.col("semantic"), "query_id") * (F.col("semantic").isNotNull()).cast("int"), F.lit(0.0))).withColumn("g", F.coalesce(minmax(F.col("graph"), "query_id") * (F.col("graph").isNotNull()).cast("int"), F.lit(0.0)))
    score = F.round(F.col("s") * w_semantic + F.col("g") * w_graph, 6)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return both.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def reciprocal_ranks(lists: DataFrame, k: int = 6, offset: int = 60) -> DataFrame:
    """(query_id, list, rank, chunk_id) -> the k chunks with the largest sum of 1 / (offset + rank)."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (offset + F.col("rank"))), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def seed_entities(anchors: DataFrame, node_evidence: DataFrame, seed_chunks: DataFrame, floor: float = 0.65) -> DataFrame:
    """(query_id, id, score): anchors, and entities with evidence in a seed chunk at ``floor`` or more."""
    seen = node_evidence.join(seed_chunks.select("query_id", "chunk_id"), "chunk_id").select("query_id", "id", F.lit(floor).alias("score"))
    return anchors.select("query_id", "id", "score").unionByName(seen).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def top_nodes(scores: DataFrame, n: int = 50) -> DataFrame:
    """Positive scores, the n largest per query, ties by id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= n)
