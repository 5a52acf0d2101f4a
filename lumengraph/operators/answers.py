"""Structured answers from retrieved edges: groups by type, pair verdicts, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import dealt
from .views import ways

SHOWN = 12


def distinct_anchors(anchors: DataFrame) -> DataFrame:
    """The best anchor of each name (query_id, name, rank, ...)."""
    n = F.row_number().over(Window.partitionBy("query_id", "name").orderBy("rank"))
    return anchors.withColumn("__n", n).where("__n = 1").drop("__n")


def focus(relations: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges that touch an anchor of their question; all of a question's edges if none does."""
    a = anchors.select("query_id", F.col("id").alias("anchor")).distinct()
    touching = relations.join(a, (relations["query_id"] == a["query_id"]) & ((relations["head_id"] == a["anchor"]) | (relations["tail_id"] == a["anchor"])), "left_semi")
    none = relations.join(touching.select("query_id").distinct(), "query_id", "left_anti")
    return touching.unionByName(none)


def groups(relations: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(query_id, place, type, n, lines, more): edge types by size, their first ``shown`` lines, how many more."""
    n = F.row_number().over(Window.partitionBy("query_id", "type").orderBy("ord"))
    rows = relations.withColumn("n", n)
    by = rows.groupBy("query_id", "type").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.struct("n", "line")))).alias("l"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("size"), "type"))
    return by.select("query_id", place.alias("place"), "type", F.col("size").alias("n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"), F.greatest(F.col("size") - shown, F.lit(0)).alias("more"))


def citation_marks(edge_evidence: DataFrame, citations: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, edge_id, marks): the first markers of an edge's evidence chunks."""
    tied = edge_evidence.join(citations.select("query_id", "chunk_id", "place", "marker"), ["query_id", "chunk_id"])
    listed = tied.groupBy("query_id", "edge_id").agg(F.array_sort(F.collect_set(F.struct("place", "marker"))).alias("m"))
    return listed.select("query_id", "edge_id", F.array_join(F.transform(F.slice("m", 1, most), lambda x: F.concat(F.lit("["), x["marker"], F.lit("]"))), "").alias("marks"))


def pair_verdicts(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, verdict, bridges): direct, bridged by common neighbours, or none, within these edges, which may repeat.

    Neighbours are dealt by node once, and only then made distinct; both ends of the pairs meet them there.
    """
    n = 2 * edges.count()
    near = dealt(ways(edges), n, "id").distinct()
    one = pairs.join(near.withColumnRenamed("id", "a"), "a")
    direct = one.where("neighbour = b").select("a", "b").distinct().withColumn("direct", F.lit(True))
    far = near.withColumnRenamed("neighbour", "n2")
    both = dealt(one, n, "b").join(far, (F.col("b") == F.col("id")) & (F.col("neighbour") == F.col("n2")))
    bridged = both.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("neighbour")), ",").alias("bridges"))
    out = pairs.join(direct, ["a", "b"], "left").join(bridged, ["a", "b"], "left")
    verdict = F.when(F.col("direct"), "direct").when(F.col("bridges").isNotNull(), "bridged").otherwise("none")
    return out.select("a", "b", verdict.alias("verdict"), F.coalesce("bridges", F.lit("")).alias("bridges"))


def set_answer(answers: DataFrame, empty: str = "没有找到完整的证据") -> DataFrame:
    """(query_id, text): answer names in order of id, or a refusal; ``answers`` has query_id, answer_id, name (null: none)."""
    listed = answers.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("answer_id").isNotNull(), F.struct("answer_id", "name")))).alias("a"))
    return listed.select("query_id", F.when(F.size("a") == 0, empty).otherwise(F.array_join(F.transform("a", lambda x: x["name"]), "、")).alias("text"))
