"""The five plan kinds as joins over typed edges (person -> film), with their proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROOFS = 64


def _of(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("type") == kind).select(F.col("head_id").alias("person"), F.col("tail_id").alias("film")).distinct()


def _films(edges: DataFrame, kind: str, person: str | Column) -> DataFrame:
    return _of(edges, kind).where(F.col("person") == person).select("film")


def directors(edges: DataFrame, film: str) -> DataFrame:
    return _of(edges, "directed").where(F.col("film") == film).select(F.col("person").alias("answer_id"))


def cofilm(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Films that both people act in."""
    return _films(edges, "acted_in", a).join(_films(edges, "acted_in", b), "film", "left_semi").select(F.col("film").alias("answer_id"))


def director_actor(edges: DataFrame, director: str, actor: str) -> DataFrame:
    return _films(edges, "acted_in", actor).join(_films(edges, "directed", director), "film", "left_semi").select(F.col("film").alias("answer_id"))


def repeated_cast(edges: DataFrame, director: str | Column, minimum: int = 2) -> DataFrame:
    """People in at least ``minimum`` different films of the director: (answer_id, films)."""
    cast = _of(edges, "acted_in").join(_films(edges, "directed", director), "film", "left_semi")
    return cast.groupBy(F.col("person").alias("answer_id")).agg(F.count("*").alias("films")).where(F.col("films") >= max(2, minimum))


def director_overlap(edges: DataFrame, first: str, second: str) -> DataFrame:
    """People with a film by either director."""
    acted = _of(edges, "acted_in")
    one = acted.join(_films(edges, "directed", first), "film", "left_semi").select("person").distinct()
    two = acted.join(_films(edges, "directed", second), "film", "left_semi").select("person").distinct()
    return one.join(two, "person", "left_semi").select(F.col("person").alias("answer_id"))


def proof_pairs(edges: DataFrame, director: str | Column, limit: int = PROOFS) -> DataFrame:
    """Pairs of the director's films that share a person, the first ``limit`` of each person: (answer_id, rank, m1, m2).

    Only a person's first films can be in their first pairs, so the rest don't enter the self-join.
    """
    cast = _of(edges, "acted_in").join(_films(edges, "directed", director), "film", "left_semi")
    nth = cast.withColumn("n", F.row_number().over(Window.partitionBy("person").orderBy("film"))).where(F.col("n") <= limit + 1)
    a, b = nth.select("person", F.col("film").alias("m1")), nth.select("person", F.col("film").alias("m2"))
    pairs = a.join(b, "person").where("m1 < m2")
    rank = F.row_number().over(Window.partitionBy("person").orderBy("m1", "m2"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("person").alias("answer_id"), "rank", "m1", "m2")


def scope(edges: DataFrame, subjects: list[str], directors_only: bool = False) -> DataFrame:
    """Edges that matter to a plan: of the subjects, and into the subjects' films; or who directed the subject."""
    if directors_only:
        return edges.where(F.col("tail_id").isin(subjects) & (F.col("type") == "directed"))
    told = edges.where(F.col("type").isin("acted_in", "directed"))
    own = told.where(F.col("head_id").isin(subjects))
    return own.unionByName(told.join(own.select("tail_id").distinct(), "tail_id", "left_semi").select(*edges.columns)).distinct()


def busiest(edges: DataFrame, kind: str = "directed") -> Column:
    """The person with most films of a kind (the smaller id among equals), as a one-row scalar."""
    return _of(edges, kind).groupBy("person").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person").limit(1)
