"""Scoring answers, paths and gaps; summaries, pivots and paired views of result ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import normalise
from .views import edge_key


def derive_count_mask(edges: DataFrame) -> DataFrame:
    """All but the first film of each person."""
    n = F.row_number().over(Window.partitionBy("head_id").orderBy("tail_id"))
    return edges.withColumn("n", n).where("n > 1").select("head_id", "type", "tail_id")


def derive_path_mask(path_edges: DataFrame) -> DataFrame:
    """The last edge of each gold path (path_id, place, head_id, type, tail_id), each once."""
    last = F.row_number().over(Window.partitionBy("path_id").orderBy(F.desc("place")))
    return path_edges.withColumn("n", last).where("n = 1").select("head_id", "type", "tail_id").distinct()


def set_prf(predicted: DataFrame, gold: DataFrame, questions: DataFrame, key: str = "question_id", item: str = "item") -> DataFrame:
    """(key, precision, recall, f1, exact): an empty gold set scores 1 if nothing was predicted, else 0."""
    p = predicted.select(key, item).distinct().withColumn("p", F.lit(1))
    g = gold.select(key, item).distinct().withColumn("g", F.lit(1))
    n = p.join(g, [key, item], "full").groupBy(key).agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"))
    c = questions.select(key).distinct().join(n, key, "left").na.fill(0, ["np", "ng", "tp"])
    empty = F.when(F.col("np") == 0, 1.0).otherwise(0.0)
    precision = F.when(F.col("np") == 0, 0.0).otherwise(F.col("tp") / F.nullif("np", F.lit(0)))
    recall = F.col("tp") / F.nullif("ng", F.lit(0))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / F.nullif(F.col("np") + F.col("ng"), F.lit(0)))
    exact = ((F.col("tp") == F.col("np")) & (F.col("tp") == F.col("ng"))).cast("double")
    pick = lambda x: F.round(F.when(F.col("ng") == 0, empty).otherwise(x), 6)
    return c.select(key, pick(precision).alias("precision"), pick(recall).alias("recall"), pick(f1).alias("f1"), pick(exact).alias("exact"))


# Wordings that deny, affirm or plead a lack of material.
DENIAL = r"(?:无|没有|未发现|不存在).{0,12}(?:共同|同一部|交集)"
CONCLUSION_NONE = r"结论\s*[：:]\s*无(?:[^\p{L}\p{N}_]|$)"
AFFIRMATION = r"(?:有|存在).{0,8}(?:共同出演|共同参演|同一部影片)"
INSUFFICIENT = r"(?:材料|信息|证据).{0,8}(?:不足|不够)|无法(?:判断|确定|作答)"


def no_answer(body: Column) -> Column:
    """Struct of denial, affirmative, insufficient and correct for an answer to a question without any."""
    bare = F.regexp_replace(body, r"[\s\p{P}_]+", "")
    denial = body.rlike(DENIAL) | body.rlike(CONCLUSION_NONE) | bare.isin("无", "否")
    affirmed, lacking = body.rlike(AFFIRMATION), body.rlike(INSUFFICIENT)
    return F.struct(denial.alias("denial"), affirmed.alias("affirmative"), lacking.alias("insufficient"), (denial & ~affirmed & ~lacking).cast("double").alias("correct"))


#: Surfaces of fewer than ``KEY`` characters are looked up by their first two, others by so many.
KEY = 4


def entity_cover(answers: DataFrame, surfaces: DataFrame, allowed_short: DataFrame, titles: bool = False, key: str = "answer_id") -> DataFrame:
    """(key, owner): owners of the surfaces that stand in an answer outside any longer surface.

    ``answers``: key, text; ``surfaces``: surface, owner; ``allowed_short``: key, owner. Text and surfaces are compared in
    normal form; a surface of two characters counts if one of its owners is in ``allowed_short`` for the answer, one of
    fewer never. With ``titles`` a surface that stands in 《》 only counts too. Null or empty texts have no owners.

    Places are found by a join on a place's first characters; occurrences of one surface don't overlap, from the left.
    Whatever lies in a place that lies in a longer one lies in the longer one itself, so what longest-first choosing
    leaves are the places that lie in no other: those that end beyond all that start before them, by one sweep.
    """
    own = surfaces.select(normalise("surface").alias("surface"), "owner").where(F.length("surface") >= 2).distinct()
    names = own.select("surface", F.length("surface").alias("size")).distinct()
    longest = names.agg(F.max("size")).first()[0] or 2
    texts = answers.select(key, "text", normalise(F.coalesce("text", F.lit(""))).alias("plain"))
    short = allowed_short.join(own.where(F.length("surface") == 2), "owner").select(key, "surface").distinct().withColumn("allowed", F.lit(True))

    pieces = texts.where(F.length("plain") >= 2).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("plain") - 1), lambda i: F.substring("plain", i, F.lit(longest)))).alias("piece")).distinct()
    keyed = pieces.select(key, "piece", F.explode(F.array_distinct(F.array(F.substring("piece", 1, 2), F.substring("piece", 1, KEY)))).alias("k"))
    lead = names.withColumn("k", F.when(F.col("size") < KEY, F.substring("surface", 1, 2)).otherwise(F.substring("surface", 1, KEY)))
    seen = keyed.join(lead, "k").where(F.col("piece").startswith(F.col("surface"))).select(key, "surface", "size").distinct()
    seen = _eligible(seen, short, key)

    parts = F.split("plain", F.concat(F.lit("\\Q"), F.col("surface"), F.lit("\\E")), -1)
    before = F.aggregate(F.slice("parts", 1, F.col("i") + 1), F.lit(0), lambda n, x: n + F.length(x))
    places = seen.join(texts.select(key, "plain"), key).select(key, "surface", "size", parts.alias("parts"))
    places = places.select(key, "surface", "size", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 2)).alias("i")).select(key, "surface", "size", (before + F.col("i") * F.col("size")).alias("start"))
    places = places.withColumn("end", F.col("start") + F.col("size"))
    reach = F.max("end").over(Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    found = places.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("end") > F.col("reach"))).select(key, "surface")
    if titles:
        quoted = texts.select(key, F.explode(F.regexp_extract_all("text", F.lit("《([^》]+)》"), F.lit(1))).alias("title")).select(key, normalise("title").alias("surface"))
        lone = _eligible(quoted.join(names, "surface").select(key, "surface", "size"), short, key).join(seen, [key, "surface"], "left_anti")
        found = found.unionByName(lone.select(key, "surface"))
    return found.distinct().join(own, "surface").select(key, "owner").distinct()


def _eligible(seen: DataFrame, short: DataFrame, key: str) -> DataFrame:
    return seen.join(short, [key, "surface"], "left").where((F.col("size") > 2) | F.col("allowed")).drop("allowed")


def canonical_endpoints(ids: DataFrame, catalogue: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(raw_id, canonical): an id of the catalogue is itself; others are all owners of their normalised name (null: the id).

    ``ids``: raw_id, name; ``catalogue``: id; ``surfaces``: surface, owner. An id that no surface names has no row.
    """
    known = catalogue.select(F.col("id").alias("raw_id")).distinct()
    same = ids.join(known, "raw_id", "left_semi").select("raw_id", F.col("raw_id").alias("canonical"))
    named = ids.join(known, "raw_id", "left_anti").select("raw_id", normalise(F.coalesce("name", "raw_id")).alias("surface"))
    owners = surfaces.select(normalise("surface").alias("surface"), F.col("owner").alias("canonical"))
    return same.unionByName(named.join(owners, "surface").select("raw_id", "canonical")).distinct()


def path_completeness(path_edges: DataFrame, retrieved: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, edge_recall, path_rate): share of gold edges and of wholly retrieved gold paths; direction-blind.

    ``path_edges``: key, path_id, head_id, type, tail_id; questions without gold edges have no row.
    """
    keyed = path_edges.select(key, "path_id", *edge_key(path_edges))
    got = retrieved.select(key, *edge_key(retrieved)).distinct().withColumn("hit", F.lit(True))
    joined = keyed.join(got, [key, "ka", "kb", "kt"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    edge = joined.groupBy(key, "ka", "kb", "kt").agg(F.max("hit").alias("hit")).groupBy(key).agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("edge_recall"))
    path = joined.groupBy(key, "path_id").agg(F.bool_and("hit").alias("whole")).groupBy(key).agg(F.round(F.avg(F.col("whole").cast("double")), 6).alias("path_rate"))
    return edge.join(path, key)


def accepted_repairs(repairs: DataFrame, gold_edges: DataFrame, gold_docs: DataFrame, key: str = "question_id") -> DataFrame:
    """Temporary edges whose directed key is a gold edge and that a gold document supports."""
    same = repairs.join(gold_edges.select(key, "head_id", "type", "tail_id").distinct(), [key, "head_id", "type", "tail_id"], "left_semi")
    return same.join(gold_docs.select(key, "doc_id").distinct(), [key, "doc_id"], "left_semi")


def gap_metrics(rows: DataFrame) -> DataFrame:
    """Per method: how often an expected gap was triggered, and a gap that wasn't expected."""
    return rows.groupBy("method").agg(F.avg(F.when(F.col("expected_gap"), F.col("triggered").cast("double"))).alias("gap_recall"), F.avg(F.when(~F.col("expected_gap"), F.col("triggered").cast("double"))).alias("false_positive_rate"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def summary(rows: DataFrame, value: str, method: str = "method", kind: str = "kind") -> DataFrame:
    """Mean by method and by method and kind, in one pass of grouping sets; kind is null for all kinds."""
    mean = F.round(F.avg(F.col(value).cast("double")), 6).alias("mean")
    return rows.groupingSets([[method], [method, kind]], method, kind).agg(F.count("*").alias("n"), mean)


def pivot(rows: DataFrame, value: str, method: str, kind: str, methods: list[str]) -> DataFrame:
    return rows.groupBy(kind).pivot(method, methods).agg(F.round(F.avg(value), 6))


def paired(complete: DataFrame, masked: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both views' values side by side for keys that both have, and the drop."""
    a, b = complete.select(*keys, F.col(value).alias("complete")), masked.select(*keys, F.col(value).alias("masked"))
    return a.join(b, keys).withColumn("drop", F.round(F.col("complete") - F.col("masked"), 6))


def first_per_kind(rows: DataFrame, kind: str, order: list[str], limit: int = 6) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n").orderBy(*order).limit(limit)
