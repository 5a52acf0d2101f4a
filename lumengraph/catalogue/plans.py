"""Set-reasoning queries over the stand-in film graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.views import mask_edges
from ..plans import sets
from ..session import edges
from . import query

E = """WITH acted AS (SELECT DISTINCT 'S:' || l_suppkey AS p, 'O:' || l_orderkey AS m FROM lineitem),
directed AS (SELECT DISTINCT 'C:' || o_custkey AS p, 'O:' || o_orderkey AS m FROM orders),
busy AS (SELECT p FROM directed GROUP BY p ORDER BY count(*) DESC, p LIMIT 1),
busy2 AS (SELECT p FROM directed GROUP BY p ORDER BY count(*) DESC, p LIMIT 1 OFFSET 1)
"""


def _busy(e, n=1):
    """The n-th busiest director's id (one value)."""
    people = e.where("type = 'directed'").groupBy("head_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "head_id").limit(n).collect()
    return people[-1]["head_id"]


@query(E + "SELECT p AS answer_id FROM directed WHERE m = 'O:1'")
def plan_directors(spark, d):
    return sets.directors(edges(spark, d), "O:1")


@query(E + "SELECT a.m AS answer_id FROM acted a JOIN acted b ON a.m = b.m AND a.p = 'S:1' AND b.p = 'S:2'")
def plan_cofilm(spark, d):
    return sets.cofilm(edges(spark, d), "S:1", "S:2")


@query(E + "SELECT a.m AS answer_id FROM acted a JOIN directed b ON a.m = b.m WHERE b.p = (SELECT p FROM busy) AND a.p = (SELECT min(x.p) FROM acted x JOIN directed y ON x.m = y.m WHERE y.p = (SELECT p FROM busy))")
def plan_director_actor(spark, d):
    e = edges(spark, d)
    director = _busy(e)
    films = e.where((F.col("type") == "directed") & (F.col("head_id") == director)).select("tail_id")
    actor = e.where("type = 'acted_in'").join(films, "tail_id", "left_semi").agg(F.min("head_id")).first()[0]
    return sets.director_actor(e, director, actor or "")


@query(E + "SELECT a.p AS answer_id, count(*) AS films, min(a.m) AS first_film, max(a.m) AS last_film FROM acted a JOIN directed b ON a.m = b.m WHERE b.p = (SELECT p FROM busy) GROUP BY a.p HAVING count(*) >= 2")
def plan_repeated_cast(spark, d):
    e = edges(spark, d)
    films = e.where((F.col("type") == "directed") & (F.col("head_id") == _busy(e))).select("tail_id")
    cast = e.where("type = 'acted_in'").join(films, "tail_id", "left_semi")
    return cast.groupBy(F.col("head_id").alias("answer_id")).agg(F.count("*").alias("films"), F.min("tail_id").alias("first_film"), F.max("tail_id").alias("last_film")).where("films >= 2")


@query(E + "SELECT DISTINCT a.p AS answer_id FROM acted a JOIN directed b ON a.m = b.m AND b.p = (SELECT p FROM busy) WHERE a.p IN (SELECT c.p FROM acted c JOIN directed e ON c.m = e.m AND e.p = (SELECT p FROM busy2))")
def plan_director_overlap(spark, d):
    e = edges(spark, d)
    return sets.director_overlap(e, _busy(e), _busy(e, 2))


@query(E + """, cast_ AS (SELECT a.p, a.m FROM acted a JOIN directed b ON a.m = b.m WHERE b.p = (SELECT p FROM busy)),
pairs AS (SELECT x.p, x.m AS m1, y.m AS m2, row_number() OVER (PARTITION BY x.p ORDER BY x.m, y.m) AS r FROM cast_ x JOIN cast_ y ON x.p = y.p AND x.m < y.m)
SELECT p AS answer_id, r::INT AS rank, m1, m2 FROM pairs WHERE r <= 64""")
def proof_pairs(spark, d):
    e = edges(spark, d)
    return sets.proof_pairs(e, _busy(e))


@query(E + """, e AS (SELECT p AS head_id, 'acted_in' AS type, m AS tail_id FROM acted UNION ALL SELECT p, 'directed', m FROM directed),
f AS (SELECT DISTINCT tail_id FROM e WHERE head_id IN ('S:1', 'S:2'))
SELECT DISTINCT e.* FROM e WHERE head_id IN ('S:1', 'S:2') OR tail_id IN (SELECT tail_id FROM f)""")
def plan_scope(spark, d):
    return sets.scope(edges(spark, d), ["S:1", "S:2"])


def _mask(e):
    """The stand-in mask: edges of every seventh order."""
    return e.where(F.substring("tail_id", 3, 20).cast("long") % 7 == 3)


@query(E + """, whole AS (SELECT a.m FROM acted a JOIN acted b ON a.m = b.m AND a.p = 'S:1' AND b.p = 'S:2'),
seen AS (SELECT m FROM whole WHERE substr(m, 3)::BIGINT % 7 <> 3)
SELECT w.m AS answer_id, s.m IS NOT NULL AS still_found FROM whole w LEFT JOIN seen s ON w.m = s.m""")
def masked_answer_delta(spark, d):
    e = edges(spark, d)
    whole = sets.cofilm(e, "S:1", "S:2")
    seen = sets.cofilm(mask_edges(e, _mask(e), sized=False), "S:1", "S:2").withColumn("still_found", F.lit(True))
    return whole.join(seen, "answer_id", "left").select("answer_id", F.coalesce("still_found", F.lit(False)).alias("still_found"))


@query(E + """, hits AS (SELECT a.p, a.m, b.p AS dir FROM acted a JOIN directed b ON a.m = b.m WHERE b.p = (SELECT p FROM busy)),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY m) AS n FROM hits)
SELECT p AS head_id, 'acted_in' AS type, m AS tail_id FROM r WHERE n > 1""")
def mask_derivation(spark, d):
    from ..operators.evaluation import derive_count_mask

    e = edges(spark, d)
    films = e.where((F.col("type") == "directed") & (F.col("head_id") == _busy(e))).select("tail_id")
    return derive_count_mask(e.where("type = 'acted_in'").join(films, "tail_id", "left_semi"))


@query(E + """, top_ AS (SELECT p, min(m) AS film, count(*) AS n FROM acted WHERE p IN ('S:1', 'S:2', 'S:3', 'S:4', 'S:5', 'S:6') GROUP BY p)
SELECT x.p AS a, y.p AS b, count(i.m) = 0 AS disjoint FROM top_ x JOIN top_ y ON x.p < y.p
LEFT JOIN (SELECT a.p AS pa, b.p AS pb, a.m FROM acted a JOIN acted b ON a.m = b.m WHERE a.p < b.p) i ON i.pa = x.p AND i.pb = y.p
GROUP BY x.p, y.p""")
def gold_hard_negative(spark, d):
    """For pairs of a few people: whether they share no film."""
    names = [f"S:{i}" for i in range(1, 7)]
    acted = edges(spark, d).where((F.col("type") == "acted_in") & F.col("head_id").isin(names)).select(F.col("head_id").alias("p"), "tail_id")
    shared = acted.select(F.col("p").alias("a"), "tail_id").join(acted.select(F.col("p").alias("b"), "tail_id"), "tail_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    people = acted.select("p").distinct()
    pairs = people.select(F.col("p").alias("a")).join(people.select(F.col("p").alias("b")), F.col("a") < F.col("b"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.col("n").isNull().alias("disjoint"))
