"""Scoring and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import answer_body
from ..operators import evaluation as B
from ..session import table
from . import query

G = "g AS (SELECT label AS question_id, vec_id AS item FROM embeddings WHERE vec_id % 3 = 0), p AS (SELECT label AS question_id, vec_id AS item FROM embeddings WHERE vec_id % 4 = 0 AND label < 8)"


@query(f"""WITH {G}, q AS (SELECT DISTINCT label AS question_id FROM embeddings UNION SELECT -1),
n AS (SELECT question_id, count(p.item) AS np, count(g.item) AS ng, count(*) FILTER (p.item IS NOT NULL AND g.item IS NOT NULL) AS tp FROM (SELECT *, item AS k FROM p) p FULL JOIN (SELECT *, item AS k FROM g) g USING (question_id, k) GROUP BY question_id),
c AS (SELECT question_id, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng, coalesce(tp, 0) AS tp FROM q LEFT JOIN n USING (question_id))
SELECT question_id, round(CASE WHEN ng = 0 THEN (np = 0)::INT WHEN np = 0 THEN 0 ELSE tp / np END, 6)::DOUBLE AS precision, round(CASE WHEN ng = 0 THEN (np = 0)::INT ELSE tp / ng END, 6)::DOUBLE AS recall,
round(CASE WHEN ng = 0 THEN (np = 0)::INT WHEN tp = 0 THEN 0 ELSE 2 * tp / (np + ng) END, 6)::DOUBLE AS f1, (CASE WHEN ng = 0 THEN np = 0 ELSE tp = np AND tp = ng END)::INT::DOUBLE AS exact FROM c""")
def set_prf(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("question_id"), F.col("vec_id").alias("item"))
    q = e.select("question_id").distinct().union(spark.range(1).select(F.lit(-1)))
    return B.set_prf(e.where("item % 4 = 0 AND question_id < 8"), e.where("item % 3 = 0"), q)


@query("""WITH g AS (SELECT DISTINCT l_suppkey % 5 AS question_id, l_orderkey % 20 AS path_id, 'S:' || l_suppkey AS h, 'O:' || l_orderkey AS t FROM lineitem),
k AS (SELECT *, t IN (SELECT 'O:' || o_orderkey FROM orders WHERE o_totalprice > 50000) AS hit FROM g),
e AS (SELECT question_id, round(avg(hit::INT), 6) AS edge_recall FROM k GROUP BY question_id),
p AS (SELECT question_id, round(avg(whole::INT), 6) AS path_rate FROM (SELECT question_id, path_id, bool_and(hit) AS whole FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT * FROM e JOIN p USING (question_id)""")
def path_completeness(spark, d):
    li = table(spark, d, "lineitem")
    gold = li.select((F.col("l_suppkey") % 5).alias("question_id"), (F.col("l_orderkey") % 20).alias("path_id"), F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("head_id"), F.lit("acted_in").alias("type"), F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")).alias("tail_id")).distinct()
    good = table(spark, d, "orders").where("o_totalprice > 50000").select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("film"))
    # retrieved with the label and the direction of another convention
    got = gold.join(good, gold["tail_id"] == good["film"], "left_semi").select("question_id", F.col("tail_id").alias("head_id"), F.lit("出演").alias("type"), F.col("head_id").alias("tail_id"))
    return B.path_completeness(gold, got)


ANSWERS = ["结论：无。两人没有共同出演的影片", "有共同出演的影片《甲》", "材料不足，无法判断", "无", "没有共同影片，但存在共同出演", "结论: 无"]


@query("""WITH a AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '结论：无。两人没有共同出演的影片' WHEN 1 THEN '有共同出演的影片《甲》' WHEN 2 THEN '材料不足，无法判断' WHEN 3 THEN '无' WHEN 4 THEN '没有共同影片，但存在共同出演' ELSE '结论: 无' END AS body FROM conversations),
f AS (SELECT *, regexp_matches(body, '(?:无|没有|未发现|不存在).{0,12}(?:共同|同一部|交集)') OR regexp_matches(body, '结论\\s*[：:]\\s*无(?:[^\\p{L}\\p{N}_]|$)') OR body IN ('无', '否') AS denial,
regexp_matches(body, '(?:有|存在).{0,8}(?:共同出演|共同参演|同一部影片)') AS affirmative, regexp_matches(body, '(?:材料|信息|证据).{0,8}(?:不足|不够)|无法(?:判断|确定|作答)') AS insufficient FROM a)
SELECT conv_id, turn, denial, affirmative, insufficient, (denial AND NOT affirmative AND NOT insufficient)::INT::DOUBLE AS correct FROM f""")
def no_answer_score(spark, d):
    kind = (F.col("conv_id") + F.col("turn")) % 6
    body = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), (kind + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", B.no_answer(body).alias("s")).select("conv_id", "turn", "s.*")


@query("""WITH k AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)
SELECT event_type AS method, CASE WHEN GROUPING(kind) = 0 THEN kind::VARCHAR ELSE 'all' END AS kind, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, user_id % 4 AS kind FROM k) GROUP BY GROUPING SETS ((event_type), (event_type, kind))""")
def method_summary(spark, d):
    rows = B.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return B.summary(rows.select(F.col("event_type").alias("method"), (F.col("user_id") % 4).cast("string").alias("kind"), "value"), "value").na.fill("all", ["kind"])


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_wins(spark, d):
    return B.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id % 4 AS kind, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY 1")
def kind_pivot(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.col("user_id") % 4)
    return B.pivot(e, "value", "event_type", "kind", ["click", "purchase", "view"])


@query("""WITH a AS (SELECT user_id, event_type, round(avg(value), 6) AS complete FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, round(avg(value), 6) AS masked FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT *, round(complete - masked, 6) AS drop FROM a JOIN b USING (user_id, event_type)""")
def paired_views(spark, d):
    e = table(spark, d, "events")
    side = lambda r: e.where(F.col("event_id") % 2 == r).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("score"))
    return B.paired(side(0), side(1), ["user_id", "event_type"], "score")


@query("SELECT event_type AS kind, min(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2 LIMIT 6")
def first_per_kind(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), "event_id")
    return B.first_per_kind(e, "kind", ["event_id"])


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN 'Yes ' || chr(10) || t WHEN 1 THEN t ELSE t || chr(10) || 'and' END) AS body FROM c""")
def answer_bodies(spark, d):
    """Every turn as an answer with a marker, an appendix or a quoted source, which its body is without."""
    c, t, kind = table(spark, d, "conversations"), F.coalesce("text", F.lit("")), F.col("turn") % 3
    marked = F.concat(F.lit("Yes [S1]\n"), t)
    appended = F.concat(t, F.lit("\n## 依据：\nnot [S2] this\n"))
    quoted = F.concat(F.lit("- [S3] 原文：not this\n"), t, F.lit("\n[S4]原文: nor this\nand[g12]"))
    return c.select("conv_id", "turn", answer_body(F.when(kind == 0, marked).when(kind == 1, appended).otherwise(quoted)).alias("body"))


@query("SELECT event_type AS method, round(avg(CASE WHEN user_id % 2 = 0 THEN (value > 50)::INT END), 6)::DOUBLE AS gap_recall, round(avg(CASE WHEN user_id % 2 = 1 THEN (value > 50)::INT END), 6)::DOUBLE AS false_positive_rate FROM events GROUP BY 1")
def gap_rates(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 2 == 0).alias("expected_gap"), (F.col("value") > 50).alias("triggered"))
    return B.gap_metrics(e).select("method", F.round("gap_recall", 6).alias("gap_recall"), F.round("false_positive_rate", 6).alias("false_positive_rate"))


@query("""WITH r AS (SELECT DISTINCT l_suppkey % 5 AS question_id, l_suppkey AS h, l_orderkey AS t, l_partkey % 50 AS doc FROM lineitem)
SELECT question_id, count(*) AS accepted FROM r WHERE t % 2 = 0 AND doc % 3 = 0 GROUP BY 1""")
def repair_acceptance(spark, d):
    """Temporary edges that are gold and that a gold document supports."""
    li = table(spark, d, "lineitem")
    r = li.select((F.col("l_suppkey") % 5).alias("question_id"), F.col("l_suppkey").alias("head_id"), F.lit("acted_in").alias("type"), F.col("l_orderkey").alias("tail_id"), (F.col("l_partkey") % 50).alias("doc_id")).distinct()
    return B.accepted_repairs(r, r.where("tail_id % 2 = 0"), r.where("doc_id % 3 = 0")).groupBy("question_id").agg(F.count("*").alias("accepted"))
