"""The jobs as queries over whole tables: each runs twice into one new folder, so what comes back is what reruns leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import graph_tables, ingest_chunks
from jobs.common import read_if_there
from lumengraph.catalogue.text import WSQ, chunk_sql, clean_sql
from lumengraph.session import shared_folder


def job1_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job1_ingest_chunks")
    for _ in range(2):
        ingest_chunks.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    chunks = read_if_there(spark, f"{folder}/out/chunks", ingest_chunks.CHUNKS)
    return chunks.select("doc_id", "lang", "source", "seq", "chunk_id", "char_offset", F.col("chunk_text"))


def job2_graph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job2_graph_tables")
    paths = {k: f"{sf_dir}/{t}.parquet" for k, t in (("films", "orders"), ("cast", "lineitem"), ("actors", "supplier"), ("directors", "customer"))}
    for _ in range(2):
        graph_tables.run(spark, **paths, output=folder)
    day = lambda c: F.col(c).cast("string").alias(c)
    relations = read_if_there(spark, f"{folder}/relations", graph_tables.RELATIONS).select(F.lit("relation").alias("part"), "type", "id", "head_id", "tail_id", F.lit(None).cast("string").alias("name"), "weight", day("first_day"), day("last_day"))
    none = F.lit(None).cast("string")
    nodes = read_if_there(spark, f"{folder}/nodes", graph_tables.NODES).select(F.lit("node").alias("part"), "type", "id", none.alias("head_id"), none.alias("tail_id"), "name", F.col("degree").alias("weight"), none.alias("first_day"), none.alias("last_day"))
    return relations.unionByName(nodes)


_GRAPH_SQL = """WITH node AS (SELECT 'Movie' AS type, 'O:' || o_orderkey AS id, 'Order ' || o_orderkey AS name FROM orders UNION ALL SELECT 'Actor', 'S:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'Director', 'C:' || c_custkey, c_name FROM customer),
r AS (SELECT 'S:' || l_suppkey AS head_id, 'acted_in' AS type, 'O:' || l_orderkey AS tail_id, l_shipdate::DATE AS day FROM lineitem UNION ALL SELECT 'C:' || o_custkey, 'directed', 'O:' || o_orderkey, o_orderdate::DATE FROM orders),
e AS (SELECT head_id, type, tail_id, count(*) AS weight, min(day) AS first_day, max(day) AS last_day FROM r WHERE head_id IN (SELECT id FROM node) AND tail_id IN (SELECT id FROM node) GROUP BY 1, 2, 3),
w AS (SELECT d.head_id, 'worked_with' AS type, a.head_id AS tail_id, count(*) AS weight, min(a.first_day) AS first_day, max(a.last_day) AS last_day FROM e a JOIN e d ON a.tail_id = d.tail_id AND a.type = 'acted_in' AND d.type = 'directed' GROUP BY 1, 2, 3),
deg AS (SELECT id, count(DISTINCT o) AS n FROM (SELECT head_id AS id, tail_id AS o FROM e UNION ALL SELECT tail_id, head_id FROM e) GROUP BY 1)
SELECT 'relation' AS part, type, 'dataset-' || sha1(head_id || '|' || type || '|' || tail_id) AS id, head_id, tail_id, NULL::VARCHAR AS name, weight, first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day FROM (SELECT * FROM e UNION ALL SELECT * FROM w)
UNION ALL SELECT 'node', type, node.id, NULL, NULL, name, coalesce(n, 0), NULL, NULL FROM node LEFT JOIN deg USING (id)"""

_CHUNKS_SQL = rf"""WITH RECURSIVE fine AS (SELECT doc_id, lang, source, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 80
  AND NOT regexp_full_match(coalesce(lang, ''), '[{WSQ}]*') AND NOT regexp_full_match(coalesce(source, ''), '[{WSQ}]*') AND NOT regexp_full_match(text, '[{WSQ}]*')),
{clean_sql("fine")},
texts AS (SELECT doc_id AS id, t FROM cleaned),
{chunk_sql("texts")}
SELECT doc_id, lang, source, seq, doc_id || '::c' || lpad(seq::VARCHAR, greatest(4, length(seq::VARCHAR))::INT, '0') AS chunk_id, off AS char_offset, body AS chunk_text FROM chunk JOIN fine ON fine.doc_id = chunk.id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_ingest_chunks, job2_graph_tables)}


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest_chunks": _CHUNKS_SQL, "job2_graph_tables": _GRAPH_SQL}
