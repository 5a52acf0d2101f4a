"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontam, html_extract, licenses, lm, packing, quality, search, sharding, simhash, toxicity, vector_codes
from .common import cut, held_out, table


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=8, vnodes=64, slack=0.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), window=2048, end_id=1)


def op4_blockmax_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, asked, k=10)


def op5_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), modulus=5, remainder=1)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.matches(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.Model(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marks.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), modulus=5, held=0)
    score = F.col("score")
    return toxicity.score_documents(docs, index).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (score >= 0.5).cast("int").alias("predicted"), "evidence")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, shingle=3, seed=42)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors, parts=16, entries=64, rounds=2, scale=256)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, books.components())).encode()).hexdigest()
    coded = vector_codes.encode(vectors, books, keep=("vec_id", "label")).select("row.*", F.lower(F.hex("code")).alias("code"), "error")
    return vector_codes.label_errors(cut(coded), "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bounded_ring, op2_template_text, op3_packing, op4_blockmax_search, op5_ngram_trie, op6_licenses, op7_quality, op8_decontamination, op9_toxicity, op10_simhash, op11_partial_distance, op12_byte_bpe)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SEARCH_SQL = f"""WITH w AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS t FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM w GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1),
g AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS docs, (SELECT sum(n) FROM len) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t),
q AS (SELECT doc_id AS query_id, t, tf * ln(1 + (g.docs - df + 0.5) / (df + 0.5)) AS weight FROM tf JOIN df USING (t), g WHERE doc_id % 50 = 0),
s AS (SELECT query_id, tf.doc_id, round(sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / g.mean))), 6) AS score FROM q JOIN tf USING (t) JOIN len ON len.doc_id = tf.doc_id, g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""

_DECONTAMINATION_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Assignments and means of the codebooks as joins over single components; a distance and an index are one number."""
    steps = [f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS j, v[i] AS x FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT p, r AS e, j, x AS y FROM x WHERE r < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, min(d * {entries} + e) AS m FROM (SELECT r, p, e, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{k} USING (p, j) GROUP BY r, p, e) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT p, e, j, coalesce((s - (s % n + n) % n) // n, y)::BIGINT AS y FROM c{k} LEFT JOIN (SELECT p, m % {entries} AS e, j, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} USING (r, p) GROUP BY 1, 2, 3) USING (p, e, j))""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(lpad(lower(hex(m % {entries})), 2, '0'), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, j)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    """The other operators' hashes, models or windows have no counterpart in SQL; tests hold them to brute force."""
    return {"op4_blockmax_search": _SEARCH_SQL, "op8_decontamination": _DECONTAMINATION_SQL, "op11_partial_distance": _codes_sql()}
