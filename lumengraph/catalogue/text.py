"""Cleaning, chunking and markup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as K
from ..functions import cleaning as C
from ..functions import wikitext as T
from ..session import table
from . import query

WSQ = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NNQ = WSQ.replace(r"\n", "", 1)


def clean_sql(docs: str) -> str:
    """CTEs ending in ``cleaned`` (doc_id, t) for the rows (doc_id, text) of ``docs``."""
    return rf"""ends AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?:\[\d+\]|\[[a-z]\])', '', 'g') AS t FROM {docs}),
plain AS (SELECT doc_id, regexp_replace(t, '[\x00-\x08\x0E-\x1B\x7F-\x{{84}}\x{{86}}-\x{{9F}}\x{{AD}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g') AS t FROM ends),
stripped AS (SELECT doc_id, regexp_replace(t, '^[{WSQ}]+|[{WSQ}]+$', '', 'g') AS t FROM plain),
cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[{NNQ}]*\n[{WSQ}]*', chr(10), 'g'), '[{NNQ}]+', ' ', 'g') AS t FROM stripped)"""


@query(f"WITH {clean_sql('documents')} SELECT doc_id, md5(t) AS digest, length(t)::INT AS size FROM cleaned")
def text_clean(spark, d):
    t = C.clean(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).alias("size"))


@query(r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s).{199,}?[.!?]|.+$') AS s FROM documents)
SELECT doc_id, len(s)::INT AS pieces, max_len::INT AS longest FROM p, LATERAL (SELECT max(length(x)) AS max_len FROM unnest(s) AS u(x)) m""")
def chunk_split(spark, d):
    s = K.split_after(F.col("text"), ".!?", 200)
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("pieces"), F.array_max(F.transform("s", F.length)).alias("longest"))


def chunk_sql(texts: str, target: int = K.TARGET, longest: int = K.LONGEST, shortest: int = K.SHORTEST) -> str:
    """CTEs ending in ``chunk`` (id, seq, off, body) for the rows (id, t) of ``texts``: pieces at three levels by running lengths, then a fold."""

    def pieces(source: str, breakers: str) -> str:
        cut = f"CASE WHEN length(t) > {longest} THEN regexp_extract_all(t, '(?s).{{{target - 1},}}?[{breakers}]|.+$') ELSE [t] END"
        return f"""SELECT id, off + coalesce(sum(length(x)) OVER (PARTITION BY id, off ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, x AS t
  FROM (SELECT id, off, unnest(c) AS x, generate_subscripts(c, 1) AS k FROM (SELECT id, off, {cut} AS c FROM {source}))"""

    return rf"""line AS (SELECT id, unnest(c) AS x, generate_subscripts(c, 1) AS k FROM (SELECT id, regexp_extract_all(t, '[^\n]+|\n+') AS c FROM {texts})),
paragraph AS (SELECT id, off::BIGINT AS off, x AS t FROM (SELECT id, x, coalesce(sum(length(x)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM line) WHERE x[1] <> chr(10)),
sentence AS ({pieces("paragraph", K.SENTENCE_ENDS)}),
unit AS MATERIALIZED (SELECT id, off, t, row_number() OVER (PARTITION BY id ORDER BY off) AS k FROM ({pieces("sentence", K.SOFT_BREAKS)})),
fold(id, k, seq, off, body) AS (SELECT id, 1::BIGINT, 0, off, t FROM unit WHERE k = 1 UNION ALL
  SELECT id, k, CASE WHEN joined THEN seq ELSE seq + 1 END, CASE WHEN joined THEN prev ELSE off END, CASE WHEN joined THEN body || repeat(' ', off - prev - length(body)) || t ELSE t END
  FROM (SELECT u.id, u.k, f.seq, u.off, u.t, f.off AS prev, f.body, u.off - f.off - length(f.body) <= 1 AND u.off + length(u.t) - f.off <= {longest} AND (least(length(f.body), length(u.t)) < {shortest} OR length(f.body) < {target}) AS joined
    FROM fold f JOIN unit u ON u.id = f.id AND u.k = f.k + 1)),
chunk AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY seq) - 1)::INT AS seq, off::INT AS off, body FROM (SELECT id, seq, arg_max(off, k) AS off, arg_max(body, k) AS body FROM fold GROUP BY id, seq) WHERE NOT regexp_full_match(body, '[{WSQ}]*'))"""


@query(f"""WITH RECURSIVE texts AS (SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL), {chunk_sql("texts")}
SELECT id AS doc_id, seq, id || '::c' || lpad(seq::VARCHAR, greatest(4, length(seq::VARCHAR))::INT, '0') AS chunk_id, off AS char_offset, length(body)::INT AS size, md5(body) AS digest FROM chunk""")
def chunk_merge(spark, d):
    return K.chunk_rows(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "seq", "chunk_id", "char_offset", F.length("chunk_text").alias("size"), F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


@query()
def offset_maps(spark, d):
    m = C.offset_map()
    x = table(spark, d, "documents").select("doc_id", m(F.col("text")).alias("m"))
    return x.select("doc_id", F.length("m.clean").alias("size"), F.size("m.map").alias("mapped"), C.raw_span(F.col("m.map"), F.lit(0), F.lit(10)).alias("span")).select("doc_id", "size", "mapped", "span.start", "span.end")


@query("""SELECT CASE WHEN trim(source) = '' OR trim(lang) = '' OR text IS NULL OR trim(text) = '' THEN 'missing_field' WHEN n_chars < 80 THEN 'too_short' WHEN doc_id % 10 = 0 THEN 'already_done' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def doc_reject_ledger(spark, d):
    from ..sources.documents import ledger

    docs = table(spark, d, "documents")
    return ledger(docs, required=["source", "lang", "text"], too_short=F.col("n_chars") < 80, done=docs.where("doc_id % 10 = 0").select("doc_id"), key="doc_id").groupBy("reason").agg(F.count("*").alias("n"))


@query()
def html_to_text(spark, d):
    """The markup recipe on web pages: nested script and style regions, then tags."""
    p = table(spark, d, "pages")
    t = T.strip_balanced("<script", "</script>")(F.col("html"))
    t = T.strip_balanced("<style", "</style>")(t)
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "\n")
    return p.select("page_id", T.tidy(t).alias("text")).select("page_id", F.length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(html, 'href="/([^"#]+)"', 1)) AS token FROM pages) SELECT token, count(*) AS n FROM t GROUP BY token""")
def link_harvest(spark, d):
    p = table(spark, d, "pages")
    return p.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"#]+)"'), F.lit(1))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT lang, list_sort(list(n_chars))[(count(*) // 2) + 1] AS upper_median, count(*) AS n FROM documents GROUP BY lang")
def length_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(T.upper_median("n_chars").alias("upper_median"), F.count("*").alias("n"))
