"""Graph construction and view queries over the stand-in film graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import views as V
from ..session import acted_raw, cut_lineage, directed_raw, edges, table
from . import query
from .plans import _mask

E = """WITH acted AS (SELECT DISTINCT 'S:' || l_suppkey AS head_id, 'acted_in' AS type, 'O:' || l_orderkey AS tail_id FROM lineitem),
directed AS (SELECT DISTINCT 'C:' || o_custkey AS head_id, 'directed' AS type, 'O:' || o_orderkey AS tail_id FROM orders),
e AS (SELECT * FROM acted UNION ALL SELECT * FROM directed)
"""


@query(E + "SELECT 'dataset-' || sha1(head_id || '|' || type || '|' || tail_id) AS id, head_id, type, tail_id, n FROM (SELECT 'S:' || l_suppkey AS head_id, 'acted_in' AS type, 'O:' || l_orderkey AS tail_id, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'C:' || o_custkey, 'directed', 'O:' || o_orderkey, count(*) FROM orders GROUP BY ALL)")
def graph_edges_dedup(spark, d):
    raw = acted_raw(spark, d).unionByName(directed_raw(spark, d))
    return raw.groupBy("head_id", "type", "tail_id").agg(F.count("*").alias("n")).select(G.relation_id(F.col("head_id"), F.col("type"), F.col("tail_id")).alias("id"), "head_id", "type", "tail_id", "n")


@query("""WITH m AS (SELECT 'N:' || s_nationkey AS id, s_name AS name, 'Entity' AS type, s_suppkey AS ord FROM supplier
UNION ALL SELECT 'N:' || n_nationkey, n_name, 'Nation', 1000000000 + n_nationkey FROM nation),
f AS (SELECT id, arg_min(name, ord) AS name FROM m GROUP BY id),
a AS (SELECT id, name, min(ord) AS o FROM m GROUP BY id, name)
SELECT f.id, f.name, 'Nation' AS type, coalesce(string_agg(a.name, '|' ORDER BY a.o) FILTER (a.name <> f.name), '') AS aliases FROM f JOIN a USING (id) GROUP BY f.id, f.name""")
def graph_nodes_upsert(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("N:"), F.col("s_nationkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("Entity").alias("type"), F.col("s_suppkey").alias("ord"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("type"), (F.lit(1000000000) + F.col("n_nationkey")).cast("long").alias("ord"))
    out = G.upsert_entities(s.unionByName(n).withColumn("aliases", F.array().cast("array<string>")))
    return out.select("id", "name", "type", F.array_join("aliases", "|").alias("aliases"))


@query("""WITH r AS (SELECT 'dataset-' || sha1('C:' || o_custkey || '|placed|' || o_orderstatus) AS id, 'C:' || o_custkey AS head_id, 'placed' AS type, o_orderstatus AS tail_id,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS y, o_orderpriority AS a, o_orderkey AS ord FROM orders)
SELECT id, head_id, type, tail_id, coalesce(arg_min(y, ord), -1) AS start_year, arg_max(a, ord) AS last_priority, count(DISTINCT a) AS evidences FROM r GROUP BY id, head_id, type, tail_id""")
def graph_relations_upsert(spark, d):
    o = table(spark, d, "orders")
    head, tail = F.concat(F.lit("C:"), F.col("o_custkey").cast("string")), F.col("o_orderstatus")
    rows = o.select(
        G.relation_id(head, F.lit("placed"), tail).alias("id"), head.alias("head_id"), F.lit("placed").alias("type"), tail.alias("tail_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("start_year"), F.lit(None).cast("long").alias("end_year"),
        F.col("o_orderpriority").alias("attributes"), F.array("o_orderpriority").alias("evidences"), F.col("o_orderkey").alias("ord"),
    )
    return G.upsert_relations(rows).select("id", "head_id", "type", "tail_id", F.coalesce("start_year", F.lit(-1).cast("long")).alias("start_year"), F.col("attributes").alias("last_priority"), F.size("evidences").cast("long").alias("evidences"))


@query(E + """, pairs AS (SELECT DISTINCT least(head_id, tail_id) AS a, greatest(head_id, tail_id) AS b FROM e),
n AS (SELECT head_id AS id FROM e UNION SELECT tail_id FROM e)
SELECT left(id, 1) AS kind, count(*) AS nodes, round((SELECT 2.0 * count(*) FROM pairs) / (SELECT count(*) FROM n), 2)::DOUBLE AS avg_degree FROM n GROUP BY 1""")
def graph_stats_by_type(spark, d):
    deg = G.degrees(acted_raw(spark, d).unionByName(directed_raw(spark, d)))
    avg = deg.agg(F.round(F.sum("degree") / F.count("*"), 2).alias("avg_degree"))
    return deg.groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(avg))


@query(E + ", pairs AS (SELECT DISTINCT least(head_id, tail_id) AS a, greatest(head_id, tail_id) AS b FROM e), x AS (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) SELECT id, count(*) AS degree FROM x GROUP BY id ORDER BY degree DESC, id LIMIT 25")
def graph_degree_hubs(spark, d):
    return G.degrees(acted_raw(spark, d).unionByName(directed_raw(spark, d))).orderBy(F.desc("degree"), "id").limit(25)


@query("""WITH RECURSIVE pairs AS (SELECT 'N:' || c_nationkey AS a, 'G:' || c_mktsegment AS b FROM customer UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation),
adj AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS seen FROM adj UNION SELECT r.id, adj.b FROM reach r JOIN adj ON r.seen = adj.a)
SELECT id, min(seen) AS component FROM reach GROUP BY id""")
def graph_components(spark, d):
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    tag = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    pairs = c.select(tag("N:", "c_nationkey").alias("a"), tag("G:", "c_mktsegment").alias("b")).union(n.select(tag("N:", "n_nationkey"), tag("R:", "n_regionkey"))).distinct()
    return G.components(pairs, cut_lineage)


@query(E + "SELECT * FROM e WHERE tail_id IN (SELECT 'O:' || o_orderkey FROM orders WHERE o_orderstatus = 'F') AND head_id IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_nationkey < 10)")
def graph_orphans_dropped(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("id"))
    s = table(spark, d, "supplier").where("s_nationkey < 10").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("id"))
    return G.drop_orphans(edges(spark, d), o.unionByName(s)).select("head_id", "type", "tail_id")


@query(E + "SELECT * FROM e WHERE head_id NOT IN ('S:1', 'C:1') AND tail_id NOT IN ('S:1', 'C:1')")
def graph_delete_cascade(spark, d):
    e = edges(spark, d)
    gone = spark.createDataFrame([("S:1",), ("C:1",)], "id string")
    nodes = e.select(F.col("head_id").alias("id")).union(e.select("tail_id")).distinct()
    return G.delete_entities(nodes, e, gone)[1]


@query("""WITH n AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'Q' || s_suppkey ELSE 'NAME:' || s_suppkey END AS id, 'Supplier' AS type, 'n' || (s_suppkey % 7) || CASE WHEN s_suppkey % 2 = 0 THEN ' (film)' ELSE '' END AS name FROM supplier),
k AS (SELECT *, regexp_replace(name, '\\s*[（(](电影|film)[)）]$', '') AS nk FROM n),
g AS (SELECT type, nk, count(*) FILTER (id LIKE 'Q%') AS c, min(id) FILTER (id LIKE 'Q%') AS one FROM k GROUP BY type, nk)
SELECT k.id, CASE WHEN k.id LIKE 'NAME:%' AND g.c = 1 THEN g.one ELSE k.id END AS canonical FROM k JOIN g USING (type, nk)""")
def canonical_collapse(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    nodes = s.select(
        F.when(key % 4 == 0, F.concat(F.lit("Q"), key.cast("string"))).otherwise(F.concat(F.lit("NAME:"), key.cast("string"))).alias("id"), F.lit("Supplier").alias("type"),
        F.concat(F.lit("n"), (key % 7).cast("string"), F.when(key % 2 == 0, " (film)").otherwise("")).alias("name"),
    )
    return G.canonical_ids(nodes)


@query(E + "SELECT * FROM e WHERE substr(tail_id, 3)::BIGINT % 7 <> 3")
def mask_view(spark, d):
    e = edges(spark, d)
    return V.mask_edges(e, _mask(e), sized=False)


@query("""WITH m AS (SELECT DISTINCT 'S:' || l_suppkey AS h, 'O:' || l_orderkey AS t FROM lineitem WHERE l_orderkey % 7 = 3),
x AS (SELECT h, t, unnest(['acted_in', '出演']) AS k FROM m)
SELECT h || '|' || k || '|' || t AS key FROM x UNION SELECT t || '|' || k || '|' || h FROM x""")
def mask_keys(spark, d):
    e = acted_raw(spark, d).distinct()
    return V.mask_keys(_mask(e))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'S:' || l_suppkey AS h, 'O:' || l_orderkey AS t FROM lineitem UNION SELECT 'C:' || o_custkey, 'O:' || o_orderkey FROM orders),
adj AS (SELECT h AS a, t AS b FROM e UNION SELECT t, h FROM e),
walk AS (SELECT 'O:1' AS id, 0 AS depth UNION SELECT adj.b, depth + 1 FROM walk JOIN adj ON walk.id = adj.a WHERE depth < 3)
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id""")
def khop_neighbors(spark, d):
    e = acted_raw(spark, d).unionByName(directed_raw(spark, d))
    return V.khop(e, spark.createDataFrame([("O:1",)], "id string"), 3, cut_lineage)


@query(E + ", n AS (SELECT tail_id AS id FROM e WHERE head_id = 'S:1' UNION SELECT head_id FROM e WHERE tail_id IN (SELECT tail_id FROM e WHERE head_id = 'S:1')) SELECT * FROM e WHERE head_id IN (SELECT id FROM n) AND tail_id IN (SELECT id FROM n)")
def induced_subgraph(spark, d):
    e = edges(spark, d)
    films = e.where("head_id = 'S:1'").select(F.col("tail_id").alias("id")).distinct()
    people = e.join(films, e["tail_id"] == films["id"], "left_semi").select(F.col("head_id").alias("id")).distinct()
    return V.induced(e, films.union(people)).select("head_id", "type", "tail_id")


@query(E + "SELECT DISTINCT a.tail_id AS neighbour FROM e a JOIN e b ON a.tail_id = b.tail_id WHERE a.head_id = 'S:1' AND b.head_id = 'S:3'")
def common_neighbors(spark, d):
    return V.common_neighbours(edges(spark, d), "S:1", "S:3")


@query(E + "SELECT head_id, type, tail_id FROM e WHERE (head_id = 'C:1' AND tail_id = (SELECT min('O:' || o_orderkey) FROM orders WHERE o_custkey = 1))")
def direct_relation(spark, d):
    e = edges(spark, d)
    film = e.where("head_id = 'C:1'").agg(F.min("tail_id")).first()[0] or ""
    return V.direct_edges(e, "C:1", film)


@query("""WITH c AS (SELECT 'S:' || l_suppkey AS head_id, 'O:' || l_orderkey AS tail_id, count(*) AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT head_id AS seed, tail_id, w, row_number() OVER (PARTITION BY head_id ORDER BY w DESC, head_id || '>' || tail_id) AS rank FROM c WHERE head_id IN ('S:1', 'S:2', 'S:3'))
SELECT seed, rank::INT AS rank, tail_id, w FROM r WHERE rank <= 20""")
def per_seed_top_relations(spark, d):
    counted = acted_raw(spark, d).groupBy("head_id", "tail_id").agg(F.count("*").alias("w")).withColumn("id", F.concat_ws(">", "head_id", "tail_id"))
    seeds = spark.createDataFrame([("S:1",), ("S:2",), ("S:3",)], "id string")
    return V.per_seed_top(counted, seeds, F.col("w")).select("seed", "rank", "tail_id", "w")


@query("""WITH b AS (SELECT item_id, split_part(text, ' ', 2) AS needle FROM benchmark), c AS (SELECT doc_id, text, doc_id AS seq FROM documents),
j AS (SELECT b.item_id, c.doc_id, b.needle, strpos(c.text, b.needle) AS pos_, c.text FROM b JOIN c ON c.doc_id % 10 = b.item_id % 10),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (pos_ = 0)::INT, doc_id) AS n FROM j)
SELECT 'e' || item_id AS edge_id, doc_id AS chunk_doc, pos_ > 0 AS located, (CASE WHEN pos_ > 0 THEN pos_ - 1 ELSE 0 END)::INT AS char_start, (CASE WHEN pos_ > 0 THEN pos_ - 1 + length(needle) ELSE length(text) END)::INT AS char_end FROM r WHERE n = 1""")
def evidence_location(spark, d):
    b = table(spark, d, "benchmark").select(F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("edge_id"), F.concat(F.lit("g"), (F.col("item_id") % 10).cast("string")).alias("doc_id"), F.lit(0).alias("priority"), F.expr("split_part(text, ' ', 2)").alias("needle"))
    c = table(spark, d, "documents").select(F.concat(F.lit("g"), (F.col("doc_id") % 10).cast("string")).alias("doc_id"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("chunk_id"), "text", F.lit(0).alias("char_offset"))
    return G.locate_evidence(b, c).select("edge_id", F.col("chunk_id").alias("chunk_doc"), "located", F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"))


@query("""WITH RECURSIVE o AS (SELECT 'Q' || s_suppkey AS id, unnest(['n' || (s_suppkey % 11), 'm' || (s_suppkey % 30)]) AS s FROM supplier),
adj AS (SELECT a.id AS x, b.id AS y FROM o a JOIN o b ON a.s = b.s),
reach AS (SELECT id AS x, id AS y FROM o UNION SELECT r.x, adj.y FROM reach r JOIN adj ON r.y = adj.x)
SELECT x AS id, min(y) AS canonical FROM reach GROUP BY x""")
def alias_groups(spark, d):
    s = table(spark, d, "supplier")
    tag = lambda p, m: F.concat(F.lit(p), (F.col("s_suppkey") % m).cast("string"))
    nodes = s.select(F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("id"), F.array(tag("n", 11), tag("m", 30)).alias("surfaces"))
    return G.alias_groups(nodes, cut_lineage).select("id", "canonical")


@query("""WITH n AS (SELECT 'O:' || o_orderkey AS id, 'Movie' AS type FROM orders UNION ALL SELECT 'S:' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'Company' ELSE 'Person' END FROM supplier)
SELECT e.head_id, e.tail_id FROM (SELECT DISTINCT 'S:' || l_suppkey AS head_id, 'O:' || l_orderkey AS tail_id FROM lineitem) e JOIN n h ON e.head_id = h.id JOIN n t ON e.tail_id = t.id WHERE h.type <> 'Person'""")
def ontology_violations(spark, d):
    from ..sources.ontology import Ontology

    o = table(spark, d, "orders").select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("Movie").alias("type"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 5 == 0, "Company").otherwise("Person").alias("type"))
    return Ontology.default().violations(acted_raw(spark, d).distinct(), o.unionByName(s)).select("head_id", "tail_id")
