"""Queries that once read a slice of the ids, on small tables whose ids lie beyond those slices."""

import duckdb
import numpy as np
import pytest

from lumengraph import catalogue

from test_catalogue import TABLES, plain

NAMES = """alias_groups anchor_exact answer_groups bridge_paths canonical_collapse citation_prune degree_penalty_adjacency evidence_location
expand_uniform filmography_records graph_chunk_scores graph_components khop_neighbors mask_keys pair_verdict path_completeness
ppr_fixed_iters repair_acceptance role_span_verify""".split()


@pytest.fixture(scope="module")
def wide(sf, tmp_path_factory):
    """240 orders with ids up to 3107, suppliers with ids up to 81."""
    folder = tmp_path_factory.mktemp("wide")
    con = duckdb.connect()
    order, person = "CASE WHEN {0} < 20 THEN {0} ELSE 13 * {0} END AS {0}", "CASE WHEN {0} < 4 THEN {0} ELSE 9 * {0} END AS {0}"
    for t in TABLES:
        keys = {"orders": [order.format("o_orderkey")], "lineitem": [order.format("l_orderkey"), person.format("l_suppkey")], "supplier": [person.format("s_suppkey")]}.get(t)
        rows = {"orders": " WHERE o_orderkey < 240", "lineitem": " WHERE l_orderkey < 240"}.get(t, "")
        con.execute(f"COPY (SELECT * {'REPLACE (' + ', '.join(keys) + ')' if keys else ''} FROM '{sf}/{t}.parquet'{rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def rows_of(df):
    return sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_one_query_of_each():
    assert not [n for n in catalogue.queries() if n.endswith("_whole")]


@pytest.mark.parametrize("name", NAMES)
def test_whole(spark, wide, name):
    folder, con = wide
    rows = rows_of(catalogue.queries()[name](spark, folder))
    got = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    assert rows and rows == sorted(tuple(plain(r[k]) for k in order) for r in got.fetchall())


def test_converged_pagerank_of_the_whole_graph(spark, wide):
    folder, con = wide
    e = con.execute("SELECT 'S:' || l_suppkey, 'O:' || l_orderkey, max(CASE WHEN l_returnflag = 'N' THEN 0.5 ELSE 1.0 END)::DOUBLE FROM lineitem GROUP BY 1, 2 UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey, 1.0 FROM orders").fetchall()
    ids = sorted({x for r in e for x in r[:2]})
    at = {x: k for k, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for a, b, c in e:
        w[at[a], at[b]] = w[at[b], at[a]] = c
    deg = (w > 0).sum(1)
    w /= np.sqrt(np.outer(deg, deg))
    w /= w.sum(1, keepdims=True)
    start = np.zeros(len(ids))
    start[[at["S:1"], at["S:2"]]] = 0.5
    p = start
    for _ in range(200):
        p = 0.85 * p @ w + 0.15 * start
    want = sorted(zip(-p, ids, strict=True))[:50]
    got = catalogue.queries()["ppr_converged"](spark, folder).collect()
    assert len(got) == 50 and all(r["converged"] for r in got)
    assert np.allclose(sorted(-r["score"] for r in got), [s for s, _ in want], atol=1e-7)


def test_queries_without_sql_reach_ids_beyond_the_old_slices(spark, wide):
    folder, con = wide
    every = catalogue.queries()
    assert any(int(r["id"][2:]) % 40 != 1 for r in every["expand_best_first"](spark, folder).collect() if r["id"].startswith("O:"))
    assert max(int(r["chunk_id"][1:]) for r in every["retrieve_vector"](spark, folder).collect()) >= 300
    (n,) = con.execute("SELECT count(DISTINCT l_orderkey % 50) FROM lineitem").fetchone()
    assert len({r["question_id"] for r in every["proof_cover"](spark, folder).collect()}) == n
