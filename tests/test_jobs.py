"""The jobs: growing input in two runs, failures in between, reruns, odd rows, command lines."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, graph_tables, ingest_chunks, queries

REPO = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, lang string, source string"


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def ingest(spark, at, **more):
    return ingest_chunks.run(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", **more)


def state(spark, at):
    chunks = spark.read.schema(ingest_chunks.CHUNKS).parquet(f"{at}/out/chunks")
    return plain(chunks), plain(spark.read.schema(ingest_chunks.LEDGER).parquet(f"{at}/out/ledger"))


def test_growing_input_is_taken_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("doc_id < 120").write.parquet(f"{tmp_path}/in")
    first = ingest(spark, tmp_path)
    before = state(spark, tmp_path)
    assert first["rows"] == docs.where("doc_id < 120").count() and first["batches"] == 1
    assert ingest(spark, tmp_path) == {"batches": 0, "rows": 0, "accepted": 0, "chunks": 0} and state(spark, tmp_path) == before
    docs.where("doc_id >= 110").write.mode("append").parquet(f"{tmp_path}/in")
    second = ingest(spark, tmp_path)
    chunks, told = state(spark, tmp_path)
    assert second["rows"] == docs.where("doc_id >= 110").count()
    assert [c for c in chunks if c[-2] == 0] == before[0]
    assert sum(r[3] for r in told if r[5] == "already_done") == len([r for r in before[1] if r[5] == "accepted" and r[0] >= 110]) > 0
    # both runs together hold what one run over everything holds
    docs.write.parquet(f"{tmp_path}/all/in")
    ingest(spark, tmp_path / "all")
    without_batch = lambda rows: sorted(r[:-2] + r[-1:] for r in rows)
    assert without_batch(chunks) == without_batch(state(spark, tmp_path / "all")[0])


def test_a_batch_that_failed_is_taken_again(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for at in ("whole", "broken"):
        docs.write.parquet(f"{tmp_path}/{at}/in")
    ingest(spark, tmp_path / "whole")
    put = common.replace_partitions

    def fails(rows, path, *keys):
        if path.endswith("ledger"):
            raise RuntimeError("lost")
        put(rows, path, *keys)

    monkeypatch.setattr(ingest_chunks, "replace_partitions", fails)
    with pytest.raises(Exception, match="lost"):
        ingest(spark, tmp_path / "broken")
    monkeypatch.setattr(ingest_chunks, "replace_partitions", put)
    ingest(spark, tmp_path / "broken")
    assert state(spark, tmp_path / "broken") == state(spark, tmp_path / "whole")


def test_odd_documents(spark, tmp_path):
    long = "Ein Satz über nichts. " * 30
    rows = [(1, long, "de", "a"), (1, long, "de", "a"), (1, "x" * 90, "de", "a"), (2, None, "de", "a"), (3, " 　\n" * 60, "de", "a"), (4, "short", "en", "a"), (5, long, None, "a"), (6, long, "de", "\t"), (None, long, "de", "a"), (7, "word " * 200_000, "en", "b")]
    spark.createDataFrame(rows, DOCS).withColumn("batch", F.lit(9)).withColumn("reason", F.lit("x")).write.parquet(f"{tmp_path}/in")
    got = ingest(spark, tmp_path)
    chunks, told = state(spark, tmp_path)
    by = {}
    for r in told:
        by[r[5]] = by.get(r[5], 0) + r[3]
    assert by == {"accepted": 2, "repeated": 2, "missing_field": 5, "too_short": 1} and got["rows"] == len(rows)
    assert {c[0] for c in chunks} == {1, 7} and sum(len(c[5]) for c in chunks if c[0] == 7) >= 999_000
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/in")
    assert ingest(spark, tmp_path / "none")["rows"] == 0


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"min_chars": 5, "target": 10, "longest": 20, "shortest": 2}))
    spark.createDataFrame([(1, "One two. Three four! Five six seven? Eight.", "en", "a")], DOCS).write.parquet(f"{tmp_path}/in")
    assert ingest(spark, tmp_path, config=f"{tmp_path}/c.json")["chunks"] > 2
    (tmp_path / "c.json").write_text(json.dumps({"min_char": 5}))
    with pytest.raises(ValueError, match="min_char"):
        ingest(spark, tmp_path, config=f"{tmp_path}/c.json")


def test_graph_tables_again_and_changed(spark, tmp_path):
    t = {
        "films": spark.createDataFrame([(1, 7, "2020-01-01"), (2, 7, "2021-01-01"), (3, 8, "2022-01-01"), (4, 9, None)], "o_orderkey long, o_custkey long, o_orderdate string"),
        "cast": spark.createDataFrame([(1, 5, "2020-05-01"), (1, 5, "2020-06-01"), (2, 5, "2021-05-01"), (2, 6, None), (3, 99, "2022-01-01"), (None, 5, None), (88, 5, None)], "l_orderkey long, l_suppkey long, l_shipdate string"),
        "actors": spark.createDataFrame([(5, "Five"), (5, "Cinq"), (6, "Six"), (None, "None"), (10, " ")], "s_suppkey long, s_name string"),
        "directors": spark.createDataFrame([(7, "Seven"), (8, "Eight")], "c_custkey long, c_name string"),
    }
    paths = {k: f"{tmp_path}/{k}" for k in t}
    for k, df in t.items():
        df.write.parquet(paths[k])
    out = f"{tmp_path}/out"

    def tables():
        read = lambda name, schema: plain(spark.read.schema(schema).parquet(f"{out}/{name}").select([c.split()[0] for c in schema.split(", ")]))
        return read("nodes", graph_tables.NODES), read("relations", graph_tables.RELATIONS), read("dangling", graph_tables.RELATIONS)

    counts = graph_tables.run(spark, **paths, output=out)
    first = tables()
    assert counts == graph_tables.run(spark, **paths, output=out) and tables() == first
    nodes, relations, dangling = first
    assert {n[0]: n[1:4] for n in nodes} == {"O:1": ("Order 1", [], 2), "O:2": ("Order 2", [], 3), "O:3": ("Order 3", [], 1), "O:4": ("Order 4", [], 0), "S:5": ("Cinq", ["Five"], 2), "S:6": ("Six", [], 1), "C:7": ("Seven", [], 2), "C:8": ("Eight", [], 1)}
    assert {(r[6], r[1], r[2]): (r[3], str(r[4]), str(r[5])) for r in relations if r[6] != "directed"} == {
        ("acted_in", "S:5", "O:1"): (2, "2020-05-01", "2020-06-01"), ("acted_in", "S:5", "O:2"): (1, "2021-05-01", "2021-05-01"), ("acted_in", "S:6", "O:2"): (1, "None", "None"),
        ("worked_with", "C:7", "S:5"): (2, "2020-05-01", "2021-05-01"), ("worked_with", "C:7", "S:6"): (1, "None", "None"),
    }
    assert {(r[1], r[2]) for r in dangling} == {("S:99", "O:3"), ("S:5", "O:88"), ("C:9", "O:4")}
    t["cast"].where("l_suppkey = 6").write.mode("overwrite").parquet(paths["cast"])
    graph_tables.run(spark, **paths, output=out)
    assert {(r[1], r[2]) for r in tables()[1] if r[6] == "worked_with"} == {("C:7", "S:6")}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "orders", "lineitem", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(df.columns)
    assert plain(df.select(order)) == sorted(want.fetchall(), key=str)


def test_command_line(spark, sf, tmp_path):
    done = subprocess.run([sys.executable, "-m", "jobs.ingest_chunks", "--documents", f"{sf}/documents.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint"], cwd=REPO, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and spark.read.parquet(f"{tmp_path}/out/chunks").count() > 500
