import zlib

import pytest
from pyspark.sql import functions as F

from lumengraph.llm import sharding as S


def check(rows, shards):
    sizes = [0] * shards
    slots = {}
    for r in rows:
        sizes[r["shard"]] += 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(sizes) - min(sizes) <= 1
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))


def test_counts_slots_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = S.assign(docs, 8).collect()
    check(rows, 8)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)


def test_equal_texts_split_only_where_a_shard_is_full(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i % 200}") for i in range(1200)], "doc_id long, text string")
    placed = S.assign(docs, 8).join(docs, "doc_id")
    check(placed.collect(), 8)
    per_text = placed.where("text <> 'hot'").groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert per_text <= 8


def test_few_rows_move_when_a_shard_is_added(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    for slack, most in ((0.0, 0.3), (0.25, 0.2)):
        a = S.assign(docs, 8, slack=slack).select("doc_id", F.col("shard").alias("a"))
        b = S.assign(docs, 9, slack=slack).select("doc_id", F.col("shard").alias("b"))
        assert a.join(b, "doc_id").where("a <> b").count() / 4000 < most


@pytest.mark.parametrize("counts", [[0, 0, 9, 0], [3, 0, 0, 0], [1, 5, 2, 4], [0, 0, 0, 0]])
def test_spill_places_every_row_within_the_bounds(counts):
    caps = S.capacities(sum(counts), 2, 0.0)
    plan = S.spill(counts, [0, 1, 0, 1], caps)
    held = [0, 0]
    for n, pieces in zip(counts, plan, strict=True):
        assert sum(p[1] for p in pieces) == n
        for s, k, slot in pieces:
            held[s] += k
            assert slot + k <= caps[s]
    assert held == caps


def test_ring_points_of_a_shard_stay_when_one_is_added():
    assert set(S.ring_points(8, 16)) < set(S.ring_points(9, 16))


def test_odd_rows(odd_docs, no_docs):
    rows = S.assign(odd_docs, 8).collect()
    assert len(rows) == odd_docs.count()
    check(rows, 8)
    assert S.assign(no_docs, 8).count() == 0
