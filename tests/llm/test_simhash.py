import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lumengraph.llm import simhash as S
from lumengraph.llm.textbytes import xxh64_spans


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é你 \t\n.\x0b", max_size=80)), max_size=6))
def test_fingerprints(texts):
    got = S.simhash_batch(pa.array(texts, pa.string()))
    assert [int(x) for x in got] == [fingerprint(t) for t in texts]


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=8))
def test_xxh64_of_spans(parts):
    ends = np.cumsum([len(p) for p in parts])
    got = xxh64_spans(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, seed=42) for p in parts]


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:20]:  # chains of near fingerprints, and a big group
        for _ in range(6):
            b = int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            fps.append(b)
    for k in range(300):
        fps.append(int(base[0]) ^ (1 << (k % 64)) ^ (1 << (k % 61)))
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    stars = {r["node"]: r["root"] for r in S.components(S.link_forest(nodes, 3, block=64)).collect()}
    want = groups(fps, list(range(len(fps))))
    got = [stars.get(f, f) for f in signed]
    assert len({(w, g) for w, g in zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_whole_operator_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in rows], groups([fingerprint(r[1]) for r in rows], [r[0] for r in rows]), strict=True))
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs).collect()}
    assert got == want


def test_odd_rows(odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = groups([r["fp"] & (2**64 - 1) for r in rows], [r["doc_id"] for r in rows])
    assert [r["component_id"] for r in rows] == want
    assert S.near_duplicates(no_docs).count() == 0
    kept = S.first_of_groups(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {1, 3} <= {r["doc_id"] for r in kept.collect()} and 4 not in {r["doc_id"] for r in kept.collect()}


def test_one_row_of_each_group_stays(spark):
    """Rows without ids, repeated rows, and an id that is the smallest of one group and a member of another."""
    text, other = "one two three four five six seven", "quite another text of some eight or nine words"
    rows = [(None, "no id but a text of its own here", "a"), (None, "no id but a text of its own here", "b"), (7, text, "c"), (7, text, "c"), (3, text, "d"), (7, other, "e"), (9, other, "f"), (None, text, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `root` string").repartition(3)
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in S.first_of_groups(docs).collect()))
    assert kept == sorted([(0, rows[0][1]), (3, text), (7, other)])


def test_keys_with_many_rows_are_sent_to_all_tasks(spark):
    from pyspark.sql import functions as F

    from lumengraph.llm.common import join_hot

    left = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("k"), "k"))
    got = join_hot(left, right, "k", "n", 5000)
    assert got.count() == 5000 and got.where("name <> 'k' || k").count() == 0
    assert sorted(got.columns) == ["id", "k", "name"]
