import re

from lumengraph.llm import decontam as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= {str(o) for o in owners if o is not None}
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect()), key=str)


def test_against_brute_force_whole_and_in_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(900, "the and"), (901, "of the in"), (902, None), (903, "--"), (None, "that is"), (900, "the the the the the the the the the the the the")], "item_id long, text string"))
    want = by_hand(docs.select("doc_id", "text").collect(), items.collect())
    assert got(S.contamination(docs, items)) == want
    assert got(S.contamination(docs, items, block_chars=2000)) == want
    assert any(w[2] for w in want)


def test_repetitive_texts(spark):
    docs = [(1, "a b " * 200), (2, "a " * 50), (3, "b a a a a a a a a a a a b"), (4, "a b c")]
    items = [(1, "a a a a a a a a a a a"), (2, "b a b a b a b a b a"), (3, "a b")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(S.contamination(d, i)) == by_hand(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog it sleeps")], "item_id long, text string")
    rows = S.contamination(odd_docs, items).collect()
    assert len(rows) == odd_docs.count() and {r["doc_id"] for r in rows if r["n_hit"]} == {1, 2}
    assert S.contamination(no_docs, items).count() == 0
    assert {r["n_hit"] for r in S.contamination(odd_docs, items.limit(0)).collect()} == {0}
    clean = S.clean_documents(odd_docs, items)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count() - 3


def test_a_benchmark_of_two_blocks_and_repeated_items(spark):
    docs = [(1, "a b c d e f g h i j k l"), (2, "q r s t u v w x y z 1 2 3"), (3, "nothing of either"), (None, "a b c d e f g h i j")]
    items = [(10, "a b c d e f g h i j"), (11, "r s t u v w x y z 1 2")] + [(12, "b c d e f g h i j k")] * 5
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(S.blocks(i, 25))) >= 2
    assert got(S.contamination(d, i, block_chars=25)) == got(S.contamination(d, i)) == by_hand(docs, items)
    for size in (25, 8_000_000):
        assert [r["doc_id"] for r in S.clean_documents(d, i, block_chars=size).collect()] == [3]
