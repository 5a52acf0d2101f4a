import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lumengraph.llm import lm as S


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def by_hand(rows):
    tok = lambda t: ["<s>", *(w.decode() for w in (t or "").encode().lower().split()), "</s>"]
    uni, bi, tri, ctx = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            k = tok(t)
            uni.update(k[1:])
            bi.update(zip(k, k[1:], strict=False))
            tri.update(zip(k, k[1:], k[2:], strict=False))
            ctx.update(k[:-1])
    n, types = sum(uni.values()), len(uni)
    unseen = sum(1 for c in uni.values() if c == 1) / n if n else 1.0
    unseen = min(max(unseen, 0.5 / (n + 1)), 0.5 if n else 1.0)
    weight = lambda c, ab: 1 - ab[0] * c ** -ab[1] if c else 0.0

    def p(u, v, w):
        out = uni[w] / n * (1 - unseen) if uni[w] else unseen
        for seen, whole, ab in ((bi[v, w], ctx[v], S.TRUST2), (tri[u, v, w], bi[u, v] if u else 0, S.TRUST3)):
            t = weight(whole, ab)
            out = t * seen / max(whole, 1) + (1 - t) * out
        return out

    out = []
    for i, t in rows:
        k = tok(t)
        out.append((i, held(i), len(k) - 1, sum(uni[w] > 0 for w in k[1:]), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (types + 1))) for w in k[1:]), sum(math.log10(p(u, v, w)) for u, v, w in zip([None, *k], k, k[1:], strict=False))))
    return sorted(out, key=str)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted((tuple(r) for r in got), key=str), want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-6) and g[6] == pytest.approx(w[6], abs=4e-4 * (w[2] + 1))  # codes are exact to 1/8192 each


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(S.score_documents(docs, shards=7).collect(), by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()]))


def test_odd_rows(odd_docs, no_docs):
    same(S.score_documents(odd_docs).collect(), by_hand([tuple(r) for r in odd_docs.select("doc_id", "text").collect()]))
    assert S.score_documents(no_docs).count() == 0


def test_probabilities_add_up_to_one():
    docs = [(i, t) for i, t in zip([k for k in range(40) if not held(k)], ["a b a c", "b a", "c c a b", "a d a b c"], strict=False)]
    one = [k for k in range(100, 400) if held(k)][0]
    words = ["a", "b", "c", "d", "zzz"]
    for start in ("", "a ", "a b ", "d ", "q q "):
        # p(all of start then w then an end) over w, against p(all of start without an end)
        lines = {w: by_hand([*docs, (one, start + w)]) for w in words}
        got = {w: next(r[6] for r in rows if r[0] == one) for w, rows in lines.items()}
        assert all(math.isfinite(x) for x in got.values())
    # the same model, straight: sums over the next token of any context
    uni, bi, tri = Counter(), Counter(), Counter()
    for _, t in docs:
        k = ["<s>", *t.split(), "</s>"]
        uni.update(k[1:])
        bi.update(zip(k, k[1:], strict=False))
        tri.update(zip(k, k[1:], k[2:], strict=False))
    for u, v in [("a", "b"), ("c", "a"), ("b", "a"), ("zz", "a")]:
        c2, c1 = bi[u, v], sum(n for (x, _), n in bi.items() if x == v)
        t3, t2 = float(S.trust(np.array([c2]), *S.TRUST3)[0]), float(S.trust(np.array([c1]), *S.TRUST2)[0])
        total = sum(t3 * tri[u, v, w] / max(c2, 1) + (1 - t3) * t2 * bi[v, w] / c1 for w in uni) + (1 - t3) * (1 - t2)
        assert total == pytest.approx(1)


def test_split_words_and_pairs_change_nothing(spark, monkeypatch):
    rows = [(i, " ".join(["the", "of"] * (i % 5) + [f"w{i % 17}", "the", "of", f"w{i % 11}", "the"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(S, "HOT", 20)
    monkeypatch.setattr(S, "CHUNK", 600)
    same(S.score_documents(docs, shards=9).collect(), by_hand(rows))


def test_shuffled_input_keeps_scores_with_their_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    one, other = (sorted((r["doc_id"], round(r["score"], 6)) for r in S.score_documents(d, shards=3).collect()) for d in (docs, docs.repartition(7, "text")))
    assert one == other


@given(st.lists(st.integers(0, 10**9), max_size=60))
def test_elias_fano_look_ups(values):
    values = np.array(sorted(set(values)), np.int64)
    e = S.EliasFano.encode(values)
    assert e.decode().tolist() == values.tolist()
    probe = np.unique(np.concatenate([values, values + 1, [0, 5, 2 * 10**9]])).astype(np.int64)
    place = {v: i for i, v in enumerate(values.tolist())}
    assert e.find(probe).tolist() == [place.get(x, -1) for x in probe.tolist()]


def test_dense_and_repeated_pointers():
    values = np.array([0, 0, 0, 1, 1, 7, 7, 7, 8] + [9] * 300 + [400])
    assert S.EliasFano.encode(values).decode().tolist() == values.tolist()


def test_trie_counts_and_files(tmp_path):
    rng = np.random.default_rng(1)
    u, v, w = (rng.integers(1, n, 900).astype(np.uint64) for n in (9, 12, 15))
    trie = S.NgramTrie.build(u, v, np.ones(900, np.int64), np.arange(900), w, np.ones(900, np.int64))
    trie.save(str(tmp_path / "t"))
    pairs, triples = Counter(zip(u.tolist(), v.tolist(), strict=True)), Counter(zip(u.tolist(), v.tolist(), w.tolist(), strict=True))
    mapped = S.NgramTrie.load(str(tmp_path / "t"))
    assert isinstance(mapped.trigrams.successors.high, np.memmap)
    for t in (trie, mapped):
        asked = [(a, b) for a in range(0, 11) for b in range(0, 14)]
        words = np.arange(0, 17, dtype=np.uint64)
        two, three = t.find(np.arange(0, 11, dtype=np.uint64), np.full(11, 14), np.array([b for _, b in asked], np.uint64), np.full(len(asked), 17), np.tile(words, len(asked)))
        assert S.counts_of(two).round(2).tolist() == pytest.approx([pairs[x] for x in asked], rel=2e-3)
        want = [triples[a, b, c] for a, b in asked for c in range(17)]
        assert S.counts_of(three).tolist() == pytest.approx(want, rel=2e-3)
