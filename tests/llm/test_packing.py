import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumengraph.llm import packing as S
from lumengraph.llm.bpe import Bpe


@pytest.fixture(scope="module")
def bpe():
    return Bpe(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcthe .,!?'0129éÉñßABC\n\t$%*|<>你́\xa0\x1c×", max_size=60), st.text(max_size=12)), max_size=5))
def test_ids_are_the_librarys(bpe, texts):
    texts = [None if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    ids, first = bpe.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == bpe.library.encode(t or "", add_special_tokens=False).ids


def test_ids_of_special_tokens_long_words_and_real_texts(bpe, spark, sf):
    texts = ["a<|endoftext|>b <|startoftext|>", "a" * 5000, "It's we'll I'D", "", "!!! ...", *[r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]]
    ids, first = bpe.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == bpe.library.encode(t, add_special_tokens=False).ids


def cheapest(at, cost, window):
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] for i in range(j) if at[i] >= at[j] - window) + window + cost[j]
    return best[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 9)), min_size=1, max_size=25))
def test_cuts_are_a_cheapest_packing(steps):
    at = np.append(0, np.cumsum([s for s, _ in steps]))
    cost = np.array([0.0, *(c for _, c in steps)])
    cuts = S.best_cuts(at, cost, 64)
    assert all(at[b] - at[a] <= 64 for a, b in zip(cuts, cuts[1:], strict=False)) and cuts[0] == 0 and cuts[-1] == len(at) - 1
    assert sum(64 + cost[c] for c in cuts[1:]) == cheapest(at, cost, 64)


def round_trip(bpe, docs, rows, window):
    want = sorted((bpe.library.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in docs)
    by_doc, sequences = {}, {}
    for r in rows:
        ids = r["ids"]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    return want, by_doc


def test_round_trip(spark, sf, bpe):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = S.pack(docs, with_ids=True).collect()
    want, by_doc = round_trip(bpe, docs.select("doc_id", "text").collect(), rows, 2048)
    assert sorted([t for _, ids in sorted(parts) for t in ids] for parts in by_doc.values()) == want
    tokens = sum(r["length"] for r in rows)
    assert tokens / (2048 * len({r["sequence_id"] for r in rows})) > 0.9


def test_odd_rows(odd_docs, no_docs, bpe):
    rows = S.pack(odd_docs, window=64, with_ids=True).collect()
    round_trip(bpe, odd_docs.select("doc_id", "text").collect(), rows, 64)
    want = sum(len(bpe.library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in odd_docs.select("doc_id", "text").collect())
    assert sum(r["length"] for r in rows) == want
    assert S.pack(no_docs).count() == 0
