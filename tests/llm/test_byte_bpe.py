import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumengraph.llm import byte_bpe as S
from lumengraph.llm.queries import op12_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return S.ByteBpe(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(bpe, library, texts):
    ids, first = bpe.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        mine = ids[first[k] : first[k + 1]]
        assert mine.tolist() == library.encode_ordinary(t or "")
        assert bpe.decode(mine)[0].tobytes() == (t or "").encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abtsrevlmd''LD  \n\t\r019.,-éÉ你も　 \x85\xa0́😀𝒜²٣", max_size=40), st.text(st.characters(exclude_categories=("Cs",)), max_size=15)), max_size=6))
def test_ids_are_the_librarys(bpe, library, texts):
    same(bpe, library, texts)


def test_every_character(bpe, library):
    same(bpe, library, ["".join(chr(c) + "a " for c in range(lo, min(lo + 0x8000, 0x110000)) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x110000, 0x8000)])


def test_long_pieces_and_long_texts_in_blocks(bpe, library, monkeypatch):
    rng = np.random.default_rng(5)
    junk = "".join(rng.choice(list("abcdefghij"), 4000))
    texts = ["x" * 513, "x" * 512, "ab" * 3000, "你好世界" * 500, " " * 2000 + "a", junk, (junk[:300] + " ") * 20, ""]
    same(bpe, library, texts)
    monkeypatch.setattr(S, "BLOCK", 700)
    same(bpe, library, [*texts, None, "It's the one's we'll see. " * 400, "", "a b " * 900])
    monkeypatch.setattr(S, "_PLACES", 1 << 17)  # the table of known pieces is started afresh again and again
    same(S.ByteBpe(PATH), library, ["".join(rng.choice(list("abcdefgh  "), 200_000)), "again and again"])


def test_rows_whose_tokens_are_beyond_merges_or_broken(tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bc": 400, b"bcb": 350, b"xyz": 256}
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    same(S.ByteBpe(str(path)), library, ["abc", "bcbc", "xyz", "xyzxyz", "abcbcbcabc", "bc" * 400])
    bpe = S.ByteBpe(str(path))
    with pytest.raises(ValueError):
        bpe.decode(np.array([299]))
    broken = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 3, 4], np.int32)), pa.py_buffer(b"a\xff\xe4\xb8")])
    ids, first = bpe.encode(broken)
    assert bpe.decode(ids)[0].tobytes().decode() == "a��" + "�"


def brute(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op12_byte_bpe(spark, sf).collect()), key=str) == brute(library, docs)


def test_odd_rows(spark, odd_docs, no_docs, library, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op12_byte_bpe(spark, str(tmp_path)).collect()), key=str) == brute(library, odd_docs.select("doc_id", "text").collect())
    assert S.decode(S.encode(no_docs)).count() == 0
    made = spark.createDataFrame([(1, [72, 105]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [bytes(r[0]) if r[0] is not None else None for r in S.decode(made).orderBy("doc_id").select("decoded").collect()][1:] == [None, b""]


def test_nothing_is_shuffled(spark, sf):
    plan = op12_byte_bpe(spark, sf)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
