"""Cleaning, chunking, markup, sources and streaming."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumengraph.functions import chunking as K
from lumengraph.functions import cleaning as C
from lumengraph.functions import wikitext as T
from lumengraph.sources import documents as D

ODD = ["\r\na\t b　c​d﻿１２Ａｂ[12] x\r", "", "   ", "a\n \n b  c", "𫝈 \n𫝈[3]", "[[1]2]", None]


def test_cleaning_as_columns_equals_the_mapped_form(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab \t\n\r　​\x1c\x85１Ａ[1]𫝈") for _ in range(30)) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.clean(F.col("t")).alias("c"), C.offset_map()(F.col("t")).alias("m")).collect()
    for r in got:
        t = texts[r["i"]]
        assert (r["c"] or "") == r["m"]["clean"] and len(r["m"]["map"]) == len(r["m"]["clean"])
        raw = (t or "").replace("\r\n", "\n").replace("\r", "\n")
        wide = dict(zip(C.FULL_WIDTH, C.HALF_WIDTH, strict=True))
        assert all(c == wide.get(raw[k], raw[k]) or c in " \n" for c, k in zip(r["m"]["clean"], r["m"]["map"], strict=True))


def split_by_hand(text, breakers, limit):
    out, cur = [], ""
    for c in text:
        cur += c
        if c in breakers and len(cur) >= limit:
            out.append(cur)
            cur = ""
    return out + [cur] if cur else out


def merge_by_hand(units, target, longest, shortest):
    out = []
    for off, text in units:
        if out:
            o, p = out[-1]
            gap = off - o - len(p)
            if 0 <= gap <= 1 and len(p) + gap + len(text) <= longest and (len(p) < shortest or len(text) < shortest or len(p) < target):
                out[-1] = (o, p + " " * gap + text)
                continue
        out.append((off, text))
    return [(o, t) for o, t in out if t.strip()]


def test_chunks_against_a_plain_fold(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab 。，！\n𫝈") for _ in range(rng.randint(0, 160))) for _ in range(120)]
    rows = K.chunk_rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), "text", 10, 25, 4).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["char_offset"], r["chunk_text"]))
        assert r["chunk_id"] == f"{r['doc_id']}::c{r['seq']:04d}"
    for i, t in enumerate(texts):
        units, at = [], 0
        for p in t.split("\n"):
            if p:
                if len(p) > 25:
                    o = at
                    for s in split_by_hand(p, K.SENTENCE_ENDS, 10):
                        parts = split_by_hand(s, K.SOFT_BREAKS, 10) if len(s) > 25 else [s]
                        for x in parts:
                            units.append((o, x))
                            o += len(x)
                else:
                    units.append((at, p))
            at += len(p) + 1
        assert got.get(i, []) == merge_by_hand(units, 10, 25, 4)


@settings(max_examples=80)
@given(st.text(alphabet="{}ab", max_size=30))
def test_nested_regions(text):
    out = T.strip_nested(text, "{{", "}}")
    assert "{{" not in out or T.strip_nested(out, "{{", "}}") != out


def test_wikitext(spark):
    raw = "A <!-- x -->'''bold''' {{t|{{u}}}}[[Film (电影)|shown]] [[B]] -{zh-cn:简;zh-tw:繁}- [http://x y] <ref>r</ref>（）\n== 参考资料 ==\nskipped because of its name, long enough to stay\n== Plot ==\n* item one is long enough to be kept as a body text\n| table row\nx"
    df = spark.createDataFrame([("1", "Title", "u", "intro", raw)], "id string, title string, url string, intro string, wikitext string")
    assert df.select(T.to_prose(F.col("wikitext"))).first()[0].split("\n")[0] == "A bold shown B 简 y "
    text = T.assemble(df, "id", "intro", "wikitext").first()["text"]
    assert text == "intro\n\nPlot\nitem one is long enough to be kept as a body text"
    assert T.film_documents(df, 10).first()["doc_id"] == "film_1"
    assert [tuple(r) for r in T.link_targets(df, "wikitext").collect()] == [("Film", 1)]
    people = spark.createDataFrame([("p", "Ann", "u", "", "", ["X", "Y"])], "id string, name string, url string, intro string, wikitext string, filmography array<string>")
    assert T.person_documents(people, "actor", "演员", "参演").first()["text"] == "Ann是数据集中的演员。参演或关联的影片包括：《X》、《Y》。"


def test_answer_body_and_normalise(spark):
    t = "Yes [S1]\n[S2] 原文：quoted\nmore\n## 依据\ngone"
    df = spark.createDataFrame([(t,), (None,)], "t string")
    assert [r[0] for r in df.select(C.answer_body(F.col("t"))).collect()] == ["Yes \nmore", ""]
    assert df.select(C.normalise(F.lit("Ａ b_C！《x》"))).first()[0] == "abcx"


def test_sources_and_rejects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": " 1 ", "title": "t", "entity_type": "x", "text": " keep "}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"doc_id": "2", "title": " ", "entity_type": "x", "text": "y"}))
    ok, bad = D.validate(D.json_folder(spark, str(tmp_path)))
    assert [(r["doc_id"], r["text"]) for r in ok.collect()] == [("1", " keep ")]
    assert sorted(r["reason"] for r in bad.collect()) == ["missing: title", "unreadable"]
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    from pyspark.sql import types as Ty

    good, n = D.json_lines(spark, str(lines), Ty.StructType([Ty.StructField("a", Ty.IntegerType())]), limit=1)
    assert n == 1 and good.count() == 1
    assert D.skip_done(ok, spark.createDataFrame([("1",)], "doc_id string")).count() == 0
    assert D.read_table(spark, str(tmp_path / "none"), D.RAW).count() == 0


def test_stream_of_documents_is_incremental(spark, sf, tmp_path):
    from lumengraph.streaming import ingest

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.where("doc_id < 10").write.parquet(src)
    for more in (None, "doc_id BETWEEN 5 AND 14"):
        if more:
            docs.where(more).write.mode("append").parquet(src)
        s = ingest.document_stream(spark, src, docs.schema)
        ingest.write_chunks(ingest.chunk_stream(s), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("doc_id").distinct().count() == 15
    assert got.groupBy("chunk_id").count().where("count > 1").count() == 0
