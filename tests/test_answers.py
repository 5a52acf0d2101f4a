"""Anchors, plans from questions, evidence, repair, fusion, contexts, scores."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumengraph.operators import anchors as A
from lumengraph.operators import context as X
from lumengraph.operators import evaluation as B
from lumengraph.operators import evidence as E
from lumengraph.operators import fusion as Fu
from lumengraph.operators import repair as R
from lumengraph.operators import vectors as V
from lumengraph.plans.grammar import Plan, Subject, parse

ANN, BOB, FILM = Subject("p1", "Person", ("安娜", "Ann")), Subject("p2", "Person", ("鲍勃",)), Subject("f1", "Movie", ("流星",))
ENTITIES = [("p1", "Person", ["安娜"]), ("p2", "Person", ["鲍勃"]), ("f1", "Movie", ["流星"]), ("f2", "Movie", ["流星雨"])]


@pytest.mark.parametrize(
    ("question", "plan"),
    [
        ("《流星》的导演是谁", Plan("directors", ("f1",), "Person")),
        ("与安娜合作至少三次的演员，影片有哪些", Plan("repeated_cast", ("p1",), "Person", 3)),
        ("安娜和鲍勃共同出演了哪些电影", Plan("cofilm", ("p1", "p2"), "Movie")),
        ("鲍勃和安娜是否一起出演", Plan("cofilm", ("p2", "p1"), "Movie", boolean=True)),
        ("鲍勃出演、安娜执导的电影", Plan("director_actor", ("p1", "p2"), "Movie")),
        ("哪些演员既出现在安娜执导又出现在鲍勃执导的影片", Plan("director_overlap", ("p1", "p2"), "Person")),
        ("安娜和鲍勃2003年一起出演", None), ("安娜和鲍勃的票房", None), ("安娜", None), ("安娜、鲍勃", None),
    ],
)
def test_grammar(question, plan):
    assert parse(question, [ANN, BOB, FILM]) == plan


def test_large_dictionaries_are_joined(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcabcdab"), (1, "xbcd"), (2, None), (3, ""), (4, "zzz")], "k int, t string")
    surfaces = spark.createDataFrame([("ab",), ("abc",), ("bcd",), ("cd",), ("zz",), ("a",)], "surface string")
    one = sorted(map(tuple, A.mentions(texts, "k", "t", surfaces).collect()))
    monkeypatch.setattr(A, "TRIE_SURFACES", 2)
    assert sorted(map(tuple, A.mentions(texts, "k", "t", surfaces).collect())) == one
    assert (1, 0, "abc") in one and (1, 7, "ab") in one


def test_leftmost_longest_scan(spark):
    trie = A.build_trie(["流星", "流星雨", "雨伞"])
    assert A.scan("流星雨伞流星", trie) == [(0, "流星雨"), (4, "流星")]
    q = spark.createDataFrame([(1, "流星雨和安娜"), (2, "完全不同")], "query_id int, question string")
    nodes = spark.createDataFrame([("a", "流星", "Movie", ["流星雨"]), ("b", "流星雨", "Movie", None), ("c", " 安娜 ", "Person", ["x"])], "id string, name string, type string, aliases array<string>")
    got = A.resolve(q, A.surface_table(nodes)).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(1, "a"), (1, "b"), (1, "c")]


@pytest.mark.parametrize("text", ["安娜和流星一起出现。", "安娜没有出演《流星》。", "安娜原定主演《流星》。", "安娜谈到鲍勃主演的另一部《未知》。", "安娜观看了《流星》。", "最佳导演奖安娜，《流星》。", "安娜参加了《流星》的活动。"])
def test_no_relation_from_weak_texts(text):
    assert E.role_spans("doc", "", text, E.Dictionary.of(ENTITIES)) == {}


def test_role_sentences_give_exact_spans(spark):
    text = "前言。《流星》由安娜执导，鲍勃主演。《流星雨》导演：鲍勃。"
    found = E.role_spans("doc", "", text, E.Dictionary.of(ENTITIES))
    assert set(found) == {("p1", "directed", "f1"), ("p2", "acted_in", "f1"), ("p2", "directed", "f2")}
    a, z = found["p1", "directed", "f1"]
    assert text[a:z] == "《流星》由安娜执导，鲍勃主演。"
    bio = E.role_spans("person_actor_p2", "", "2004年，为《流星》中的角色配音。", E.Dictionary.of(ENTITIES))
    assert set(bio) == {("p2", "acted_in", "f1")}
    record = "鲍勃是数据集中的演员。参演或关联的影片包括：《流星》、《无名》、《流星雨》。"
    chunks = spark.createDataFrame([("person_actor_p2", "k", "", record, 17), ("other", "k2", "", record, 0)], "doc_id string, chunk_id string, title string, text string, char_offset int")
    rows = E.verify(chunks, ENTITIES).collect()
    assert {(r["head_id"], r["tail_id"], r["confidence"], r["char_start"]) for r in rows} == {("p2", "f1", 0.65, 17), ("p2", "f2", 0.65, 17)}
    assert E.verify(chunks, ENTITIES, records=False).count() == 0


NAMES = {"p1": "安娜", "p2": "鲍勃", "f1": "流星"}
PLAN = Plan("cofilm", ("p1", "p2"), "Movie")


def test_minmax_rrf_and_fusion(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (2, "c", 5.0)], "query_id int, chunk_id string, semantic double")
    assert {r[0]: r[1] for r in df.select("chunk_id", Fu.minmax(F.col("semantic"), "query_id")).collect()} == {"a": 0.0, "b": 1.0, "c": 1.0}
    graph = spark.createDataFrame([(1, "a", 1.0)], "query_id int, chunk_id string, graph double")
    got = Fu.weighted(df, df, graph, 0.65, 0.35, 5).collect()
    assert {(r["chunk_id"], r["rank"], r["score"]) for r in got} == {("b", 1, 0.65), ("a", 2, 0.35), ("c", 1, 0.65)}
    lists = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 1, "b")], "query_id int, rank int, chunk_id string")
    assert [r["chunk_id"] for r in Fu.reciprocal_ranks(lists).orderBy("rank").collect()] == ["b", "a"]


def test_context_prefixes_against_a_loop(spark):
    import random

    rng = random.Random(2)
    rows, want = [], {}
    for q in range(60):
        sizes = [rng.randint(0, 30) for _ in range(8)]
        rows += [(q, i, "x" * n) for i, n in enumerate(sizes)]
        used = 0
        for i, n in enumerate(sizes):
            if used + n > 70:
                break
            want[q, i] = f"S{i + 1}"
            used += n + 1
    df = spark.createDataFrame(rows, "query_id int, ord int, block string")
    none = spark.createDataFrame([], "query_id int, chars long")
    assert {(r["query_id"], r["ord"]): r["marker"] for r in X.passage_budget(df, none, 70).collect()} == want


def test_set_scores_with_empty_sets(spark):
    q = spark.createDataFrame([(i,) for i in range(4)], "question_id int")
    p = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "x")], "question_id int, item string")
    g = spark.createDataFrame([(0, "a"), (2, "y")], "question_id int, item string")
    got = {r["question_id"]: (r["precision"], r["recall"], r["f1"], r["exact"]) for r in B.set_prf(p, g, q).collect()}
    assert got == {0: (0.5, 1.0, 0.666667, 0.0), 1: (0.0, 0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (1.0, 1.0, 1.0, 1.0)}


def covered(spark, cases, surfaces, short, titles=False):
    answers = spark.createDataFrame(cases, "answer_id int, text string")
    own = spark.createDataFrame(surfaces, "surface string, owner string")
    allowed = spark.createDataFrame(short, "answer_id int, owner string")
    out = {}
    for r in B.entity_cover(answers, own, allowed, titles).collect():
        out.setdefault(r["answer_id"], set()).add(r["owner"])
    return out


def test_entity_cover(spark):
    surfaces = [("流星雨", "f2"), ("流星", "f1"), ("安娜", "p1")]
    assert covered(spark, [(1, "流星雨和安娜"), (2, "流星雨和安娜"), (3, None), (4, "")], surfaces, [(2, "f1"), (2, "p1")]) == {1: {"f2"}, 2: {"f2", "p1"}}
    # two covered halves aren't one covering span; titles count in their marks
    assert covered(spark, [(1, "abcdef")], [("abcd", "x"), ("cdef", "y"), ("bcd", "z")], []) == {1: {"x", "y"}}
    assert covered(spark, [(1, "《A-B》")], [("A B", "t")], [(1, "t")], titles=True) == {1: {"t"}}
    assert covered(spark, [(1, "abc")], [], []) == {} and covered(spark, [], surfaces, []) == {}


def test_entity_cover_of_random_texts(spark):
    """Against every set of places: a place counts if no place of another eligible surface holds it."""
    rng = random.Random(5)
    cases = [(i, "".join(rng.choice("abAB -") for _ in range(rng.randrange(25)))) for i in range(150)]
    surfaces = sorted({("".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))), f"o{rng.randrange(12)}") for _ in range(25)})
    short = [(i, f"o{rng.randrange(12)}") for i in range(0, 150, 2)]
    want = {}
    for i, text in cases:
        plain = "".join(c for c in text.lower() if c.isalnum())
        mine = {o for j, o in short if j == i}
        ok = {s for s, _ in surfaces if len(s) > 2 or (len(s) == 2 and any(x == s and o in mine for x, o in surfaces))}
        spans = {(m.start(), m.end(), s) for s in ok for m in re.finditer(s, plain)}
        free = {s for a, b, s in spans if not any(c <= a and b <= d and (c, d) != (a, b) for c, d, _ in spans)}
        if free:
            want[i] = {o for s, o in surfaces if s in free}
    assert covered(spark, cases, surfaces, short) == want


def test_canonical_endpoints(spark):
    ids = spark.createDataFrame([("Q1", "Other"), ("X", "The  Film!"), ("anna", None), ("Y", "unknown"), ("Y", "unknown")], "raw_id string, name string")
    surfaces = spark.createDataFrame([("the film", "Q2"), ("The-Film", "Q3"), ("Anna", "Q4")], "surface string, owner string")
    got = B.canonical_endpoints(ids, spark.createDataFrame([("Q1",)], "id string"), surfaces).collect()
    assert sorted(map(tuple, got)) == [("Q1", "Q1"), ("X", "Q2"), ("X", "Q3"), ("anna", "Q4")]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, [0.6, 0.8])], "id int, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [(r["id"], r["rank"]) for r in V.search(v, q, 4).orderBy("rank").collect()] == [(1, 1), (2, 2), (4, 3)]
    wanted = spark.createDataFrame([(9, 3), (9, 3), (9, 77)], "query_id int, id int")
    assert [(r["id"], round(r["score"], 6)) for r in V.score_candidates(v, q, wanted).collect()] == [(3, -1.0)]
    bad = spark.createDataFrame([(9, [1.0])], "query_id int, embedding array<float>")
    with pytest.raises(Exception, match="vector sizes differ"):
        V.search(v, bad, 1).collect()
    assert v.select(V.normalise(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_bounded_negatives_and_answer_texts():
    yes_no = Plan("cofilm", ("p1", "p2"), "Movie", boolean=True)
    seen, chunks = {"p1": {"f1"}, "p2": {"f2"}}, {"p1": ["a"], "p2": ["b"]}
    assert R.bounded_negative(yes_no, seen, chunks, 1, 6, True)
    assert not R.bounded_negative(PLAN, seen, chunks, 1, 6, True)
    assert not R.bounded_negative(yes_no, seen | {"p2": None}, chunks, 1, 6, True)
    assert not R.bounded_negative(yes_no, seen | {"p2": {"f1"}}, chunks, 1, 6, True)
    assert not R.bounded_negative(yes_no, seen, chunks, 1, 1, True) and not R.bounded_negative(yes_no, seen, chunks, 0, 6, True)
    assert R.answer_text(PLAN, {"f1": ()}, NAMES) == "流星。" and "没有找到" in R.answer_text(PLAN, {}, NAMES)


def test_ontology():
    from lumengraph.sources.ontology import Ontology

    o = Ontology.default()
    assert o.relation_type("执导") == o.relation_type("Directed") == "directed" and o.relation_type("acted in") == "acted_in"
    assert o.entity_type("影片") == o.entity_type("movie") == "Movie" and o.entity_type("x") is None
    assert o.problem("Person", "directed", "Movie") is None and o.problem("Movie", "directed", "Movie") and o.problem("Person", "x", "Movie")
    for bad in ({}, {"entity_types": {"A": {}}, "relation_types": {"r": {"domain": ["A"]}}}, {"entity_types": {"A": {}}, "relation_types": {"r": {"domain": ["A"], "range": ["B"]}}}):
        with pytest.raises(ValueError):
            Ontology.from_dict(bad)


def test_engine_methods_and_masks(spark, sf):
    from lumengraph import service
    from lumengraph.catalogue.repair import _engine

    engine = _engine(spark, sf)
    assert service.available() == ["expand", "gap_repair", "hybrid", "ppr", "vector"]
    out = service.ask(engine, "What does Supplier 7 deliver?", "vector", 3)
    assert len(out["citations"]) == 3 and out["citations"][0]["marker"] == "S1"
    with pytest.raises(KeyError):
        service.ask(engine, "x", "none")
