"""Benchmark derivation and the capped neighbourhood against plain versions of one question at a time."""

import random
from collections import deque

import pytest

from lumengraph.operators import benchmark as B
from lumengraph.operators import views as V
from lumengraph.session import cut_to_table

SPECS = "question_id string, kind string, subjects array<string>"
EDGES = "head_id string, type string, tail_id string"


def plain_paths(kind, s, edges):
    led = {p: {f for h, t, f in edges if h == p and t == "directed"} for p in {h for h, *_ in edges} | set(s)}
    acted = {p: {f for h, t, f in edges if h == p and t == "acted_in"} for p in led}
    cast = {a for a in acted if acted[a]}
    if kind == "multi_director":
        return {(p, ((p, "directed", s[0]),)) for p in led if s[0] in led[p]}
    if kind == "cofilm_set":
        return {(f, ((s[0], "acted_in", f), (s[1], "acted_in", f))) for f in acted[s[0]] & acted[s[1]]}
    if kind == "director_actor_films":
        return {(f, ((s[0], "directed", f), (s[1], "acted_in", f))) for f in led[s[0]] & acted[s[1]]}
    if kind == "director_overlap":
        both = {a: [min(led[d] & acted[a], default=None) for d in s] for a in cast}
        return {(a, tuple(x for d, f in zip(s, m, strict=True) for x in ((d, "directed", f), (a, "acted_in", f)))) for a, m in both.items() if None not in m}
    if kind == "repeated_cast":
        first = {a: sorted(led[s[0]] & acted[a])[:2] for a in cast}
        return {(a, tuple(x for f in m for x in ((s[0], "directed", f), (a, "acted_in", f)))) for a, m in first.items() if len(m) == 2}
    d, *pair = s
    m = [min(led[d] & acted[a], default=None) for a in pair]
    if acted[pair[0]] & acted[pair[1]] or None in m:
        return set()
    return {(None, tuple(x for a, f in zip(pair, m, strict=True) for x in ((d, "directed", f), (a, "acted_in", f))))}


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(5)
    people, films = [f"P{i}" for i in range(9)], [f"F{i}" for i in range(14)]
    edges = [(r.choice(people), r.choice(["directed", "acted_in", "acted_in"]), r.choice(films)) for _ in range(60)]
    pick = lambda n: r.sample(people, n)
    specs = [(f"q{i}", k, s) for i, (k, s) in enumerate(
        [("multi_director", [f]) for f in films] + [(k, pick(2)) for k in ("cofilm_set", "director_actor_films", "director_overlap") for _ in range(12)]
        + [("repeated_cast", [p]) for p in people] + [("hard_negative", pick(3)) for _ in range(40)]
    )]
    odd = [("n1", "cofilm_set", [None, "P1"]), ("n2", "repeated_cast", None), ("n3", "multi_director", []), ("n4", "repeated_cast", ["nobody"])]
    return edges, specs, spark.createDataFrame(edges + edges[:9] + [(None, "directed", "F1")], EDGES), spark.createDataFrame(specs + odd, SPECS)


def test_gold_paths_and_masks(spark, world):
    edges, specs, e, s = world
    paths = cut_to_table(B.gold_paths(s, e))
    got = {}
    for r in paths.collect():
        got.setdefault((r["question_id"], r["answer_id"]), []).append((r["place"], (r["head_id"], r["type"], r["tail_id"])))
    want = {(q, a): list(enumerate(steps)) for q, kind, subjects in specs for a, steps in plain_paths(kind, subjects, set(edges))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert {q.kind for q in paths.select("kind").distinct().collect()} == set(B.CONDITIONS)

    views, masked = B.perturbations(s, paths, e)
    hidden = {}
    for r in masked.collect():
        hidden.setdefault(r["question_id"], set()).add((r["head_id"], r["type"], r["tail_id"]))
    for q, kind, subjects in specs:
        answers = plain_paths(kind, subjects, set(edges))
        if kind in ("multi_director", "hard_negative"):
            assert q not in hidden
            continue
        assert bool(answers) == (q in hidden) and all(hidden[q] & set(steps) for _, steps in answers)
        if kind != "director_overlap":  # which other films may still prove
            assert not plain_paths(kind, subjects, set(edges) - hidden.get(q, set()))
    assert {r["question_id"]: r["expected_gap"] for r in views.collect()}["q0"] is False


def test_a_failing_invariant_raises(spark, world):
    _, _, e, _ = world
    edge = {(h, t, f) for h, t, f in world[0] if t == "directed"}
    film = sorted(edge)[0][2]
    s = spark.createDataFrame([("a", "multi_director", [film])], SPECS)
    paths = B.gold_paths(s, e)
    views, masked = B.perturbations(s, paths, e)
    B.require(B.violations(s, paths, views, masked, paths, {"kind": {"multi_director": 1}, "condition": {"complete_control": 1}}))
    twice = s.union(s).union(spark.createDataFrame([("b", "cofilm_set", ["x", "y"])], SPECS))
    found = B.violations(twice, paths, views, masked, paths, {"kind": {"multi_director": 1}})
    assert {(r["question_id"], r["problem"]) for r in found.collect()} == {("a", "repeated id"), ("b", "no answer"), ("b", "no evidence"), (None, "kind cofilm_set: 1 for 0"), (None, "kind multi_director: 2 for 1")}
    with pytest.raises(ValueError, match="repeated id"):
        B.require(found)


def test_evidence_prefers_names_then_aliases_then_person_documents(spark):
    steps = spark.createDataFrame([("q", "p1", "acted_in", "f1"), ("q", "p2", "acted_in", "f1"), ("q", "p3", "acted_in", "f1"), ("q", "p4", "directed", "f1"), ("q", "p5", "acted_in", "f2"), ("r", "p2", "acted_in", "f1")], "question_id string, " + EDGES)
    surfaces = spark.createDataFrame([("p1", 0, "Ann"), ("p1", 1, "A"), ("p2", 0, "Robert"), ("p2", 1, "Bob"), ("p3", 0, "Zoe"), ("p4", 0, "Zed"), ("p5", 0, None), ("p5", 1, ""), ("p6", 0, "Ann")], "head_id string, place int, surface string")
    films = spark.createDataFrame([("f1", "film_f1", "Sky", "A Bob meets Ann, then Bob."), ("f2", "film_f2", "Sea", None)], "tail_id string, doc_id string, title string, text string")
    people = spark.createDataFrame([("p3", "acted_in", 0, "d0", None), ("p3", "acted_in", 1, "d1", "Zoe: Sea, Sky"), ("p3", "acted_in", 2, "d2", "Sky"), ("p4", "acted_in", 0, "d3", "Sky"), ("p5", "acted_in", 0, "d4", "")], "head_id string, type string, place int, doc_id string, text string")
    told, missing = B.gold_evidence(steps, surfaces, films, people)
    got = {(r["question_id"], r["head_id"]): (r["doc_id"], r["char_start"], r["char_end"], r["text"]) for r in told.collect()}
    assert got == {("q", "p1"): ("film_f1", 12, 15, "Ann"), ("q", "p2"): ("film_f1", 2, 5, "Bob"), ("q", "p3"): ("d1", 10, 13, "Sky"), ("r", "p2"): ("film_f1", 2, 5, "Bob")}
    assert {(r["question_id"], r["head_id"]) for r in missing.collect()} == {("q", "p4"), ("q", "p5")}
    # one span, two people of one name: told once
    twins = steps.limit(0).union(spark.createDataFrame([("q", "p6", "acted_in", "f1"), ("q", "p1", "acted_in", "f1")], steps.schema))
    assert [r["head_id"] for r in B.gold_evidence(twins, surfaces, films, people)[0].collect()] == ["p1"]


def plain_neighbourhood(edges, seeds, hops, cap):
    ordered = sorted(edges, key=lambda x: x[2])
    picked = dict.fromkeys(seeds, 0)
    queue = deque(picked.items())
    while queue and len(picked) < cap:
        node, depth = queue.popleft()
        if depth < hops:
            for n in [t for h, t, _ in ordered if h == node] + [h for h, t, _ in ordered if t == node]:
                if n not in picked and len(picked) < cap:
                    picked[n] = depth + 1
                    queue.append((n, depth + 1))
    return list(picked.items())


def test_capped_neighbourhood(spark):
    r = random.Random(2)
    edges = [(r.randrange(30), r.randrange(30), k) for k in range(70)]
    e = spark.createDataFrame(edges, "head_id int, tail_id int, ord int")
    nodes = spark.createDataFrame([(i,) for i in range(31)], "id int")
    asked = {q: r.sample(range(31), 1 + q % 3) for q in range(12)}
    seeds = spark.createDataFrame([(q, k, i) for q, ids in asked.items() for k, i in enumerate([*ids, 99])], "query_id int, place int, id int")
    for hops, cap in ((2, 7), (3, 100), (1, 1)):
        got = {}
        for x in V.neighbourhood(e, nodes, seeds, hops, cap, cut_to_table).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], (x["id"], x["depth"])))
        for q, ids in asked.items():
            assert [x for _, x in sorted(got[q])] == plain_neighbourhood(edges, ids, hops, cap)
            assert [k for k, _ in sorted(got[q])] == list(range(1, len(got[q]) + 1))
    assert not V.neighbourhood(e.limit(0), nodes, seeds.limit(0), 2, 5, cut_to_table).collect()
