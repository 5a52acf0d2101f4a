from collections import Counter

import pyarrow as pa

from lumengraph.llm import licenses as S
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from tests_llm_words import words  # noqa: E402


def dice(a, b):
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0


def by_hand(text, templates, threshold):
    """All windows of each template's length, or the whole text: which templates have one that matches."""
    w, out = words(text), set()
    for name, t in templates:
        tw = words(t)
        n = min(len(tw), len(w))
        if any(dice(w[i : i + n], tw) >= threshold for i in range(max(len(w) - n + 1, 0))):
            out.add(name)
    return out


TEXTS = [
    "Some prose. Released under the MIT License. More prose.",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in full compliance with the License. You may obtain a copy of it at",
    "We licensed the song under the bridge. All rights were reserved by phone.",
    "ALL RIGHTS RESERVED",
    "This work is licenced under the GNU General Public License, version 3",
    "permission to use copy modify and or distribute this software for any purpose with or without a fee is granted provided that the above copyright notice and this permission notice appear in all copies",
    "", None, "one", "the the the the the the",
]


def test_against_brute_force():
    scanner = S.Scanner()
    found = {}
    for d, name, a, z, score, text in scanner.scan(pa.array(TEXTS, pa.string())):
        assert words(text) == words(TEXTS[d])[a:z] and score >= 0.8
        found.setdefault(d, set()).add(name)
    for d, t in enumerate(TEXTS):
        want = by_hand(t, S.TEMPLATES, 0.8)
        assert bool(want) == bool(found.get(d)) and found.get(d, set()) <= want


def test_planted_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["licences"] for r in S.summary(S.matches(docs)).collect()}
    lines = {"GNU General Public License, version 3": "GPL-3.0", "All rights reserved.": "Proprietary", "CC BY-NC 4.0": "CC-BY-NC-4.0", "under the MIT License.": "MIT", "Apache License, Version 2.0.": "Apache-2.0"}
    for r in docs.collect():
        assert got[r["doc_id"]] == ",".join(sorted({v for k, v in lines.items() if k in r["text"]}))


def test_overlapping_matches_keep_the_best():
    got = list(S.Scanner([("A", "a b c d e f"), ("B", "a b c d e x"), ("C", "d e f g h i")]).scan(pa.array(["a b c d e f g h i"], pa.string())))
    assert [(g[1], g[2], g[3]) for g in got] == [("A", 0, 6)]


def test_odd_rows(odd_docs, no_docs):
    rows = S.summary(S.matches(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(r["n_matches"] == 0 and r["best_dice"] is None for r in rows)
    assert S.matches(no_docs).count() == 0


HEADER = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."


def test_versions_of_a_family_are_told_apart():
    bsd = S._MAY + S._SOURCE + S._BINARY
    cases = {
        HEADER.format("program", "General Public License", "2"): "GPL-2.0",
        HEADER.format("program", "General Public License", "3"): "GPL-3.0",
        HEADER.format("library", "Lesser General Public License", "2.1"): "LGPL-2.1",
        HEADER.format("program", "Affero General Public License", "3"): "AGPL-3.0",
        "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0",
        "Copyright 2020 X. " + bsd + S._AS_IS: "BSD-2-Clause",
        "Copyright 2020 X. " + bsd + S._NAME.format("3.") + S._AS_IS: "BSD-3-Clause",
    }
    found = {d: set() for d in range(len(cases))}
    for d, name, *_ in S.Scanner().scan(pa.array(list(cases), pa.string())):
        found[d].add(name)
    assert list(found.values()) == [{n} for n in cases.values()]


def test_whole_licences_within_prose():
    texts = {n: t for n, t in S.TEMPLATES if len(t) > 5000}
    assert {"Apache-2.0", "GPL-2.0", "LGPL-2.1", "MPL-2.0"} <= set(texts)
    for name in ("Apache-2.0", "GPL-2.0", "LGPL-2.1", "MPL-2.0"):
        w = words(texts[name])
        # without the end, where the notice stands that would be the better match
        body = " ".join(x for k, x in enumerate(w[: int(0.88 * len(w))]) if k % 200)
        got = list(S.Scanner().scan(pa.array(["some prose " * 20 + body + " more prose" * 20], pa.string())))
        assert {g[1] for g in got} == {name} and max(g[3] - g[2] for g in got) > 0.8 * len(w)


def test_matches_are_chosen_like_a_comparison_of_all_pairs():
    """Dice, span and choice against a plain count of every window, on texts made of licence lines and their parts."""
    import random
    import re

    import pyarrow as pa

    rng = random.Random(2)
    notices = [("A", "alpha beta gamma delta epsilon zeta"), ("B", "beta gamma delta epsilon zeta eta theta"), ("C", "one two three four")]
    word = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    scanner = S.Scanner(notices, 0.8)
    for _ in range(120):
        text = " ".join(" ".join(word(t)[: rng.randrange(3, 9)]) if rng.random() < 0.8 else rng.choice(["x", "alpha", "two"]) for _, t in rng.choices(notices, k=rng.randrange(1, 7)))
        w = word(text)
        grams = list(zip(w, w[1:], strict=False))
        found = []
        for t, (name, notice) in enumerate(notices):
            bag = Counter(zip(word(notice), word(notice)[1:], strict=False))
            size = sum(bag.values())
            width = min(size, len(grams))
            for a in range(len(grams) - width + 1 if width else 0):
                dice = 2 * (Counter(grams[a : a + width]) & bag).total() / (width + size)
                if dice >= 0.8:
                    found.append((-dice, -width, a, t, name))
        taken = []
        for dice, width, a, _, name in sorted(found):
            if all(a >= z or a - width + 1 <= b for _, b, z, _ in taken):
                taken.append((name, a, a - width + 1, round(-dice, 9)))
        got = [(name, a, z, round(d, 9)) for _, name, a, z, d, _ in scanner.scan(pa.array([text], pa.string()))]
        assert got == sorted(taken, key=lambda x: x[1])


def test_many_matches_take_linear_time():
    import time

    import pyarrow as pa

    t = time.time()
    assert len(list(S.Scanner().scan(pa.array(["All rights reserved. " * 40_000], pa.string())))) == 40_000
    assert time.time() - t < 30
