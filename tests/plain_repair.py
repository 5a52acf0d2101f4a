"""Gap repair of one question in plain Python, by its rules: all claims of read chunks count, whatever the order of reading."""

from itertools import combinations, islice, product

from lumengraph.operators import repair as R

PAIRS = ("cofilm", "director_actor")


def roles(plan):
    kind, subjects = plan[:2]
    return [(s, "acted_in" if kind == "cofilm" or (kind == "director_actor" and k == 1) else "directed") for k, s in enumerate(subjects)]


def in_scope(plan, edges):
    if plan[0] == "directors":
        return {e for e in edges if e[1] == "directed" and e[2] in plan[1]}
    told = {e for e in edges if e[1] in ("acted_in", "directed")}
    films = {e[2] for e in told if e[0] in plan[1]}
    return {e for e in told if e[0] in plan[1] or e[2] in films}


def proofs(plan, edges):
    kind, subjects, minimum = plan[:3]
    films = lambda p, k: sorted(t for h, x, t in edges if h == p and x == k)
    if kind == "directors":
        return {h: [[(h, k, t)]] for h, k, t in edges if k == "directed" and t == subjects[0]}
    (a, role), *_ = roles(plan)
    if kind in PAIRS:
        b = subjects[1]
        return {m: [[(a, role, m), (b, "acted_in", m)]] for m in set(films(a, role)) & set(films(b, "acted_in"))}
    out = {}
    for p in {h for h, k, _ in edges if k == "acted_in"}:
        mine = [[m for m in films(s, "directed") if (p, "acted_in", m) in edges] for s in subjects]
        if kind == "repeated_cast":
            groups = combinations(mine[0], minimum)
            made = [[e for m in g for e in ((a, "directed", m), (p, "acted_in", m))] for g in islice(groups, 64)]
        else:
            made = [list(dict.fromkeys(e for s, m in zip(subjects, g, strict=True) for e in ((s, "directed", m), (p, "acted_in", m)))) for g in islice(product(*mine), 64)]
        if made:
            out[p] = made
    return out


def texts(plan, edges, names, max_queries, enhanced):
    kind, subjects = plan[:2]
    if kind == "directors":
        return [R.DIRECTORS.format(names[subjects[0]])]
    cast = roles(plan)
    films = sorted({t for h, k, t in edges if h in subjects})
    if kind in PAIRS:
        first = [R.TOGETHER[kind].format(*(names[s] for s in subjects))]
        gaps = [f"《{names[m]}》 {names[s]} {R.OF_ROLE[role]}" for m in films for s, role in cast if (s, role, m) not in edges]
    else:
        first, gaps = [R.CAST_OF.format(names[s]) for s in subjects], [R.CAST.format(names[m]) for m in films]
    lists = []
    if enhanced:
        lists = [f"{names[s]} {R.OF_FILMS[role]}" for s, role in cast]
        if kind not in PAIRS:
            n = {}
            for h, k, t in edges:
                if k == "acted_in" and h not in proofs(plan, edges):
                    n.setdefault(h, set()).add(t)
            lists += [f"{names[p]} {R.OF_FILMS['acted_in']}" for p in sorted(n, key=lambda p: (-len(n[p]), p))]
    whole = [f"{names[s]} {R.OF_ROLE[role]} 电影" for s, role in cast]
    return list(dict.fromkeys([*lists[: max(2, max_queries // 2)], *first, *gaps, *whole]))


def cover(options, support, relevance, limit):
    """options: answer -> proofs (lists of edges); an edge that support doesn't list needs no chunk."""
    cited, chosen = set(), {}
    while True:
        prices = []
        for answer, paths in options.items():
            for n, path in enumerate(paths):
                need = []
                for e in path if answer not in chosen else ():
                    if e in support and support[e]:
                        best = min(support[e], key=lambda c: (c not in cited, c not in need, -relevance.get(c, 0.0), c))
                        need += [best] * (best not in need)
                    elif e in support:
                        need = None
                        break
                if answer not in chosen and need is not None and len(cited | set(need)) <= limit:
                    prices.append((len(set(need) - cited), -round(sum(relevance.get(c, 0.0) for c in need), 9), answer, ["|".join(e) for e in path], n, need))
        if not prices:
            return chosen, cited
        *_, answer, _, n, need = min(prices)
        chosen[answer] = n
        cited |= set(need)


def repair(plan, visible, evidence, chunks, names, search, claims, policy="adaptive", top_k=6, search_k=20, max_queries=32, max_rounds=2, audit=40, temporary_edges=True, enhanced=True):
    """chunks: id -> (doc_id, text); evidence: edge -> chunk ids; search(text, k) -> [(chunk, score)]; claims: chunk -> edges."""
    seen = in_scope(plan, visible)
    first = {}
    for e in sorted(seen):
        for c in evidence.get(e, ()):
            if c in chunks:
                first.setdefault(c, e)
    pool = {c: 0.5 for c in sorted(first, key=lambda c: (first[c], c))[:audit]}

    def found():
        told = {(e, c) for c in pool for e in claims.get(c, ())} if temporary_edges else set()
        return {(e, c) for e, c in told if e in in_scope(plan, visible | {e for e, _ in told}) and e not in visible}

    def active(told):
        return in_scope(plan, visible | {e for e, _ in told})

    told = found()
    reasons = [r for r, yes in (("no_complete_proof", not proofs(plan, seen)), ("text_graph_disagreement", bool(told)), ("set_completeness_unverified", not plan[3])) if yes]
    go = policy == "always" or (policy == "adaptive" and bool(reasons))
    if policy == "off":
        told = set()
    asked, rounds = [], 0
    while go and rounds < max_rounds and len(asked) < max_queries:
        queue = [t for t in texts(plan, active(told), names, max_queries, enhanced) if t not in asked]
        now = queue[: min(max(1, max_queries // max_rounds), max_queries - len(asked))]
        if not now:
            break
        for t in now:
            asked.append(t)
            hits = search(t, search_k)
            least = {}
            for c, s in hits:
                pool[c] = max(pool.get(c, 0.0), s)
                doc = chunks[c][0]
                least[doc] = min(least.get(doc, s), s)
            for c, (doc, text) in chunks.items():
                if enhanced and doc in least and "是数据集中的" in text:
                    pool[c] = max(pool.get(c, 0.0), least[doc])
        before, told = {e for e, _ in told}, found()
        rounds += 1
        if {e for e, _ in told} == before and len(now) == len(queue):
            break
    every = active(told)
    options = proofs(plan, every)
    support = {}
    for e in every:
        ids = [c for c in evidence.get(e, ()) if c in chunks] if e in visible else [c for x, c in told if x == e]
        if ids:
            support[e] = ids
    chosen, cited = cover(options, support, pool, top_k)
    answers = {a: options[a][n] for a, n in chosen.items()}
    shown = cited if chosen else pool
    ranked = sorted(((-pool.get(c, 0.0), c) for c in shown))[:top_k]
    return answers, [c for _, c in ranked], told, {"reasons": reasons, "asked": len(asked), "rounds": rounds, "read": len(pool), "found": len({e for e, _ in told}), "candidates": len(options), "answered": len(answers)}
