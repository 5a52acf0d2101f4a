"""Answering many questions over a graph with gaps: missing edges are searched for in text, then answers are proved within a budget.

All questions go through the same rounds together; their state is tables keyed by ``query_id`` and nothing of it is on the
driver: what each may see (``scope``), the chunks it has read with their relevance (``pool``), the texts it has asked for
(``asked``) and whether it goes on. A chunk's claims don't depend on who reads it, so each chunk is verified once.

An edge (head_id, type, tail_id) matters to a question if its head is a subject or its tail a film of a subject; for "who
directed" questions, if it is a ``directed`` edge into the subject. All claims of the chunks a question has read are looked at again
whenever its films change, so the order of reading doesn't matter.

Proofs are covered greedily: of all open proofs the one that needs fewest new chunks, then of most relevance, then by ids, as long as
no more than ``limit`` chunks are cited. A round of the cover prices every proof at once and takes all that can't change
each other's price: those without new chunks, and the leading ones whose chunks no other answer can cite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .repair import CAST, CAST_OF, DIRECTORS, OF_FILMS, OF_ROLE, TOGETHER
from .views import small

PROOFS = 64
EDGE = ["head_id", "type", "tail_id"]
ROLES = ("acted_in", "directed")
#: Kinds whose answers are films that both subjects have a part in; of the others, the subjects direct.
PAIRS = ("cofilm", "director_actor")
# Fixed value: what the text of a filmography record says.
RECORD_MARK = "是数据集中的"
# What is said without an answer.
NEGATIVE, UNPROVED = "在当前语料的完整片单中没有共同影片；这不排除语料之外的情况。", "没有找到完整的证据。"
Cut = Callable[[DataFrame], DataFrame]


def roots(plans: DataFrame) -> DataFrame:
    """(query_id, kind, place, id, role) of plans (query_id, kind, subjects, minimum, boolean)."""
    told = F.when(F.col("kind") == "cofilm", "acted_in").when((F.col("kind") == "director_actor") & (F.col("place") == 1), "acted_in").otherwise("directed")
    return plans.select("query_id", "kind", F.posexplode("subjects").alias("place", "id")).withColumn("role", told)


def _of_roots(edges: DataFrame, r: DataFrame, keyed: bool) -> DataFrame:
    """Edges that the subjects themselves make matter; ``keyed``: edges have a query_id of their own."""
    on = ["query_id"] if keyed else []
    r = small(r.select("query_id", "kind", "id").distinct())
    into = edges.where("type = 'directed'").join(r.where("kind = 'directors'").withColumnRenamed("id", "tail_id"), [*on, "tail_id"])
    out = edges.where(F.col("type").isin(*ROLES)).join(r.where("kind <> 'directors'").withColumnRenamed("id", "head_id"), [*on, "head_id"])
    columns = ["query_id", *[c for c in edges.columns if c != "query_id"]]
    return out.select(columns).unionByName(into.select(columns))


def _of_films(edges: DataFrame, films: DataFrame, keyed: bool) -> DataFrame:
    told = edges.where(F.col("type").isin(*ROLES))
    return told.join(small(films), ["query_id", "tail_id"] if keyed else "tail_id").select("query_id", *[c for c in edges.columns if c != "query_id"])


def _films(r: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, tail_id): films of the subjects (of plans that have any)."""
    subject = r.where("kind <> 'directors'").select("query_id", F.col("id").alias("head_id"))
    return edges.where(F.col("type").isin(*ROLES)).join(subject, ["query_id", "head_id"], "left_semi").select("query_id", "tail_id").distinct()


def kinds_of(plans: DataFrame) -> set[str]:
    """The kinds that occur: at most the five there are, and only their parts of a plan need to run."""
    return {r[0] for r in plans.select("kind").distinct().collect()}


def scope(plans: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, head_id, type, tail_id): for each question the edges of the graph that matter to it."""
    r = roots(plans)
    own = _of_roots(edges.select(EDGE), r, False)
    return own.unionByName(_of_films(edges.select(EDGE), _films(r, own), False)).distinct()


def proofs(plans: DataFrame, edges: DataFrame, limit: int = PROOFS) -> DataFrame:
    """(query_id, answer_id, proof, edges): alternative proofs, the first ``limit`` of each answer in order of film ids.

    ``edges``: query_id, head_id, type, tail_id. Only the films that the first ``limit`` proofs can hold are gathered.
    """
    kinds = kinds_of(plans)
    e = edges.where(F.col("type").isin(*ROLES)).select("query_id", *EDGE).distinct()
    first, second = F.col("subjects")[0], F.get(F.col("subjects"), 1)
    p = plans.select("query_id", "kind", first.alias("a"), second.alias("b"), F.greatest(F.lit(1), F.coalesce("minimum", F.lit(1))).alias("minimum"))
    edge = lambda h, k, t: F.struct(h.alias("head_id"), F.lit(k).alias("type"), t.alias("tail_id"))
    who, film = F.col("person"), F.col("film")
    acted = e.where("type = 'acted_in'").select("query_id", F.col("head_id").alias("person"), F.col("tail_id").alias("film"))
    directed = e.where("type = 'directed'").select("query_id", F.col("head_id").alias("person"), F.col("tail_id").alias("film"))

    told = p.where("kind = 'directors'").join(directed, "query_id").where("film = a").select("query_id", who.alias("answer_id"), F.lit(0).alias("proof"), F.array(edge(who, "directed", film)).alias("edges"))
    both = []
    for kind, left, role in (x for x in (("cofilm", acted, "acted_in"), ("director_actor", directed, "directed")) if x[0] in kinds):
        q = p.where(F.col("kind") == kind)
        one = q.join(left, "query_id").where("person = a").select("query_id", "a", "b", "film")
        two = acted.withColumnRenamed("person", "b")
        both.append(one.join(two, ["query_id", "b", "film"]).select("query_id", film.alias("answer_id"), F.lit(0).alias("proof"), F.array(edge(F.col("a"), role, film), edge(F.col("b"), "acted_in", film)).alias("edges")))

    def cast_of(kind: str, director: str) -> DataFrame:
        own = p.where(F.col("kind") == kind).join(directed, "query_id").where(F.col("person") == F.col(director)).select("query_id", "a", "b", "minimum", "film")
        return own.join(acted, ["query_id", "film"])

    by_person = ["query_id", "a", "b", "minimum", "person"]

    def leading(cast: DataFrame, bound: Column | int, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("query_id", "person").orderBy("film"))
        return cast.withColumn("n", n).where(F.col("n") <= bound).groupBy(*by_person).agg(F.array_sort(F.collect_list("film")).alias(name), F.count("*").alias("size"))

    @pandas_udf("array<array<string>>")
    def groups(films: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([[list(g) for g in islice(combinations(f, k), limit)] for f, k in zip(films, size, strict=True)])

    shared = leading(cast_of("repeated_cast", "a"), F.col("minimum") + limit - 1, "films").where("size >= minimum")
    repeated = shared.select(*by_person, F.posexplode(groups("films", "minimum")).alias("proof", "group"))
    repeated = repeated.select("query_id", who.alias("answer_id"), "proof", F.flatten(F.transform("group", lambda m: F.array(edge(F.col("a"), "directed", m), edge(who, "acted_in", m)))).alias("edges"))

    one, two = leading(cast_of("director_overlap", "a"), limit, "one").drop("size"), leading(cast_of("director_overlap", "b"), limit, "two").select("query_id", "person", "two")
    pairs = F.slice(F.flatten(F.transform("one", lambda x: F.transform("two", lambda y: F.struct(x.alias("x"), y.alias("y"))))), 1, limit)
    overlap = one.join(two, ["query_id", "person"]).select(*by_person, F.posexplode(pairs).alias("proof", "m"))
    four = F.array(edge(F.col("a"), "directed", F.col("m.x")), edge(who, "acted_in", F.col("m.x")), edge(F.col("b"), "directed", F.col("m.y")), edge(who, "acted_in", F.col("m.y")))
    overlap = overlap.select("query_id", who.alias("answer_id"), "proof", F.array_distinct(four).alias("edges"))
    # the frame of "directors" gives the columns, whatever kinds there are
    return reduce(DataFrame.unionByName, [told, *both, *[repeated] * ("repeated_cast" in kinds), *[overlap] * ("director_overlap" in kinds)])


def search_texts(plans: DataFrame, active: DataFrame, proved: DataFrame, names: DataFrame, lists_limit: int, enhanced: bool) -> DataFrame:
    """(query_id, text, place): what to search for, most promising first, each text once.

    ``active``: edges in view by question; ``proved``: query_id, answer_id; ``names``: id, name.
    """
    r = roots(plans).join(small(names), "id")
    pair = F.col("kind").isin(*PAIRS)
    said = lambda table: reduce(lambda c, kv: F.when(F.col("role") == kv[0], kv[1]).otherwise(c), table.items(), F.lit(""))

    def row(section: int, first: Column, second: Column, text: Column) -> list[Column]:
        return [F.col("query_id"), F.lit(section).alias("section"), first.cast("string").alias("first"), second.cast("long").alias("second"), text.alias("text")]

    none, place, name = F.lit(""), F.col("place"), F.col("name")
    parts = [r.where("kind = 'directors' AND place = 0").select(row(1, none, F.lit(0), F.format_string(_slots(DIRECTORS, 1), name)))]
    rest = r.where("kind <> 'directors'")
    two = rest.where(pair).groupBy("query_id", "kind").agg(F.max_by("name", -place).alias("n0"), F.max_by("name", place).alias("n1"))
    kinds = kinds_of(plans)
    for kind, text in TOGETHER.items():
        if kind not in kinds:
            continue
        parts.append(two.where(F.col("kind") == kind).select(row(1, none, F.lit(0), F.format_string(_slots(text, 2), "n0", "n1"))))
    if not kinds - {"directors"}:
        return parts[0].groupBy("query_id", "text").agg(F.min(F.struct("section", "first", "second")).alias("place"))
    parts.append(rest.where(~pair).select(row(1, none, place, F.format_string(_slots(CAST_OF, 1), name))))
    films = _films(roots(plans), active).join(names.select(F.col("id").alias("tail_id"), F.col("name").alias("title")), "tail_id")
    wanted = films.join(rest.where(pair), "query_id").select("query_id", F.col("id").alias("head_id"), F.col("role").alias("type"), "tail_id", "title", "name", "place", "role")
    gaps = wanted.join(active.select("query_id", *EDGE), ["query_id", *EDGE], "left_anti")
    parts.append(gaps.select(row(2, F.col("tail_id"), place, F.concat(F.lit("《"), "title", F.lit("》 "), "name", F.lit(" "), said(OF_ROLE)))))
    single = films.join(rest.where(~pair).select("query_id").distinct(), "query_id", "left_semi")
    parts.append(single.select(row(2, F.col("tail_id"), F.lit(0), F.format_string(_slots(CAST, 1), "title"))))
    parts.append(rest.select(row(3, none, place, F.concat("name", F.lit(" "), said(OF_ROLE), F.lit(" 电影")))))
    if enhanced:
        own = rest.select(row(0, F.lit("0"), place, F.concat("name", F.lit(" "), said(OF_FILMS))))
        open_ = active.where("type = 'acted_in'").join(rest.where(~pair).select("query_id").distinct(), "query_id", "left_semi")
        few = open_.groupBy("query_id", F.col("head_id").alias("id")).agg(F.countDistinct("tail_id").alias("n")).join(proved.select("query_id", F.col("answer_id").alias("id")).distinct(), ["query_id", "id"], "left_anti")
        # people with a part but without a proof, those of most films first
        near = few.join(names, "id").select(row(0, F.concat(F.lit("1"), F.lpad((F.lit(10**9) - F.col("n")).cast("string"), 10, "0"), F.col("id")), F.lit(0), F.concat("name", F.lit(f" {OF_FILMS['acted_in']}"))))
        lists = own.unionByName(near)
        cap = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "second"))
        parts.append(lists.withColumn("cap", cap).where(F.col("cap") <= lists_limit).drop("cap"))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("query_id", "text").agg(F.min(F.struct("section", "first", "second")).alias("place"))


def _slots(text: str, n: int) -> str:
    return text.format(*["%s"] * n)


def cover(options: DataFrame, limit: int, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """Greedy covers of all questions: (query_id, answer_id, proof) chosen, and (query_id, chunks) cited, sorted.

    ``options``: query_id, answer_id, proof, key (orders proofs of equal price), edges: array of arrays of candidate chunks
    (chunk_id, relevance), one for each edge of the proof that must be cited; an empty one can't be.
    """
    chunk = F.transform(F.flatten("edges"), lambda c: c["chunk_id"])
    owners = options.select("query_id", "answer_id", F.explode(F.array_distinct(chunk)).alias("c")).groupBy("query_id", "c").agg(F.countDistinct("answer_id").alias("owners"))
    shared = owners.where("owners > 1").select("query_id", "c")
    # a proof whose chunks may be cited for another answer too
    tied = options.select("query_id", "answer_id", "proof", F.explode(F.array_distinct(chunk)).alias("c")).join(shared, ["query_id", "c"], "left_semi").select("query_id", "answer_id", "proof", F.lit(True).alias("tied")).distinct()
    open_ = cut(options.where(F.forall("edges", lambda e: F.size(e) > 0)).join(tied, ["query_id", "answer_id", "proof"], "left").withColumn("tied", F.coalesce("tied", F.lit(False))))
    cited = cut(options.select("query_id").distinct().withColumn("chunks", F.array().cast("array<string>")))
    chosen = None
    kind = "array<struct<chunk_id:string,relevance:double>>"

    def needs() -> Column:
        """Chunks of a proof: for each edge one that is cited, else one the proof needs already, else the most relevant."""

        def add(acc, candidates):
            taken = F.transform(acc, lambda c: c["chunk_id"])
            rank = lambda c: F.struct(~F.array_contains("chunks", c["chunk_id"]), ~F.array_contains(taken, c["chunk_id"]), -c["relevance"], c["chunk_id"], c.alias("c"))
            best = F.array_min(F.transform(candidates, rank))["c"]
            return F.when(F.array_contains(taken, best["chunk_id"]), acc).otherwise(F.concat(acc, F.array(F.struct(best["chunk_id"].alias("chunk_id"), best["relevance"].alias("relevance")))))

        return F.aggregate("edges", F.array().cast(kind), add)

    while True:
        priced = open_.join(cited, "query_id").withColumn("needs", needs())
        new = F.array_except(F.transform("needs", lambda c: c["chunk_id"]), F.col("chunks"))
        weight = F.aggregate("needs", F.lit(0.0), lambda s, c: s + c["relevance"])
        priced = priced.withColumn("new", new).where(F.size("new") + F.size("chunks") <= limit)
        price = F.struct(F.size("new").alias("n"), (-F.round(weight, 9)).alias("w"), F.col("answer_id").alias("a"), F.col("key").alias("k"))
        best = priced.select("query_id", "answer_id", price.alias("price"), "proof", "new", "tied", F.size("chunks").alias("held")).groupBy("query_id", "answer_id").agg(F.min(F.struct("price", "proof", "new", "tied", "held")).alias("b"))
        order = Window.partitionBy("query_id").orderBy("b.price")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        some = F.size("b.new") > 0
        # whoever comes first among those that need new chunks, and who follows as long as nobody shares chunks
        ranked = best.withColumn("earlier", F.coalesce(F.sum(some.cast("int")).over(before), F.lit(0))).withColumn("mixed", F.coalesce(F.max((F.col("b.tied") & some).cast("int")).over(before), F.lit(0)) > 0)
        ranked = ranked.withColumn("total", F.sum(F.size("b.new")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        step = cut(ranked.where(~some | (F.col("earlier") == 0) | (~F.col("mixed") & ~F.col("b.tied") & (F.col("total") + F.col("b.held") <= limit))).select("query_id", "answer_id", "b.proof", "b.new"))
        if step.isEmpty():
            break
        taken = step.select("query_id", "answer_id", "proof")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        fresh = step.groupBy("query_id").agg(F.flatten(F.collect_list("new")).alias("fresh"))
        cited = cut(cited.join(fresh, "query_id", "left").select("query_id", F.array_sort(F.array_distinct(F.concat("chunks", F.coalesce("fresh", F.array().cast("array<string>"))))).alias("chunks")))
        open_ = cut(open_.join(step.select("query_id", "answer_id"), ["query_id", "answer_id"], "left_anti"))
    if chosen is None:
        chosen = options.select("query_id", "answer_id", "proof").limit(0)
    return chosen, cited


@dataclass
class Outcome:
    """answers: query_id, answer_id, edges (its proof). chunks: query_id, rank, chunk_id, score, what is cited or, without an answer,
    what is most relevant. repaired: query_id, head_id, type, tail_id, chunk_id of edges found in text. trace: query_id, triggered,
    reasons, asked, rounds, read, found, candidates, answered. read: query_id, chunk_id, relevance of every chunk read."""

    answers: DataFrame
    chunks: DataFrame
    repaired: DataFrame
    trace: DataFrame
    read: DataFrame


def repair(
    plans: DataFrame,
    edges: DataFrame,
    evidence: DataFrame | Callable[[DataFrame], DataFrame],
    chunks: DataFrame,
    names: DataFrame,
    search: Callable[[DataFrame, int], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    cut: Cut,
    policy: str = "adaptive",
    top_k: int = 6,
    search_k: int = 20,
    max_queries: int = 32,
    max_rounds: int = 2,
    audit: int = 40,
    temporary_edges: bool = True,
    enhanced: bool = True,
) -> Outcome:
    """All questions of ``plans`` (query_id, kind, subjects, minimum, boolean; one row each) at once.

    ``edges``: head_id, type, tail_id, what the questions may see; ``evidence``: head_id, type, tail_id, chunk_id, or a function
    that gives them for some edges; ``chunks``:
    chunk_id, doc_id, text and what ``verify`` reads; ``names``: id, name. ``search``: (query_id, question), k -> (query_id,
    chunk_id, score); ``verify``: rows of ``chunks`` -> (chunk_id, head_id, type, tail_id). The graph is never changed.
    """
    if policy not in ("adaptive", "always", "off"):
        raise ValueError("policy must be adaptive, always or off")
    if min(top_k, search_k, max_queries, max_rounds, audit) < 1:
        raise ValueError("budgets must be at least 1")
    r = cut(roots(plans))
    visible = edges.select(EDGE).distinct()
    seen = cut(scope(plans, visible))
    linked = seen.join(_evidence(evidence, seen), EDGE).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    first = linked.groupBy("query_id", "chunk_id").agg(F.min(F.struct(*EDGE)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "chunk_id"))
    pool = cut(first.withColumn("n", nth).where(F.col("n") <= audit).select("query_id", "chunk_id", F.lit(0.5).alias("relevance")))
    claims = None
    done = None

    def read(pool: DataFrame) -> None:
        """Verifies the chunks that nobody has read before."""
        nonlocal claims, done
        new = pool.select("chunk_id").distinct()
        new = cut(new if done is None else new.join(done, "chunk_id", "left_anti"))
        told = cut(verify(chunks.join(new, "chunk_id", "left_semi")).select("chunk_id", *EDGE).distinct())
        claims = told if claims is None else claims.unionByName(told)
        done = new if done is None else done.unionByName(new)

    def view(pool: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(edges in view of the graph, edges found in text with their chunks)."""
        if not temporary_edges:
            return seen, pool.join(claims, "chunk_id").select("query_id", *EDGE, "chunk_id").limit(0)
        told = cut(pool.select("query_id", "chunk_id").join(claims, "chunk_id"))
        own = _of_roots(told, r, True)
        films = _films(r, seen.unionByName(own.select("query_id", *EDGE)))
        fresh = cut(films.join(_films(r, seen), ["query_id", "tail_id"], "left_anti"))
        seen = cut(seen.unionByName(_of_films(visible, fresh, False)).distinct()) if not fresh.isEmpty() else seen
        wanted = own.unionByName(_of_films(told, films, True)).select("query_id", *EDGE, "chunk_id").distinct()
        return seen, cut(wanted.join(seen, ["query_id", *EDGE], "left_anti"))

    def sizes(found: DataFrame) -> DataFrame:
        return found.select("query_id", *EDGE).distinct().groupBy("query_id").agg(F.count("*").alias("found"))

    proved = cut(proofs(plans, seen).select("query_id", "answer_id").distinct())
    read(pool)
    before = seen
    seen, found = view(pool, seen)
    state = plans.select("query_id", "boolean").join(proved.groupBy("query_id").agg(F.lit(True).alias("proved")), "query_id", "left").join(sizes(found), "query_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("proved").isNull(), "no_complete_proof"), F.when(F.col("found") > 0, "text_graph_disagreement"), F.when(~F.coalesce("boolean", F.lit(False)), "set_completeness_unverified")))
    trigger = {"always": F.lit(True), "off": F.lit(False), "adaptive": F.size("reasons") > 0}[policy]
    state = cut(state.select("query_id", F.coalesce("found", F.lit(0)).alias("found"), reasons.alias("reasons")).withColumn("triggered", trigger).withColumn("going", F.col("triggered")).withColumn("rounds", F.lit(0)).withColumn("asked", F.lit(0)))
    if policy == "off":
        seen, found, state = before, found.limit(0), state.withColumn("found", F.lit(0))
    asked = None
    share = max(1, max_queries // max_rounds)
    for _ in range(max_rounds):
        going = state.where("going").select("query_id", F.col("asked").alias("so_far"))
        if going.isEmpty():
            break
        active = cut(seen.unionByName(found.select("query_id", *EDGE)).distinct())
        alive = cut(plans.join(going, "query_id", "left_semi"))
        proved = cut(proofs(alive, active).select("query_id", "answer_id").distinct())
        queue = search_texts(alive, active.join(going, "query_id", "left_semi"), proved, names, max(2, max_queries // 2), enhanced)
        if asked is not None:
            queue = queue.join(asked, ["query_id", "text"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "text"))
        queue = cut(queue.join(going, "query_id").withColumn("n", nth))
        now = cut(queue.where(F.col("n") <= F.least(F.lit(share), F.lit(max_queries) - F.col("so_far"))).select("query_id", "text"))
        asked = now if asked is None else asked.unionByName(now)
        hits = cut(search(now.select(F.col("text").alias("query_id"), F.col("text").alias("question")).distinct(), search_k).select(F.col("query_id").alias("text"), "chunk_id", "score"))
        gained = now.join(hits, "text").select("query_id", "text", "chunk_id", F.col("score").cast("double").alias("relevance"))
        if enhanced:
            gained = gained.unionByName(siblings(gained, chunks))
        pool = cut(pool.unionByName(gained.select("query_id", "chunk_id", "relevance")).groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance")))
        read(pool)
        seen, found = view(pool, seen)
        counts = queue.groupBy("query_id").agg(F.count("*").alias("queued")).join(now.groupBy("query_id").agg(F.count("*").alias("sent")), "query_id", "left")
        state = state.join(counts, "query_id", "left").join(sizes(found).withColumnRenamed("found", "after"), "query_id", "left")
        sent, after = F.coalesce("sent", F.lit(0)), F.coalesce("after", F.lit(0))
        more = (sent > 0) & ((after > F.col("found")) | (sent < F.col("queued"))) & (F.col("asked") + sent < max_queries)
        state = cut(state.select("query_id", after.alias("found"), "reasons", "triggered", (F.col("going") & more).alias("going"), (F.col("rounds") + (F.col("going") & (sent > 0)).cast("int")).alias("rounds"), (F.col("asked") + sent).alias("asked")))
    return _prove(plans, seen, found, evidence, chunks, pool, state, top_k, cut)


def _evidence(evidence: DataFrame | Callable[[DataFrame], DataFrame], seen: DataFrame) -> DataFrame:
    return (evidence(seen.select(EDGE).distinct()) if callable(evidence) else evidence).select(*EDGE, "chunk_id")


def siblings(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Filmography records in the documents of hits (query_id, text, chunk_id, relevance), or in all documents of the same person and role.

    A record that several hits of one text lead to gets the relevance of the least of them.
    """
    owner = F.regexp_extract("doc_id", r"^(person_(?:actor|director)_.+)$", 1)
    group = F.when(owner != "", owner).otherwise(F.col("doc_id"))
    of_hit = small(hits).join(chunks.select("chunk_id", group.alias("group")), "chunk_id").groupBy("query_id", "text", "group").agg(F.min("relevance").alias("relevance"))
    records = chunks.where(F.col("text").contains(RECORD_MARK)).select("chunk_id", group.alias("group"))
    return of_hit.join(records, "group").select("query_id", "text", "chunk_id", "relevance")


def _prove(plans, seen, found, evidence, chunks, pool, state, top_k: int, cut: Cut) -> Outcome:
    active = cut(seen.unionByName(found.select("query_id", *EDGE)).distinct())
    paths = cut(proofs(plans, active))
    graph = seen.join(_evidence(evidence, seen), EDGE).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("query_id", *EDGE, "chunk_id")
    support = graph.unionByName(found).distinct().join(pool, ["query_id", "chunk_id"], "left")
    support = support.groupBy("query_id", *EDGE).agg(F.array_sort(F.collect_list(F.struct("chunk_id", F.coalesce("relevance", F.lit(0.0)).alias("relevance")))).alias("candidates"))
    steps = paths.select("query_id", "answer_id", "proof", F.posexplode("edges").alias("n", "e")).select("query_id", "answer_id", "proof", "n", "e.*").join(support, ["query_id", *EDGE], "left")
    # an edge without chunks is the graph's own and needs none
    grouped = steps.groupBy("query_id", "answer_id", "proof").agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws("|", *EDGE).alias("key"), "candidates"))).alias("s"))
    options = grouped.select("query_id", "answer_id", "proof", F.transform("s", lambda x: x["key"]).alias("key"), F.transform(F.filter("s", lambda x: x["candidates"].isNotNull()), lambda x: x["candidates"]).alias("edges"))
    chosen, cited = cover(cut(options), top_k, cut)
    answers = cut(chosen.join(paths, ["query_id", "answer_id", "proof"]).select("query_id", "answer_id", "edges"))
    score = F.coalesce("relevance", F.lit(0.0))
    used = cited.select("query_id", F.explode("chunks").alias("chunk_id")).join(pool, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", score.alias("score"))
    rest = pool.join(answers.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", F.col("relevance").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    ranked = used.join(answers.select("query_id").distinct(), "query_id", "left_semi").unionByName(rest).withColumn("rank", nth).where(F.col("rank") <= top_k).select("query_id", "rank", "chunk_id", "score")
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    trace = state.drop("going")
    for df, name in ((pool, "read"), (paths.select("query_id", "answer_id").distinct(), "candidates"), (answers, "answered")):
        trace = trace.join(count(df, name), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return Outcome(answers, ranked, found, trace, pool)


def evidence_nodes(out: Outcome) -> DataFrame:
    """(query_id, chunk_id, entities, edges): for each cited chunk the repaired edges of chosen proofs that it supports, and their ends."""
    used = out.answers.select("query_id", F.explode("edges").alias("e")).select("query_id", "e.*").distinct()
    told = out.repaired.join(used, ["query_id", *EDGE], "left_semi").join(out.chunks.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    ends = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("head_id", "tail_id"))))).alias("entities")
    return told.groupBy("query_id", "chunk_id").agg(ends, F.array_sort(F.collect_set(F.struct(*EDGE))).alias("edges"))


def bounded_negatives(plans: DataFrame, out: Outcome, records: DataFrame, limit: int = 6) -> DataFrame:
    """(query_id, chunks): yes-no questions about common films of two people that may be answered "no, not in this corpus".

    ``plans`` asks about this corpus only; ``records``: chunk_id, owner, films of complete filmography records. Both people's records were read, they share no film, nothing was proved, at least one search was
    made and all these chunks fit into the budget. It says nothing beyond the corpus.
    """
    silent = out.trace.where("candidates = 0 AND asked > 0").select("query_id")
    asked = plans.where("kind = 'cofilm' AND boolean").join(silent, "query_id", "left_semi").select("query_id", F.size(F.array_distinct("subjects")).alias("people"), F.explode(F.array_distinct("subjects")).alias("owner"))
    seen = asked.join(records, "owner").join(out.read.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    films = seen.select("query_id", "owner", F.explode("films").alias("film")).distinct().groupBy("query_id", "film").agg(F.count("*").alias("n"))
    common = films.where("n > 1").select("query_id").distinct()
    whole = seen.groupBy("query_id", "people").agg(F.countDistinct("owner").alias("n"), F.array_sort(F.collect_set("chunk_id")).alias("chunks"))
    return whole.where((F.col("n") == F.col("people")) & (F.size("chunks") <= limit)).join(common, "query_id", "left_anti").select("query_id", "chunks")


def answer_texts(plans: DataFrame, out: Outcome, names: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """(query_id, answer): a fixed sentence per question; answers in order of id, people with the films that prove them."""
    film = out.answers.select("query_id", "answer_id", F.explode("edges").alias("e")).select("query_id", "answer_id", F.col("e.tail_id").alias("id")).where("id <> answer_id").distinct()
    titled = film.join(names.select("id", F.col("name").alias("title")), "id", "left").groupBy("query_id", "answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("title", "id").alias("t")))), lambda x: x["t"]), "、").alias("films"))
    lines = out.answers.join(plans.select("query_id", "kind"), "query_id").join(titled, ["query_id", "answer_id"], "left").join(names.select(F.col("id").alias("answer_id"), "name"), "answer_id", "left")
    line = F.concat(F.coalesce("name", "answer_id"), F.when(F.col("kind").isin("repeated_cast", "director_overlap") & F.col("films").isNotNull(), F.concat(F.lit("（"), "films", F.lit("）"))).otherwise(""))
    said = lines.groupBy("query_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("answer_id", line.alias("line")))), lambda x: x["line"]), "；"), F.lit("。")).alias("said"))
    every = plans.select("query_id").join(said, "query_id", "left")
    no = F.lit(None).cast("boolean").alias("no")
    every = every.join(negatives.select("query_id", F.lit(True).alias("no")), "query_id", "left") if negatives is not None else every.select("*", no)
    return every.select("query_id", F.coalesce("said", F.when(F.col("no"), NEGATIVE).otherwise(UNPROVED)).alias("answer"))


def plan_questions(questions: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Plans of the questions (query_id, question) that the grammar covers; ``anchors``: query_id, id; ``nodes``: id, name, type, aliases."""
    from ..plans.grammar import Subject, parse

    surfaces = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    about = anchors.select("query_id", "id").distinct().join(nodes.select("id", "type", surfaces.alias("surfaces")), "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "surfaces"))).alias("entities"))

    @pandas_udf("struct<kind:string,subjects:array<string>,minimum:int,boolean:boolean>")
    def planned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for asked, entities in batches:
            found = [parse(q or "", [Subject(e["id"], e["type"], tuple(e["surfaces"])) for e in es]) for q, es in zip(asked, entities, strict=True)]
            yield pd.DataFrame([(p.kind, list(p.subjects), p.minimum, p.boolean) if p else (None, None, None, None) for p in found], columns=["kind", "subjects", "minimum", "boolean"])

    return questions.join(about, "query_id").select("query_id", planned("question", "entities").alias("p")).select("query_id", "p.*").where("kind IS NOT NULL")
