"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. Examples: of the training labels, the ``per_class`` documents of either label with the smallest hash
   of their id (a documented bound; the base rate is counted over all training labels).
2. Terms: hashes of words and of their first 4, 5, 6 and 8 bytes; all terms of all examples.
   A term's idf is multiplied by its contrast, the absolute logarithm of the ratio of its shares in toxic
   and in clean examples, smoothed: without it, whole texts are near by their common words and a few
   insults count for little. Terms of any contrast are in vectors and norms. A term that no example has is
   weighed as the rarest known ones are: its idf times the contrast of a term of one example, averaged over
   the labels by their shares.
3. Index: tf-idf vectors (1 + log tf, smoothed idf over the examples, unit length) of the examples, equal
   vectors merged, in a block-max inverted index (``blockmax``).
4. Query: the norm is over the whole text, terms that no example has included. Blocks of examples whose
   largest weights can't give the k-th best cosine found so far are skipped: exact.
5. Score: the k nearest examples vote with their cosine (times their label's share of the labels over
   its share of the examples); ``PRIOR_WEIGHT`` votes at the base rate are
   added, so a document without a known term has the base rate. Neighbours are the evidence.

Words: ASCII letters in lower case, ASCII white space between; marks at either end are left off.

Defined results: a null, empty or unknown text scores the base rate (0.5 times it if no label is known
is 0); nulls in labels are no labels; a doc_id of several label rows is one label, toxic if any row says so; of
several documents of one doc_id the smallest text is the example; a null doc_id never is one; without labels every score is 0; ties are broken by example number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blockmax import BlockMax, Queries, best_hits, groups_of_alike, one_thread, ranges
from .common import cut, held_out, id_text, text_batches
from .textbytes import ALNUM, NOT_SPACE, U, Words, buffers, mix

PER_CLASS, NEIGHBOURS = 2000, 15
PRIOR_WEIGHT = 0.25
PREFIXES = (4, 5, 6, 8)
#: Examples at even odds that are added to a term's own, for its contrast between the labels.
SMOOTHING = 5.0
#: So many of the most frequent terms tell which examples are alike, in groups of so many at least; so many texts are looked up together.
LEADING, LEAST, QUERIES = 128, 256, 768
#: Terms are looked up by so many leading bits of their hashes.
LEAD_BITS = 20


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of each document's words and word beginnings, and the document of each."""
    low, off = buffers(texts)
    w = Words(low, off, NOT_SPACE)
    # leave marks off both ends: move to the first and last byte that is a letter or digit
    good = np.flatnonzero(ALNUM[low])
    if not len(good):
        return np.zeros(0, U), np.zeros(0, np.int64)
    doc = w.doc()
    a = np.searchsorted(good, w.start)
    b = np.searchsorted(good, w.end) - 1
    has = a <= b
    doc, start, end = doc[has], good[a[has]], good[b[has]] + 1
    size = end - start
    s = Words.__new__(Words)
    s.buf, s.start, s.end = low, start, end
    hashes, docs = [s.hashes()], [doc]
    for k in PREFIXES:
        long = size >= k
        s.start, s.end = start[long], start[long] + k
        hashes.append(s.hashes() ^ U(k))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


class Index:
    """Examples as unit tf-idf vectors in a block-max inverted index; nothing but the vectors is sent to executors."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], ids: list[int], base: float, weight: tuple[float, float] = (1.0, 1.0), unseen: float = 0.0):
        """``vectors``: for each example its term indices and frequencies; ``terms`` rises. ``weight``: of a vote of a clean and of a
        toxic example, to undo that the sample holds more of one label than the labels do. ``unseen``: idf of a term that no example has."""
        self.terms, self.idf, self.base, self.unseen = terms, idf, base, unseen
        merged: dict[bytes, list[int]] = {}
        kept = []
        for e, (t, tf) in enumerate(vectors):
            weights = self.weigh(t, tf)
            key = hashlib.sha256(np.asarray(t).tobytes() + weights.tobytes()).digest()
            if key not in merged:
                kept.append((t.astype(np.int32), weights))
            merged.setdefault(key, []).append(e)
        groups = list(merged.values())
        self.members = [[(ids[e], toxic[e]) for e in g] for g in groups]
        self.count = np.array([len(g) for g in groups], float)
        self.toxic = np.array([sum(toxic[e] for e in g) for g in groups], float)
        self.weight = weight
        sizes, terms_, weights_ = [len(t) for t, _ in kept], [t for t, _ in kept], [x for _, x in kept]
        kept.clear()
        row_term = np.concatenate([np.zeros(0, np.int32), *terms_])
        terms_.clear()
        row_weight = np.concatenate([np.zeros(0), *weights_])
        weights_.clear()
        self._merge(sizes, row_term, row_weight)

    def _merge(self, sizes: list[int], row_term: np.ndarray, row_weight: np.ndarray) -> None:
        """Posting lists by group of examples with like frequent terms; within a group examples lie by label and length."""
        n, sizes = len(sizes), np.array(sizes, np.int64)
        who = np.repeat(np.arange(n, dtype=np.int32), sizes)
        df = np.bincount(row_term, minlength=len(self.terms))
        leading = np.full(len(df), -1)
        often = np.argsort(-df, kind="stable")[:LEADING]
        leading[often] = np.arange(len(often))
        at = leading[row_term]
        x = np.zeros((n, max(len(often), 1)), np.float32)
        x[who[at >= 0], at[at >= 0]] = 1
        # terms with equal lists, such as a rare word and its beginnings, are one list that takes their weights' sum
        order = np.argsort(row_term.astype(U) << U(32) | who.astype(U))
        doc, weight, known = who[order], row_weight[order], np.flatnonzero(df)
        del order, who, at
        first = np.append(0, np.cumsum(df[known]))
        marks = mix(weight.view(U) + mix(doc.astype(U)))
        # lists are told apart by 64 bits: two of n lists share them with a chance of n * n / 2^65, 2e-8 for a million
        _, one, same = np.unique(np.add.reduceat(marks, first[:-1]) if len(known) else marks, return_index=True, return_inverse=True)
        # frequent lists first: what is looked up most lies together
        place = np.argsort(np.argsort(-df[known][one], kind="stable"))
        self.list_of = np.zeros(len(df), np.int32)
        self.list_of[known] = place[same]
        del marks, same
        one = one[np.argsort(place)]
        at, which = ranges(first[one], first[one + 1])
        doc, weight = doc[at], weight[at]
        #: of each group: its lists, their bounds, places and weights of their examples, and the examples
        self.groups: list[tuple[np.ndarray, ...]] = []
        for group in groups_of_alike(x, LEAST):
            rows = group[np.lexsort((sizes[group], 2 * self.toxic[group] > self.count[group]))]
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            mine = np.flatnonzero(place[doc] >= 0)
            mine = mine[np.argsort(which[mine].astype(U) << U(32) | place[doc[mine]].astype(U))]
            terms, size = np.unique(which[mine], return_counts=True)
            self.groups.append((terms.astype(np.int32), np.append(0, np.cumsum(size)), place[doc[mine]].astype(np.int32), weight[mine], rows))

    def _build(self) -> None:
        """The inverted indexes, and the lists by example for exact cosines; made where they are used."""
        if hasattr(self, "lists"):
            return
        lists = []
        self.by_example: list[tuple[np.ndarray, np.ndarray]] = [()] * len(self.count)
        for terms, first, doc, weight, rows in self.groups:
            of = np.full(int(self.list_of.max(initial=-1)) + 1, -1, np.int32)
            of[terms] = np.arange(len(terms))
            lists.append((BlockMax(terms.astype(U), first, doc, weight, rows, exact=False), of))
            order = np.argsort(doc.astype(np.uint16) if len(rows) < 1 << 16 else doc, kind="stable")
            which, weight = np.repeat(terms, np.diff(first))[order], weight[order]
            cuts = np.cumsum(np.bincount(doc, minlength=len(rows)))[:-1]
            for e, t, w in zip(rows.tolist(), np.split(which, cuts), np.split(weight, cuts), strict=True):
                self.by_example[e] = (t, w)
        self.lists = lists

    def weigh(self, t: np.ndarray, tf: np.ndarray, rest: float = 0.0) -> np.ndarray:
        """Unit weights of a text's known terms; ``rest``: sum of the squares of its unknown ones."""
        x = (1 + np.log(tf)) * self.idf[t]
        return x / max(np.sqrt((x * x).sum() + rest), 1e-300) if len(x) else x

    def nearest(self, t: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest merged examples, counting members, with their cosine; largest first."""
        return self.nearest_of([(t, weights)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        out: list[list[tuple[float, int]]] = [[] for _ in queries]
        if not len(self.count):
            return out
        self._build()
        owner = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        key = owner << 32 | self.list_of[np.concatenate([t for t, _ in queries])].astype(np.int64)
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        weight = np.add.reduceat(np.concatenate([w for _, w in queries])[order], start) if len(start) else np.zeros(0)
        asked, which = Queries.placed(np.bincount(key[start] >> 32, minlength=len(queries)), weight), key[start] & 0xFFFFFFFF
        floors, near, hits = np.zeros(len(queries)), tuple(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64)), []
        for group, of in self.lists:
            new = list(group.search_places(asked, of[which], k, floors, exact=False))
            hits += new
            near = best_hits([np.concatenate(x) for x in zip(near, *[(q, c - error, e, e) for q, e, c, error in new], strict=True)], k, floors)
        if not hits:
            return out
        query, item, cosine, error = (np.concatenate(x) for x in zip(*hits, strict=True))
        mine = np.flatnonzero(cosine + error >= floors[query])
        mine = mine[np.argsort(query[mine], kind="stable")]
        full, cuts = np.zeros(int(self.list_of.max()) + 1), np.searchsorted(query[mine], np.arange(len(queries) + 1))
        for i, (lo, hi) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            if lo < hi:
                own = slice(asked.first[i], asked.first[i + 1])
                full[which[own]] = asked.weight[own]
                for e in item[mine[lo:hi]].tolist():
                    lists, weights = self.by_example[e]
                    if (c := round(float(full[lists] @ weights), 12)) > 0:
                        out[i].append((-c, e))
                full[which[own]] = 0
        for i, found in enumerate(out):
            members = 0.0
            for j, (_, e) in enumerate(sorted(found)):
                members += self.count[e]
                if members >= k:
                    break
            out[i] = [(-c, e) for c, e in sorted(found)[: j + 1]] if found else []
        return out

    def vote(self, near: list[tuple[float, int]], k: int) -> float:
        left, votes, toxic = float(k), PRIOR_WEIGHT, PRIOR_WEIGHT * self.base
        for c, e in near:
            n = min(left, self.count[e])
            yes = c * n * self.toxic[e] / self.count[e] * self.weight[1]
            votes += yes + c * n * (1 - self.toxic[e] / self.count[e]) * self.weight[0]
            toxic += yes
            left -= n
            if left <= 0:
                break
        return toxic / votes

    def vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Known terms and frequencies of each text, and the sum of the squared weights of its unknown terms."""
        h, doc = features(texts)
        if not len(self.terms) or not len(h):
            return [(np.zeros(0, np.int64), np.zeros(0), 0.0)] * len(texts)
        h, doc, tf = counted(h, doc)
        at = self._places(h)
        ok = self.terms[at] == h
        rest = np.bincount(doc[~ok], ((1 + np.log(tf[~ok])) * self.unseen) ** 2, len(texts))
        t, doc, tf = at[ok], doc[ok], tf[ok].astype(float)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [(t[a:b], tf[a:b], r) for a, b, r in zip(cut, cut[1:], rest.tolist(), strict=False)]

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is among the terms, if it is: among those of its leading bits, of which there are few."""
        if not hasattr(self, "leads"):
            self.leads = np.searchsorted(self.terms, np.arange((1 << LEAD_BITS) + 1).astype(U) << U(64 - LEAD_BITS)).astype(np.int32)
            self.leads[-1] = len(self.terms)
        lead = (h >> U(64 - LEAD_BITS)).astype(np.int32)
        at, end = self.leads[lead], self.leads[lead + 1]
        on = np.flatnonzero(at < end)
        while len(on := on[(self.terms[at[on]] < h[on]) & (at[on] + 1 < end[on])]):
            at[on] += 1
        at[at == len(self.terms)] = 0
        return at

    def score(self, texts: pa.Array, k: int = NEIGHBOURS) -> list[tuple[float, list[tuple[float, int]]]]:
        keys: list[bytes | None] = []
        asked: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for t, tf, rest in self.vectors(texts):
            keys.append(np.append(t, tf).tobytes() + np.float64(rest).tobytes() if len(t) else None)
            if len(t) and keys[-1] not in asked:
                asked[keys[-1]] = (t, self.weigh(t, tf, rest))
        seen: dict[bytes | None, tuple[float, list[tuple[float, int]]]] = {None: (self.base, [])}
        names = list(asked)
        for i in range(0, len(names), QUERIES):
            some = names[i : i + QUERIES]
            for key, near in zip(some, self.nearest_of([asked[x] for x in some], k), strict=True):
                seen[key] = (self.vote(near, k), near)
        return [seen[key] for key in keys]


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) by document and term, with their frequencies."""
    order = np.argsort(h)
    # numbers of 16 bits are sorted by radix
    order = order[np.argsort(doc[order].astype(np.uint16) if len(doc) and doc.max() < 1 << 16 else doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, toxic) -> (doc_id, toxic, terms, tf): rising term hashes and their frequencies, as bytes."""
    for b in text_batches(batches):
        h, doc, tf = counted(*features(b.column(1)))
        cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
        parts = [[x[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)] for x in (h, tf.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, pa.binary()) for x in parts)], names=["doc_id", "toxic", "terms", "tf"])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = PER_CLASS) -> Index:
    """Learns from labels whose crc32(doc_id as text) modulo ``modulus`` is not ``held``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id", modulus, held))
    known = cut(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return Index(np.zeros(0, U), np.zeros(0), [], [], [], 0.0)
    picked = []
    for label in (0, 1):
        picked += known.where(F.col("toxic") == label).select("doc_id", "toxic", F.xxhash64("doc_id").alias("u")).orderBy("u", "doc_id").limit(per_class).collect()
    if not picked:
        return Index(np.zeros(0, U), np.zeros(0), [], [], [], 0.0)
    # at most 2 * per_class rows
    chosen = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in picked], "doc_id long, toxic int")
    texts = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    rows = texts.mapInArrow(_features_of, "doc_id long, toxic int, terms binary, tf binary").where(F.length("terms") > 0).orderBy("doc_id").collect()
    if not rows:
        return Index(np.zeros(0, U), np.zeros(0), [], [], [], toxic / n)
    n_toxic = sum(r[1] for r in picked)
    n_clean = len(picked) - n_toxic
    toxics, ids, sizes = [r["toxic"] for r in rows], [r["doc_id"] for r in rows], np.array([len(r["terms"]) // 8 for r in rows])
    tf = np.frombuffer(b"".join(r["tf"] for r in rows), np.int32)
    joined = np.frombuffer(b"".join(r["terms"] for r in rows), U)
    del rows
    hashes = np.unique(joined)
    which = np.searchsorted(hashes, joined).astype(np.int32)
    del joined
    marked = np.repeat(np.array(toxics, np.float32), sizes)
    with_toxic, with_clean = np.bincount(which, marked, len(hashes)), np.bincount(which, 1 - marked, len(hashes))
    del marked
    idf = np.log(1 + len(picked)) - np.log(1 + with_toxic + with_clean) + 1
    unseen = float(np.log(1 + len(picked)) + 1)
    if n_toxic and n_clean:
        spread = SMOOTHING / len(picked)

        def contrast(toxic_ones: np.ndarray, clean_ones: np.ndarray) -> np.ndarray:
            return np.abs(np.log((toxic_ones / n_toxic + spread) / (clean_ones / n_clean + spread)))

        idf *= contrast(with_toxic, with_clean)
        unseen *= float(contrast(np.array([1, 0]), np.array([0, 1])) @ [toxic / n, 1 - toxic / n])
    weight = tuple(share / max(mine / len(picked), 1e-9) for share, mine in ((1 - toxic / n, n_clean), (toxic / n, n_toxic)))
    ends = np.cumsum(sizes)[:-1]
    return Index(hashes, idf, list(zip(np.split(which, ends), np.split(tf, ends), strict=True)), toxics, ids, toxic / n, weight, unseen)


def score_documents(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score, evidence (nearest examples: doc_id, toxic, cosine); one row per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in text_batches(batches):
            scored = index.score(b.column(1), k)
            evidence = [[{"doc_id": i, "toxic": y, "cosine": c} for c, e in near for i, y in index.members[e][:k]][:k] for _, near in scored]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in scored], pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")


def clean_documents(docs: DataFrame, index: Index, k: int = NEIGHBOURS, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in text_batches(batches, at):
            yield b.filter(pa.array([s < threshold for s, _ in index.score(b.column(at), k)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
