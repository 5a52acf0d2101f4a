"""Block-max inverted index in numpy: the largest sums of weight times impact for many queries at once.

Items (documents, examples) stand in a row, alike ones together, in blocks of ``BLOCK``. A term has a
posting list with its largest impact in all and in each block; terms that one item in ``OFTEN`` has are
rows of impacts instead. ``search``: (1) a query whose weights times the index's maxima don't reach its
threshold is dropped. For a batch of the others: (2) blocks whose maxima, of all terms, don't reach it are
skipped; (3) in the blocks left the frequent terms' rows are multiplied, which tightens the bounds, and
blocks are skipped again; (4) postings are added in the best blocks first, which raises the threshold,
then in the blocks that still reach it. Bounds and sums are in single precision with a margin; what may be
among the best is summed again in double precision: exact.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from pathlib import Path

import numpy as np

from .textbytes import U

BLOCK = 64
NO_TERMS = np.zeros(0, U)
#: Terms that one item in so many has are rows of impacts, as far as these numbers go; so many queries are searched together.
OFTEN, DENSE, BATCH = 28, 8 << 20, 384
#: Sums of so many (query, item) pairs are added up at once.
CELLS = 1 << 13


def one_thread() -> None:
    """One thread for matrix products in this process: a task has one core, where the library's threads only wait for each other.

    Does nothing where numpy brings another library.
    """
    names = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in names:
            if hasattr(library, name):
                getattr(library, name)(1)
                return


def arrange(x: np.ndarray, axes: int = 3, rounds: int = 4) -> np.ndarray:
    """A group number for each row of ``x``, alike rows together: cells of the leading axes, then a few means."""
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    centred = x - x.mean(0) if len(x) else x
    _, vectors = np.linalg.eigh(centred.T @ centred)
    group = ((centred @ vectors[:, ::-1][:, :axes] > 0) @ (1 << np.arange(min(axes, x.shape[1])))).astype(np.int64)
    for _ in range(rounds):
        size = np.bincount(group, minlength=1 << axes)
        one = np.zeros((len(x), 1 << axes), np.float32)
        one[np.arange(len(x)), group] = 1
        means = (one.T @ x) / np.maximum(size, 1)[:, None]
        means /= np.maximum(np.sqrt((means * means).sum(1, keepdims=True)), 1e-9)
        like = x @ means.T
        like[:, size == 0] = -2
        group = like.argmax(1)
    return group


def groups_of_alike(x: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """The row numbers of each group; groups of fewer than ``least`` rows are put together."""
    group = arrange(x)
    size = np.bincount(group)
    group[size[group] < least] = len(size)
    for g in np.unique(group):
        yield np.flatnonzero(group == g)


def best_hits(hits: list[np.ndarray], k: int, floors: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, score, item, row): the first k hits of each query, by score, item and row. ``floors`` rise to the k-th scores."""
    query, score, item, row = hits
    order = np.lexsort((row, item, -score, query))
    query = query[order]
    order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
    out = tuple(x[order] for x in hits)
    query, score = out[:2]
    full = np.flatnonzero(query[k - 1 :] == query[: max(len(query) - k + 1, 0)])
    floors[query[full]] = np.maximum(floors[query[full]], score[full + k - 1])
    return out


class Queries:
    """Some queries with rising terms and their weights, by vocabulary."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]]):
        sizes = np.array([len(t) for t, _ in queries], np.int64)
        self.vocabulary, which = np.unique(np.concatenate([NO_TERMS, *(t for t, _ in queries)]), return_inverse=True)
        self.which = which.astype(np.int32)
        self.own(sizes, np.concatenate([np.zeros(0), *(w for _, w in queries)]))

    def own(self, sizes: np.ndarray, weight: np.ndarray) -> None:
        self.n, self.first, self.weight = len(sizes), np.append(0, np.cumsum(sizes)), weight
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)

    @classmethod
    def placed(cls, sizes: np.ndarray, weight: np.ndarray) -> Queries:
        """Queries whose terms' places are known, for ``search_places``."""
        out = cls.__new__(cls)
        out.own(sizes, weight)
        return out


class BlockMax:
    """``terms`` rise; postings of term t are first[t] to first[t + 1], in order of item; ``rows`` names the items."""

    def __init__(self, terms: np.ndarray, first: np.ndarray, doc: np.ndarray, impact: np.ndarray, rows: np.ndarray, exact: bool = True):
        self.terms, self.row, self.n, self.blocks = terms, rows, len(rows), -(-len(rows) // BLOCK)
        df = np.diff(first)
        which = np.repeat(np.arange(len(self.terms), dtype=np.int32), df)
        self.top_of = np.maximum.reduceat(impact, first[:-1]) if len(df) else np.zeros(0)
        if exact:  # by item, for exact sums
            order = np.argsort(doc, kind="stable")
            self.by_doc_term, self.by_doc_impact = which[order], impact[order]
            self.by_doc_first = np.append(0, np.cumsum(np.bincount(doc, minlength=self.n)))
            del order
        often = np.argsort(-df, kind="stable")[: max(1, DENSE // max(self.n, 1))]
        often = often[df[often] * OFTEN >= self.n]
        self.dense_row = np.full(len(df), -1, np.int32)
        self.dense_row[often] = np.arange(len(often))
        row = self.dense_row[which]
        dense = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        dense[row[row >= 0], doc[row >= 0]] = impact[row >= 0]
        self.dense = dense.reshape(len(often), self.blocks, BLOCK)
        self.dense_top = self.dense.max(2, initial=0)
        #: entries: a rare term in a block, its first posting and largest impact
        self.doc, self.impact, which = doc[row < 0].astype(np.int32), impact[row < 0].astype(np.float32), which[row < 0]
        block = self.doc >> 6
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        self.entry_block = block[start]
        self.entry_first = np.append(start, len(which)).astype(np.int32)
        self.entry_top = np.maximum.reduceat(self.impact, start) if len(start) else np.zeros(0, np.float32)
        self.term_first = np.searchsorted(which[start], np.arange(len(df) + 1)).astype(np.int32)

    def top(self, term: np.ndarray, weight: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        found = list(self.search(Queries([(term, weight)]), k, np.array([floor])))
        return found[0][1:] if found else (np.zeros(0, np.int64), np.zeros(0))

    def search(self, queries: Queries, k: int, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, rows, scores): of each query its best k documents of positive score and at least its floor, and
        perhaps some more."""
        at, known = find(self.terms, queries.vocabulary)
        yield from self.search_places(queries, np.where(known, at, -1).astype(np.int32)[queries.which], k, floors)

    def search_places(self, queries: Queries, term: np.ndarray, k: int, floors: np.ndarray, exact: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
        """``search`` with the place of each of the queries' terms among the index's (-1: not there); if not ``exact``,
        single-precision sums and what they may be off."""
        if not self.n:
            return
        here = term >= 0
        owner = queries.owner[here]
        # the shard's maxima: no document here scores more
        most = np.bincount(owner, queries.weight[here] * self.top_of[term[here]], queries.n)
        live = np.flatnonzero((most > 0) & (most >= floors - 1e-6 - 1e-9 * most))
        for lo in range(0, len(live), BATCH):
            yield from self._batch(queries, term, live[lo : lo + BATCH], k, floors[live[lo : lo + BATCH]], exact)

    def _batch(self, q: Queries, places: np.ndarray, batch: np.ndarray, k: int, floor: np.ndarray, exact: bool) -> Iterator[tuple[np.ndarray, ...]]:
        m = len(batch)
        mine, owner = ranges(q.first[batch], q.first[batch + 1])
        term = places[mine]
        here = term >= 0
        term, owner, weight = term[here], owner[here].astype(np.int32), q.weight[mine[here]]
        mine_first = np.searchsorted(owner, np.arange(m + 1))
        row = self.dense_row[term]
        weights = np.zeros((m, len(self.dense)), np.float32)
        weights[owner[row >= 0], row[row >= 0]] = weight[row >= 0]
        rare, light = row < 0, weight.astype(np.float32)
        entry, by = ranges(self.term_first[term[rare]], self.term_first[term[rare] + 1])
        cell = (owner[rare] * np.int32(self.blocks))[by] + self.entry_block[entry]
        rest = np.bincount(cell, light[rare][by] * self.entry_top[entry], m * self.blocks).reshape(m, self.blocks)
        bound = weights @ self.dense_top + rest
        # single precision, nothing negative: each product and sum is off by half a unit in the last place; four times that to be safe
        off = (2 + np.bincount(owner, minlength=m)) * 2.0**-23
        reach = lambda x: x >= (floor * (1 - off))[:, None] - 2e-6
        live = reach(bound) & (bound > 0)
        used = np.flatnonzero(live.any(0))
        if not len(used):
            return
        begin, end = (self.entry_first[self.term_first[term[rare] + d]] for d in (0, 1))
        sizes = self.entry_first[entry + 1] - self.entry_first[entry]
        postings = int(sizes.sum())
        # where most postings count, whole lists are added: a few long runs instead of many short ones
        most = lambda x: sizes[x.ravel()[cell]].sum() * 5 >= postings * 2
        if whole := len(used) == self.blocks or most(live):
            used = np.arange(self.blocks)
        # the frequent terms' part of every score, in the blocks that any query of the batch needs
        scores = weights @ (self.dense if whole else self.dense[:, used]).reshape(len(self.dense), len(used) * BLOCK)
        scores = scores.reshape(m, len(used), BLOCK)
        if not whole:
            column = np.full(self.blocks, -1, np.int32)
            column[used] = np.arange(len(used))
            here = column[self.entry_block[entry]]
            ok = here >= 0
            cell = (cell // self.blocks * len(used) + here)[ok]
            entry, by, sizes = entry[ok], by[ok], sizes[ok]
        bound = scores.max(2) + rest[:, used]
        live = live[:, used] & reach(bound)
        flat = scores.reshape(m, -1).astype(float)
        light = weight[rare].astype(np.float32)
        of_term = owner[rare]
        # a few queries at a time, so that their sums stay in the processor's cache
        step = max(1, CELLS // max(flat.shape[1], 1))
        cuts, term_cuts = np.searchsorted(cell, np.arange(0, m + step, step) * len(used)), np.searchsorted(of_term, np.arange(0, m + step, step))

        def add(to: np.ndarray, of: np.ndarray) -> None:
            which, whole_lists = of.ravel(), whole and most(of)
            for i in range(len(cuts) - 1):
                part = to[i * step : (i + 1) * step]
                if whole_lists:
                    lo, hi = term_cuts[i], term_cuts[i + 1]
                    posting, run = ranges(begin[lo:hi], end[lo:hi])
                    at = ((of_term[lo:hi] - i * step) * part.shape[1])[run] + self.doc[posting]
                    value = self.impact[posting] * light[lo:hi][run]
                else:
                    use = cuts[i] + np.flatnonzero(which[cell[cuts[i] : cuts[i + 1]]])
                    posting, run = ranges(self.entry_first[entry[use]], self.entry_first[entry[use] + 1])
                    at = ((cell[use] - i * step * len(used)) * BLOCK)[run] + (self.doc[posting] & 63)
                    value = self.impact[posting] * light[by[use]][run]
                part += np.bincount(at, value, part.size).reshape(part.shape)

        def rise(sums: np.ndarray, of: np.ndarray) -> None:
            # documents whose rare terms aren't all added score no more with them left out
            if len(of) and sums.shape[1] > k:
                floor[of] = np.maximum(floor[of], np.partition(sums[of], -k, axis=1)[:, -k] * (1 - off[of]))

        # the best blocks first, where no threshold is known yet
        fresh = np.flatnonzero(floor <= 0)
        if len(fresh) and len(used) > (n := max(2, k // BLOCK + 1)):
            head = np.zeros(live.shape, bool)
            head[fresh[:, None], np.argpartition(-bound[fresh], n, axis=1)[:, :n]] = True
            probe = flat.copy()
            add(probe, head & live)
            rise(probe, fresh)
            live &= reach(bound)
        add(flat, live)
        hit = reach(flat) & (flat > 0)
        many = np.flatnonzero(hit.sum(1) > k)
        rise(flat, many)
        hit[many] &= flat[many] >= (floor * (1 - off))[many, None] - 2e-6
        who, at = np.nonzero(hit)
        docs = used[at // BLOCK] * BLOCK + at % BLOCK
        if not len(who) or not exact:
            if len(who):
                yield batch[who], self.row[docs], flat[who, at], flat[who, at] * off[who] + 2e-6
            return
        scratch, sums = np.zeros(len(self.terms)), np.empty(len(docs))
        first, of_term, of_impact, last = self.by_doc_first.tolist(), self.by_doc_term, self.by_doc_impact, -1
        for j, (i, d) in enumerate(zip(who.tolist(), docs.tolist(), strict=True)):
            if i != last:
                if last >= 0:
                    scratch[term[mine_first[last] : mine_first[last + 1]]] = 0
                own, last = slice(mine_first[i], mine_first[i + 1]), i
                scratch[term[own]] = weight[own]
            sums[j] = scratch[of_term[first[d] : first[d + 1]]] @ of_impact[first[d] : first[d + 1]]
        good = sums > 0
        if good.any():
            yield batch[who[good]], self.row[docs[good]], sums[good]


def find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``known`` (rising) each wanted value is or would be, and whether it is there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return at, known[at] == wanted


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges in a row, and which range each is of."""
    n = end - first
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    at = np.repeat((first - (np.cumsum(n) - n)).astype(np.int32 if len(owner) < 1 << 31 else np.int64), n)
    at += np.arange(len(at), dtype=at.dtype)
    return at, owner
