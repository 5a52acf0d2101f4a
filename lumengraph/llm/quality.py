"""Quality classifier from weak labels.

1. Heuristic labellers vote bad or good, or don't vote, on each document (``votes``).
2. Expectation-maximisation over the counts of all documents' vote patterns estimates each labeller's
   accuracy and each pattern's posterior (``fit_votes``; at most 3^labellers patterns reach the driver, whatever the input).
3. A linear scorer over hashed features (word shapes, repetition) learns the posteriors on a bounded,
   balanced sample: at most ``sample`` documents of either side (``fit_scorer``).
4. ``score_documents`` gives every document's probability of being good; ``accepted`` is >= 0.5.

Word shape: runs of capitals, small letters, digits collapsed, other ASCII kept, the rest a letter.

Defined results: a null or wordless text gets no votes and the scorer's value for no features; null or
repeated doc_ids each keep a row; with no documents nothing is learnt and there are no rows; other
columns are not read (``accepted_documents`` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_batches
from .textbytes import NOT_SPACE, U, Words, buffers

BITS = 12
#: Samples that train the scorer: at most this many documents of either posterior label.
SAMPLE = 2000
BAD, NONE, GOOD = 0, 1, 2

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[[*range(9), *range(14, 32), 127]] = True


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


class Signals:
    """What the labellers and the scorer see of a batch of documents."""

    NAMES = ("capitals", "marks", "exclaims", "bars", "repeats", "variety", "word_length", "controls", "ordinary", "words")

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        texts = texts.fill_null("")
        low, off = buffers(texts)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if len(texts) else 0
        raw = raw[first : first + len(low)]
        w = self.words = Words(low, off, NOT_SPACE)
        n = self.n = w.counts

        def per_doc(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[off[1:]] - sums[off[:-1]]

        def per_doc_words(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[w.first[1:]] - sums[w.first[:-1]]

        dense = per_doc(NOT_SPACE[raw])
        h, doc = w.hashes(), w.doc()
        same = np.zeros(len(h), bool)
        if len(h):
            same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        keys = np.sort((doc.astype(U) << U(40)) | (h >> U(24)))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        distinct = np.bincount((keys[fresh] >> U(40)).astype(np.int64), minlength=len(n))
        # a word is ordinary if it has letters only, but for one mark at its end
        alphabetic = _SHAPE[raw] != raw
        alphabetic |= _LETTER[raw]
        strange = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(~alphabetic, out=strange[1:])
        others = strange[w.end] - strange[w.start]
        self.values = np.stack([
            _share(per_doc(raw != low), per_doc(_LETTER[raw])),
            _share(per_doc(_MARK[raw]), dense),
            _share(per_doc(raw == 33), n),
            _share(per_doc_words((w.end - w.start == 1) & (low[w.start] == 124)), n),
            _share(per_doc_words(same), n),
            _share(distinct, n),
            _share(dense, n),
            _share(per_doc(_CONTROL[raw]), dense),
            _share(per_doc_words(others - ~alphabetic[w.end - 1] <= 0), n),
            n.astype(float),
        ])
        self._raw, self._off = raw, off

    def votes(self) -> np.ndarray:
        """Rows of votes, a column per labeller."""
        caps, marks, exclaims, bars, repeats, variety, length, controls, ordinary, n = self.values
        some = n > 0
        long = n >= 50

        def bad(fires: np.ndarray) -> np.ndarray:
            return np.where(fires & some, BAD, NONE)

        plain = (caps < 0.2) & (marks < 0.05) & (bars < 0.03) & (repeats < 0.1) & (exclaims < 0.2) & (length < 20) & (controls < 0.001)
        return np.stack([
            bad((caps > 0.6) & (n >= 5)),
            bad((marks > 0.15) & (n >= 2)),
            bad((exclaims > 0.6) & (n >= 5)),
            bad((bars > 0.1) & (n >= 5)),
            bad((repeats > 0.3) & (n >= 5)),
            bad((ordinary < 0.4) & (n >= 2)),
            bad((length > 30) | (length < 1.5) | (controls > 0.05)),
            np.where(some & plain & (~long | (variety > 0.25)), GOOD, NONE),
        ], axis=1)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed feature and weight of each word, in word order; weights of a document add up to 1."""
        w = self.words
        shape = _SHAPE[self._raw]
        keep = NOT_SPACE[self._raw]
        run = np.zeros(len(shape), bool)
        if len(shape):
            run[1:] = shape[1:] == shape[:-1]
        run[w.start] = False
        keep &= ~run
        at = np.zeros(len(shape) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        shapes = Words.__new__(Words)
        shapes.buf, shapes.start, shapes.end = shape[keep], at[w.start], at[w.end]
        return (shapes.hashes() >> U(64 - BITS)).astype(np.int64), 1.0 / np.repeat(np.maximum(self.n, 1), self.n)

    def extra(self) -> np.ndarray:
        """Document-level features beside the hashed ones: repetition, capitals, marks, exclamations, bars."""
        caps, marks, exclaims, bars, repeats, *_ = self.values
        return np.stack([repeats, caps, marks, np.minimum(exclaims, 1), bars], axis=1)


N_EXTRA, N_VOTERS = 5, 8


def codes(texts: pa.Array) -> np.ndarray:
    """Each document's vote pattern as one number."""
    return Signals(texts).votes() @ (3 ** np.arange(N_VOTERS))


def fit_votes(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior of good for each pattern, by expectation-maximisation of the labellers' accuracies.

    A labeller's vote is right with a probability of its own, whatever the class; no vote says
    nothing. Expectation: posteriors by Bayes' rule from the accuracies, both classes alike before any
    vote. Maximisation: the expected share of right votes, with ten votes' worth of belief that a
    heuristic is right four times in five.
    """
    if not counts:
        return {}
    pats = np.array(sorted(counts))
    n = np.array([counts[p] for p in pats.tolist()], float)
    votes = pats[:, None] // 3 ** np.arange(N_VOTERS) % 3
    says_good, says_bad = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    accuracy = np.full(N_VOTERS, 0.8)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        good = 1 / (1 + np.exp(-(says_good - says_bad) @ odds))
        right = (n * good) @ says_good + (n * (1 - good)) @ says_bad
        new = (right + 8) / (n @ (says_good + says_bad) + 10)
        if np.abs(new - accuracy).max() < 1e-9:
            break
        accuracy = new
    return dict(zip(pats.tolist(), good.tolist(), strict=True))


def pattern_counts(docs: DataFrame) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            p, n = np.unique(codes(b.column(1)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], names=["pattern", "n"])

    rows = id_text(docs).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in rows.collect()}


def fit_scorer(docs: DataFrame, good: dict[int, float], counts: dict[int, int], sample: int = SAMPLE, steps: int = 300) -> np.ndarray:
    """Weights (hashed features, then the extra ones, then the bias) of a logistic scorer of the posteriors."""
    dim = (1 << BITS) + N_EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            s = Signals(b.column(1))
            p = [good.get(c, 0.5) for c in (s.votes() @ (3 ** np.arange(N_VOTERS))).tolist()]
            idx, _ = s.features()
            extra = s.extra()
            rows_i, rows_v = [], []
            for d in range(b.num_rows):
                i, v = np.unique(idx[s.words.first[d] : s.words.first[d + 1]], return_counts=True)
                rows_i.append(np.concatenate([i, np.arange(1 << BITS, dim)]).astype(np.int32))
                rows_v.append(np.concatenate([v / max(int(s.n[d]), 1), extra[d]]))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(p), pa.array([x.tolist() for x in rows_i], pa.list_(pa.int32())), pa.array([x.tolist() for x in rows_v], pa.list_(pa.float64()))], names=["u", "p", "i", "v"])

    x, y = [], []
    for side in (0, 1):
        of_side = {c: n for c, n in counts.items() if (good[c] >= 0.5) == bool(side)}
        if not sum(of_side.values()):
            continue
        # a hash below the bound: about 1.5 times the sample over both sides together, cut at the sample
        bound = min(1.0, 1.5 * sample / sum(of_side.values()))
        u = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
        rows = id_text(docs).withColumn("u", u).where(F.col("u") <= bound).mapInArrow(run, "u double, p double, i array<int>, v array<double>")
        for r in rows.where(F.col("p") >= 0.5 if side else F.col("p") < 0.5).orderBy("u").limit(sample).collect():
            v = np.zeros(dim + 1)
            v[r["i"]] = r["v"]
            v[-1] = 1
            x.append(v)
            y.append(r["p"])
    return logistic(np.array(x), np.array(y), steps) if x else np.zeros(dim + 1)


def logistic(x: np.ndarray, y: np.ndarray, steps: int, l2: float = 1e-4, rate: float = 4.0) -> np.ndarray:
    """Class-balanced logistic regression on soft labels by accelerated full-batch descent."""
    one, zero = max(y.sum(), 1e-9), max((1 - y).sum(), 1e-9)
    weight = y / one + (1 - y) / zero
    weight *= 1 / weight.sum()
    w = v = np.zeros(x.shape[1])
    decay = np.full(x.shape[1], l2)
    decay[-1] = 0
    for t in range(1, steps + 1):
        grad = x.T @ (weight * (1 / (1 + np.exp(-(x @ v))) - y)) + decay * v
        new = v - rate * grad
        v = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


def probabilities(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    s = Signals(texts)
    idx, value = s.features()
    sums = np.zeros(len(idx) + 1)
    np.cumsum(weights[idx] * value, out=sums[1:])
    z = sums[s.words.first[1:]] - sums[s.words.first[:-1]] + s.extra() @ weights[1 << BITS : -1] + weights[-1]
    return 1 / (1 + np.exp(-z))


class Model:
    """Vote posteriors and scorer weights, learnt from all vote patterns of ``docs``."""

    def __init__(self, docs: DataFrame, sample: int = SAMPLE):
        self.counts = pattern_counts(docs)
        self.good = fit_votes(self.counts)
        self.weights = fit_scorer(docs, self.good, self.counts, sample)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, quality (probability of good), weak_label (posterior of the votes), accepted."""
    good, weights = model.good, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            p = probabilities(b.column(1), weights)
            weak = [good.get(c, 0.5) for c in codes(b.column(1)).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(weak, pa.float64()), pa.array(p >= 0.5)], names=["doc_id", "quality", "weak_label", "accepted"])

    return id_text(docs).mapInArrow(run, "doc_id long, quality double, weak_label double, accepted boolean")


def accepted_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer accepts, with all their columns; nothing is shuffled."""
    at, weights = docs.columns.index(text_col), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, at):
            yield b.filter(pa.array(probabilities(b.column(at), weights) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
