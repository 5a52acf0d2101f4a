"""Language-model scores from a trigram trie in Elias-Fano form, built and queried in shards.

Model: shares of order 3, 2 and 1, interpolated; the weight of a share rises with the count c of its
context (``trust``: 1 - a * c^-b, a smooth form of weights by count); the unseen word is one type whose
probability is the Good-Turing mass of the words seen once:

    p(w | u v) = t3(c(uv)) * c(uvw) / c(uv) + (1 - t3) * p(w | v)
    p(w | v)   = t2(c(v)) * c(vw) / c(v) + (1 - t2) * p(w)
    p(w)       = c(w) / N * (1 - s),   p(unseen) = s = words seen once / N

A document is its words (ASCII letters in lower case, ASCII white space between) and one end, read after a
start; its first token has no trigram. Every training document counts; nothing is pruned.

``NgramTrie`` is one shard. Level one: first words u. Level two: for each u its successors v. Level three:
for each (u, v) its successors w. A level is an Elias-Fano sequence of pointers to each context's run and an
Elias-Fano sequence of successors, each run of word ranks moved up past the run before; 16-bit codes are
the logarithms of the counts in steps of 1/4096 of a decade, and the difference of two codes is the
logarithm of a share, quantised. A look-up selects in the encoded bits: the context's two pointers, the
value its run starts from, then the successor, which counts only between the pointers. Nothing is
decoded as a whole. ``save`` writes the levels as flat files and ``load`` maps them into memory; within a
Spark task a trie lives in memory, as executors share no local files.

Plan: (1) documents are cut into chunks of about ``CHUNK`` bytes, written once to the shared folder: all
later steps read the same chunks, whatever executors come or go. (2) Word counts, by ranges of word hashes.
(3) A chunk sends each shard its different bigrams and trigrams with training counts; a shard adds them
up, builds its trie and answers with codes. (4) A chunk puts the answers together. A shard holds a
range of the hashes of u; a word with over ``HOT`` tokens (or 1/65536 of all, if that is more: so at most
65536 words are sent to all tasks) is split by v, and a pair of two such words by w, so that no word or
pair fills a shard.

Words are told apart by 64-bit hashes, within a shard by their leading bits: 48 of first words, 32 of successors. A
look-up of an n-gram that isn't there finds one of its context's n successors with a chance of n / 2^32 (2e-6 for 10,000).

Defined results: a null or empty text is its end alone; a null doc_id is not held out; repeated rows count
and score each; with nothing to train on every score is that of unseen words (s = 1); other columns are
not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, id_text, text_batches
from .textbytes import NOT_SPACE, U, Words, buffers, mix

CHUNK, SHARD_BYTES, WORD_SHARD_BYTES = 8 << 20, 6 << 20, 32 << 20
HOT = 1 << 20
START, END = U(0x5354415254), U(0x454E44454E44)
#: Leading bits of word hashes that a trie keeps: 48 of first words, 32 of successors.
_TOP48, _TOP32 = U(16), U(32)
_STEP = 4096.0
#: (a, b) of ``trust`` for bigrams and trigrams.
TRUST2, TRUST3 = (0.9, 0.25), (0.85, 0.5)


def trust(count: np.ndarray, a: float, b: float) -> np.ndarray:
    """How far the shares of a context seen ``count`` times are believed: 0 for none, towards 1 for many."""
    return np.where(count > 0, 1 - a * np.maximum(count, 1.0) ** -b, 0.0)


def codes_of(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.rint(np.log10(np.maximum(count, 1)) * _STEP) + 1, 65535), 0).astype(np.uint16)


def counts_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes.astype(float) - 1) / _STEP), 0.0)


def _nth_one(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the k-th set bit (from 0) of each 64-bit word is."""
    words, k, at = words.copy(), k.astype(np.int64), np.zeros(len(words), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & U((1 << s) - 1)).astype(np.int64)
        up = k >= low
        k -= np.where(up, low, 0)
        at += np.where(up, s, 0)
        words >>= np.where(up, U(s), U(0))
    return at


class EliasFano:
    """A rising sequence of unsigned integers in about 2 + log2(universe / n) bits each, searched as it is."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        #: ones before each 64-bit word of the upper bits
        self.ones = np.append(0, np.cumsum(np.bitwise_count(high).astype(np.int64)))
        self.zeros = 64 * np.arange(len(self.ones)) - self.ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(8, np.uint8), np.zeros(2, U))
        bits = max(0, min(56, int(np.log2(max(int(values[-1]), 1) / n)) if int(values[-1]) > n else 0))
        v = values.astype(U)
        at = (v >> U(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros((int(at[-1]) // 64 + 2) * 64, np.uint8)
        ones[at] = 1
        low = np.zeros(0, np.uint8)
        if bits:
            parts = [np.unpackbits((v[i : i + (1 << 16)] & U((1 << bits) - 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel() for i in range(0, n, 1 << 16)]
            low = np.packbits(np.concatenate(parts), bitorder="little")
        return cls(n, bits, np.append(low, np.zeros(8, np.uint8)), np.packbits(ones, bitorder="little").view(U))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (words[at >> 3] >> (at & 7).astype(U) & U((1 << self.bits) - 1)).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i, "right") - 1
        high = 64 * word + _nth_one(self.high[word], i - self.ones[word]) - i
        return high << self.bits | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of the first value that isn't smaller, if it is equal; else -1."""
        out = np.full(len(values), -1)
        if not self.n or not len(values):
            return out
        high, low = values >> self.bits, values & ((1 << self.bits) - 1)
        ask = np.flatnonzero(high < self.zeros[-1])
        high, low = high[ask], low[ask]
        # values of one upper part are the ones between two zeros: a binary search of their lower bits
        place = np.where(high > 0, self._zero(high - 1) + 1, 0) - high
        end = self._zero(high) - high
        last = end.copy()
        on = np.flatnonzero(place < end)
        while len(on):
            middle = place[on] + end[on] >> 1
            less = self._lows(middle) < low[on]
            place[on[less]] = middle[less] + 1
            end[on[~less]] = middle[~less]
            on = on[place[on] < end[on]]
        on = np.flatnonzero(place < last)
        hit = on[self._lows(place[on]) == low[on]]
        out[ask[hit]] = place[hit]
        return out

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th zero of the upper bits is."""
        word = np.maximum(np.searchsorted(self.zeros, k, "right") - 1, 0)
        return 64 * word + _nth_one(~self.high[word], k - self.zeros[word])

    def decode(self) -> np.ndarray:
        return self.at(np.arange(self.n))


class Level:
    """Successors of contexts: each context's run of rising ranks, with a code each."""

    def __init__(self, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.pointers, self.successors, self.codes = pointers, successors, codes

    @classmethod
    def build(cls, contexts: int, owner: np.ndarray, rank: np.ndarray, count: np.ndarray) -> Level:
        """``owner`` rises, and ``rank`` within each owner."""
        pointers = np.searchsorted(owner, np.arange(contexts + 1))
        last = np.flatnonzero(np.diff(owner, append=contexts + 1))
        # each run starts past the greatest value of the run before
        base = np.append(0, np.cumsum(rank[last] + 1)) if len(owner) else np.zeros(1, np.int64)
        run = np.cumsum(np.diff(owner, prepend=-1) > 0) - 1
        return cls(EliasFano.encode(pointers), EliasFano.encode(base[run] + rank if len(owner) else rank), codes_of(count))

    def find(self, owner: np.ndarray, per_owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Places of the ranks among the successors of their owners (-1: none); negative owners and ranks have none."""
        known = owner >= 0
        begin, end = (self.pointers.at(np.where(known, owner, 0) + d) for d in (0, 1))
        base = np.where(begin > 0, self.successors.at(np.maximum(begin - 1, 0)) + 1, 0) if self.successors.n else begin
        of = np.repeat(np.arange(len(owner)), per_owner)
        ask = np.flatnonzero((rank >= 0) & (known & (end > begin))[of])
        of = of[ask]
        place = self.successors.find(base[of] + rank[ask])
        out = np.full(len(rank), -1)
        out[ask] = np.where((place >= begin[of]) & (place < end[of]), place, -1)
        return out

    def code(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.codes[np.maximum(place, 0)], 0).astype(np.uint16) if len(self.codes) else np.zeros(len(place), np.uint16)


def _rank(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return np.where(known[at] == wanted, at, -1)


class NgramTrie:
    """One shard: first words by hash, the words of its n-grams by 32 bits of it, two levels of successors."""

    FILES = ("contexts", "words", *(f"{level}_{x}" for level in ("bigrams", "trigrams") for x in ("pointers_low", "pointers_high", "low", "high", "codes")))

    def __init__(self, contexts: np.ndarray, words: np.ndarray, bigrams: Level, trigrams: Level):
        self.contexts, self.words, self.bigrams, self.trigrams = contexts, words, bigrams, trigrams

    @classmethod
    def build(cls, u: np.ndarray, v: np.ndarray, count: np.ndarray, parent: np.ndarray, w: np.ndarray, count3: np.ndarray) -> NgramTrie:
        """From bigrams (u, v, count) and trigrams (bigram's number, w, count), in any order, repeated at will."""
        three = np.flatnonzero(count3 > 0)
        parent, w, count3 = parent[three], w[three], count3[three].astype(np.int64)
        used = count > 0
        used[parent] = True
        two = np.flatnonzero(used)
        contexts, words = np.unique(u[two]), np.unique(np.concatenate([v[two], w]))
        size = max(len(words), 1)
        key = np.searchsorted(contexts, u[two]) * size + np.searchsorted(words, v[two])
        nodes, same = np.unique(key, return_inverse=True)
        total = np.bincount(same, count[two], len(nodes)).astype(np.int64)
        number = np.zeros(len(u), np.int64)
        number[two] = same
        key3 = number[parent] * size + np.searchsorted(words, w)
        order = np.argsort(key3)
        key3 = key3[order]
        first = np.flatnonzero(np.diff(key3, prepend=-1))
        total3 = np.add.reduceat(count3[order], first) if len(first) else np.zeros(0, np.int64)
        key3 = key3[first]
        return cls(contexts, words, Level.build(len(contexts), nodes // size, nodes % size, total), Level.build(len(nodes), key3 // size, key3 % size, total3))

    def find(self, u: np.ndarray, per_u: np.ndarray, v: np.ndarray, per_v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the bigrams (each u with its v's) and of the trigrams (each of those with its w's); 0: not there."""
        node = self.bigrams.find(_rank(self.contexts, u), per_u, _rank(self.words, v))
        return self.bigrams.code(node), self.trigrams.code(self.trigrams.find(node, per_v, _rank(self.words, w)))

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        arrays, sizes = [self.contexts, self.words], []
        for level in (self.bigrams, self.trigrams):
            p, s = level.pointers, level.successors
            arrays += [p.low, p.high, s.low, s.high, level.codes]
            sizes += [p.n, p.bits, s.n, s.bits]
        for name, a in zip(self.FILES, arrays, strict=True):
            np.save(f"{folder}/{name}.npy", a)
        with open(f"{folder}/sizes.json", "w") as f:
            json.dump(sizes, f)

    @classmethod
    def load(cls, folder: str) -> NgramTrie:
        contexts, words, *a = (np.load(f"{folder}/{name}.npy", mmap_mode="r") for name in cls.FILES)
        with open(f"{folder}/sizes.json") as f:
            n = json.load(f)
        levels = [Level(EliasFano(n[4 * k], n[4 * k + 1], a[5 * k], a[5 * k + 1]), EliasFano(n[4 * k + 2], n[4 * k + 3], a[5 * k + 2], a[5 * k + 3]), a[5 * k + 4]) for k in (0, 1)]
        return cls(contexts, words, *levels)


def _squeeze(a: np.ndarray) -> bytes:
    """Small integers byte plane by byte plane, compressed, behind their number of bytes each and their count."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    raw = planes.tobytes()
    return bytes([width]) + len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _expand(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(raw[9:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.ravel().view("<i8")


def _six(words: np.ndarray) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.ravel().view("<u8").astype(U)


def _four(words: np.ndarray) -> bytes:
    return words.astype("<u4").tobytes()


def _from_four(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(U)


class Chunk:
    """Some documents as numbers of their words, the more frequent the smaller."""

    def __init__(self, ids: list, held: np.ndarray, sizes: np.ndarray, start: int, token: np.ndarray, high: np.ndarray, low: np.ndarray | None):
        """``sizes``: tokens of each document; ``start``: the start's number; ``high`` and ``low``: halves of the words' hashes."""
        self.ids, self.held, self.sizes, self.start, self.token, self.high, self.low = ids, held, sizes, start, token, high, low
        self.trained = np.repeat(~held, sizes)
        #: words by the upper halves of their hashes, as they are sent
        self.by_hash = np.argsort(high, kind="stable")

    def hashes(self) -> np.ndarray:
        return (self.high.astype(U) << U(32) | self.low)[self.by_hash]

    @classmethod
    def of(cls, ids: list, hashes: np.ndarray, words: np.ndarray, modulus: int, remainder: int) -> Chunk:
        held = np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in ids], bool)
        token = np.insert(hashes, np.cumsum(words), END)
        vocabulary, number = np.unique(np.append(token, START), return_inverse=True)
        order = np.argsort(-np.bincount(number), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        vocabulary = vocabulary[order]
        return cls(ids, held, words + 1, int(place[number[-1]]), place[number[:-1]], (vocabulary >> U(32)).astype(np.uint32), vocabulary.astype(np.uint32))

    def counts(self) -> np.ndarray:
        """Training counts by word; the start counts once per document."""
        n = np.bincount(self.token[self.trained], minlength=len(self.high))
        n[self.start] = int((~self.held).sum())
        return n

    def saved(self, number: int) -> tuple:
        meta = json.dumps([self.ids, self.held.tolist(), self.sizes.tolist(), self.start]).encode()
        return number, int(self.trained.sum()), pa.compress(meta, codec="zstd", asbytes=True), len(meta), _squeeze(self.token), self.high.tobytes(), self.low.tobytes()

    @classmethod
    def read(cls, meta: bytes, size: int, token: bytes, high: bytes, low: bytes | None = None) -> Chunk:
        ids, held, sizes, start = json.loads(pa.decompress(meta, decompressed_size=size, codec="zstd", asbytes=True))
        return cls(ids, np.array(held, bool), np.array(sizes, np.int64), start, _expand(token), np.frombuffer(high, np.uint32), None if low is None else np.frombuffer(low, np.uint32))


_CHUNK = "chunk long, trained long, meta binary, size long, token binary, high binary, low binary"
_BODY = ("meta", "size", "token", "high", "low")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _cut(modulus: int, remainder: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, hashes, words, held = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            return _batch([Chunk.of(ids, np.concatenate(hashes), np.concatenate(words), modulus, remainder).saved(number)], _CHUNK)

        for b in text_batches(batches):
            w = Words(*buffers(b.column(1)), NOT_SPACE)
            ids += b.column(0).to_pylist()
            hashes.append(w.hashes())
            words.append(w.counts)
            held += len(w.buf) + b.num_rows
            if held >= CHUNK:
                yield chunk()
                number += 1
                ids, hashes, words, held = [], [], [], 0
        if ids:
            yield chunk()

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.column("chunk")[k].as_py(), Chunk.read(*(b.column(c)[k].as_py() for c in _BODY))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


# word counts

_WORDS = "shard int, chunk long, hashes binary, counts binary"
#: Answers and chunk bodies of one shape: kind 0 the body, 1 word counts, 2 codes; kind 3 totals, 4 words with many tokens.
_TOLD = "chunk long, kind int, part int, a binary, b binary, c binary, d long"


def _runs(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of a rising array."""
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-2))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        yield int(of[a]), a, b


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in _each(batches):
            hashes, counts = c.hashes(), c.counts()[c.by_hash]
            yield _batch([(s, number, hashes[a:b].tobytes(), _squeeze(counts[a:b])) for s, a, b in _runs(shard_of(hashes, shards))], _WORDS)

    return run


def _answer_words(limit: int):
    def run(group: pa.Table) -> pa.Table:
        chunks, shard = group.column("chunk").to_pylist(), group.column("shard")[0].as_py()
        hashes = [np.frombuffer(x, U) for x in group.column("hashes").to_pylist()]
        known, same = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(same, np.concatenate([_expand(x) for x in group.column("counts").to_pylist()]), len(known)).astype(np.int64)
        rows = [(n, 1, shard, _squeeze(x), None, None, None) for n, x in zip(chunks, np.split(total[same], np.cumsum([len(h) for h in hashes])[:-1]), strict=True)]
        real = total[known != START]
        rows.append((-1, 3, shard, json.dumps([int(real.sum()), int((real > 0).sum()), int((real == 1).sum())]).encode(), None, None, None))
        many = total > limit
        rows.append((-1, 4, shard, known[many].tobytes(), total[many].tobytes(), None, None))
        return pa.Table.from_batches([_batch(rows, _TOLD)])

    return run


# n-grams

_ASK = "shard int, chunk long, contexts binary, runs binary, nodes binary, node_counts binary, fans binary, words binary, word_counts binary"


class Grams:
    """A chunk's different bigrams and trigrams, and where each is asked for."""

    def __init__(self, c: Chunk, shards: int, hot: tuple[np.ndarray, np.ndarray, int]):
        # words by hash, so that what is asked comes in order
        rank = np.empty(len(c.by_hash), np.int64)
        rank[c.by_hash] = np.arange(len(rank))
        token = self.token = rank[c.token]
        first = np.cumsum(c.sizes) - c.sizes
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[first] = rank[c.start]
        pairs, self.pair = np.unique(before << 32 | token, return_inverse=True)
        self.u, self.v = pairs >> 32, pairs & 0xFFFFFFFF
        inner = np.ones(len(c.token), bool)
        inner[first] = False
        self.inner = np.flatnonzero(inner)
        triples, self.triple = np.unique(self.pair[self.inner - 1] << 32 | token[self.inner], return_inverse=True)
        self.of, self.w = triples >> 32, triples & 0xFFFFFFFF
        # words with many tokens are split by their successors, pairs of two of them by theirs
        # only the upper halves tell where a word goes: a chunk comes back without the lower ones
        h = c.high[c.by_hash].astype(U)
        at = _rank(hot[0], h)
        parts = np.where(at >= 0, 1 + hot[1][at] // hot[2], 1) if len(hot[0]) else np.ones(len(h), np.int64)
        split = (h[self.v] % parts[self.u].astype(U)).astype(U)
        self.shard = shard_of(mix(mix(h[self.u]) + split), shards)
        splits = np.minimum(parts[self.u], parts[self.v])[self.of].astype(U)
        shard3 = self.shard[self.of]
        far = np.flatnonzero(splits > 1)
        node = self.of.copy()
        extra = np.zeros(0, np.int64)
        if len(far):
            p = self.of[far]
            shard3[far] = shard_of(mix(mix(h[self.u[p]] + U(1)) ^ mix(h[self.v[p]] + h[self.w[far]] % splits[far])), shards)
            extra, which = np.unique(p << 32 | shard3[far], return_inverse=True)
            node[far] = len(self.u) + which
        # nodes: every bigram, and a bigram again in each other shard that has some of its trigrams
        of_node, node_shard = np.append(np.arange(len(self.u)), extra >> 32), np.append(self.shard, extra & 0xFFFFFFFF)
        self.node_order = np.argsort(node_shard, kind="stable")
        self.of_node, self.node_shard = of_node[self.node_order], node_shard[self.node_order]
        place = np.empty(len(of_node), np.int64)
        place[self.node_order] = np.arange(len(of_node))
        self.gram_order = np.argsort(place[node], kind="stable")
        self.node_of = place[node][self.gram_order]
        self.bigrams = len(self.u)

    def rows(self, c: Chunk, number: int) -> list[tuple]:
        count = np.bincount(self.pair[c.trained], minlength=self.bigrams)
        count3 = np.bincount(self.triple[c.trained[self.inner]], minlength=len(self.w))[self.gram_order]
        node_count = np.where(self.node_order < self.bigrams, count[self.of_node], 0)
        h = c.hashes()
        u, v, w = h[self.u[self.of_node]] >> _TOP48, h[self.v[self.of_node]] >> _TOP32, h[self.w[self.gram_order]] >> _TOP32
        fans = np.bincount(self.node_of, minlength=len(u))
        ends = np.append(0, np.cumsum(fans))
        out = []
        for s, a, b in _runs(self.node_shard):
            new = np.flatnonzero(np.append(True, u[a + 1 : b] != u[a : b - 1]))
            x, y = ends[a], ends[b]
            out.append((s, number, _six(u[a:b][new]), _squeeze(np.diff(np.append(new, b - a))), _four(v[a:b]), _squeeze(node_count[a:b]), _squeeze(fans[a:b]), _four(w[x:y]), _squeeze(count3[x:y])))
        return out


def _ask(shards: int, hot: tuple[np.ndarray, np.ndarray, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in _each(batches):
            yield _batch(Grams(c, shards, hot).rows(c, number), _ASK)

    return run


def _answer(group: pa.Table) -> pa.Table:
    """All asks of one shard -> a row of codes for each chunk."""
    asks = []
    for r in group.to_batches():
        for k in range(r.num_rows):
            u, runs, v, n2, fans, w, n3 = (r.column(j)[k].as_py() for j in range(2, 9))
            asks.append((r.column(1)[k].as_py(), _from_six(u), _expand(runs), _from_four(v), _expand(n2), _expand(fans), _from_four(w), _expand(n3)))
    shift = np.cumsum([0, *(len(a[3]) for a in asks)])
    trie = NgramTrie.build(
        np.concatenate([np.repeat(a[1], a[2]) for a in asks]),
        *(np.concatenate([a[j] for a in asks]) for j in (3, 4)),
        np.concatenate([np.repeat(np.arange(len(a[3])) + s, a[5]) for a, s in zip(asks, shift, strict=False)]),
        *(np.concatenate([a[j] for a in asks]) for j in (6, 7)),
    )
    shard, rows = group.column("shard")[0].as_py(), []
    for number, u, runs, v, _, fans, w, _ in asks:
        rows.append((number, 2, shard, *(_squeeze(x) for x in trie.find(u, runs, v, fans, w)), None, None))
    return pa.Table.from_batches([_batch(rows, _TOLD)])


# scores

_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(tokens: int, types: int, once: int, shards: int, hot: tuple[np.ndarray, np.ndarray, int]):
    """``tokens``, ``types``, ``once``: of training, the end included."""
    unseen = once / tokens if tokens else 1.0
    unseen = min(max(unseen, 0.5 / (tokens + 1)), 1.0 if not tokens else 0.5)

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(n).to_pylist() for n in ("kind", "part", "a", "b", "c", "d")), strict=True), key=lambda x: x[:2])
        c = Chunk.read(rows[0][2], rows[0][5], rows[0][3], rows[0][4])
        count = np.concatenate([_expand(r[2]) for r in rows if r[0] == 1]).astype(float)
        g = Grams(c, shards, hot)
        two, three = (np.concatenate([_expand(r[j]) for r in rows if r[0] == 2] or [np.zeros(0, np.int64)]) for j in (2, 3))
        nodes = np.zeros(len(g.node_order))
        nodes[g.node_order] = counts_of(two)
        two = nodes[: g.bigrams]
        grams = np.zeros(len(g.w))
        grams[g.gram_order] = counts_of(three)
        single = np.where(count > 0, count / max(tokens, 1) * (1 - unseen), unseen)
        before = count[g.u]
        belief = trust(before, *TRUST2)
        pair = belief * two / np.maximum(before, 1) + (1 - belief) * single[g.v]
        # the trigram's own bigram (v, w) is the pair at the same token
        belief, share = trust(two, *TRUST3)[g.of], grams / np.maximum(two[g.of], 1)
        p = pair[g.pair]
        p[g.inner] = (belief * share)[g.triple] + (1 - belief)[g.triple] * p[g.inner]
        base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
        first = np.cumsum(c.sizes) - c.sizes
        known, low, high = (np.add.reduceat(x, first) for x in ((count > 0)[g.token].astype(np.int64), base[g.token], np.log10(p)))
        return pa.Table.from_batches([_batch(list(zip(c.ids, c.held.tolist(), c.sizes.tolist(), known.tolist(), [tokens] * len(c.ids), low.tolist(), high.tolist(), strict=True)), _SCORED)])

    return run


def score_documents(docs: DataFrame, modulus: int = 5, remainder: int = 1, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document row.

    Learns from the documents whose crc32(doc_id as text) modulo ``modulus`` is not ``remainder``.
    """
    spark, rows = docs.sparkSession, id_text(docs)
    folder = f"{ensure_checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or max(4, -(-size // SHARD_BYTES))
    word_shards = max(2, -(-size // WORD_SHARD_BYTES))
    chunks = kept(rows.mapInArrow(_cut(modulus, remainder), _CHUNK), "chunks", _CHUNK)
    limit = max(HOT, (chunks.agg(F.sum("trained")).first()[0] or 0) >> 16)
    words = kept(chunks.mapInArrow(_ask_words(word_shards), _WORDS).groupBy("shard").applyInArrow(_answer_words(limit), _TOLD), "words", _TOLD)
    tokens, types, once = (sum(x) for x in zip([0] * 3, *(json.loads(r["a"]) for r in words.where("kind = 3").select("a").collect()), strict=True))
    # at most 65536 words have more than the limit
    many = [(np.frombuffer(r["a"], U), np.frombuffer(r["b"], np.int64)) for r in words.where("kind = 4").select("a", "b").collect()]
    names, counts = (np.concatenate([np.zeros(0, t), *(m[j] for m in many)]) for j, t in enumerate((U, np.int64)))
    hot = names[np.argsort(names)] >> U(32), counts[np.argsort(names)], limit
    told = chunks.mapInArrow(_ask(shards, hot), _ASK).repartition(shards, "shard").groupBy("shard").applyInArrow(_answer, _TOLD)
    body = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.col("meta").alias("a"), F.col("token").alias("b"), F.col("high").alias("c"), F.col("size").alias("d"))
    return body.unionByName(words.where("kind = 1")).unionByName(told).groupBy("chunk").applyInArrow(_score(tokens, types, once, shards, hot), _SCORED)
