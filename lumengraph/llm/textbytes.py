"""Numpy kernels over UTF-8 bytes: word spans, word and n-gram hashes, XXH64 of spans.

A batch of texts is one byte buffer with document offsets. Every kernel is a fixed number of
vector operations over that buffer, so its memory is a small multiple of the buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a word: everything but ASCII white space (0x09-0x0D and 0x20).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            t = np.full(m, base, U)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of the input."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, ASCII letters in lower case, and offsets (one more than texts); a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.large_string())
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return _LOWER[raw], off - off[0]


class Words:
    """Word spans of a batch: byte start and end, the document of each, and each document's first word."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray):
        self.buf, self.off = buf, off
        inside = table[buf]
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before &= ~edge[:n]
            after &= ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)  # of each document, and the total
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial from prefix sums, then ``mix``."""
        up, down = _power_tables(len(self.buf) + 1)
        if not hasattr(self, "sums"):  # of the buffer, whatever the spans
            self.sums = np.empty(len(self.buf) + 1, U)
            self.sums[0] = 0
            np.cumsum((self.buf.astype(U) + U(1)) * up[: len(self.buf)], out=self.sums[1:])
        sums = self.sums
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i+k-1 for each i (len(h)-k+1 of them); it ignores document borders."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    g = np.full(n, k, U)
    for j in range(k):
        g = mix(g * U(_BASE) + h[j : j + n])
    return g


def within(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which starts i have words i to i+k-1 in one document."""
    ok = np.ones(max(n_words - k + 1, 0), bool)
    for j in range(1, k):
        bad = first[1:-1] - j
        bad = bad[(bad >= 0) & (bad < len(ok))]
        ok[bad] = False
    return ok


_P1, _P2, _P3 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_P4, _P5 = U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:end] for each span: spans of one length are hashed together, lane by lane."""
    out = np.empty(len(start), U)
    if not len(start):
        return out
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    as8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    as4 = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    length = end - start
    order = np.argsort(length, kind="stable")
    sorted_len = length[order]
    bounds = np.flatnonzero(np.diff(sorted_len)) + 1
    s64 = U(seed & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        for lo, hi in zip(np.r_[0, bounds], np.r_[bounds, len(order)], strict=True):
            rows, n = order[lo:hi], int(sorted_len[lo])
            at = start[rows]
            p = 0
            if n >= 32:
                v = [np.full(len(rows), x, U) for x in (s64 + _P1 + _P2, s64 + _P2, s64, s64 - _P1)]
                while p + 32 <= n:
                    for j in range(4):
                        v[j] = _round(v[j], as8[at + p + 8 * j].astype(U))
                    p += 32
                h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
                for x in v:
                    h = (h ^ _round(np.zeros(len(rows), U), x)) * _P1 + _P4
            else:
                h = np.full(len(rows), s64 + _P5, U)
            h = h + U(n)
            while p + 8 <= n:
                h = _rot(h ^ _round(np.zeros(len(rows), U), as8[at + p].astype(U)), 27) * _P1 + _P4
                p += 8
            if p + 4 <= n:
                h = _rot(h ^ (as4[at + p].astype(U) * _P1), 23) * _P2 + _P3
                p += 4
            while p < n:
                h = _rot(h ^ (data[at + p].astype(U) * _P5), 11) * _P1
                p += 1
            h = (h ^ (h >> U(33))) * _P2
            h = (h ^ (h >> U(29))) * _P3
            out[rows] = h ^ (h >> U(32))
    return out
