"""Byte-level BPE with word ends over whole batches, in numpy; the ids are those of the tokenizer library.

A batch of texts is cut into pieces (runs of letters, single digits, runs of other marks), equal pieces
are merged once, all pieces of one length together, one merge of each per step. Words with anything but
ASCII and the letters U+00C0 to U+00FF, with an apostrophe or with the start of a special token go to
the library, each different word once.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .textbytes import U, Words, buffers

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _CLASS[65:91] = _LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[39] = _ODD
_NO_RANK = np.int32(2**31 - 1)
LONGEST = 48
#: Places of the table of known pieces (a power of two): at most half of them are taken.
_TABLE_BITS = 21


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(prints) else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 8
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.ends_sentence = np.zeros(self.size, bool)
        for piece, i in vocab.items():
            body = piece.removesuffix(suffix)
            self.ends_sentence[i] = piece.endswith(suffix) and body != "" and all(not c.isalnum() for c in body) and any(c in ".!?" for c in body)
        self._build(keys, made)
        self._forget()

    def _build(self, keys: np.ndarray, made: np.ndarray) -> None:
        """A hash table with linear probing: pair key -> rank and new id."""
        bits = 20
        self._shift, self._mask = 64 - bits, (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, _NO_RANK, np.int32)
        self.slot_made = np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.slot_key[at] == -1
            _, firsts = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[firsts]
            self.slot_key[at[take]], self.slot_rank[at[take]], self.slot_made[at[take]] = keys[left[take]], left[take], made[left[take]]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, at = left[rest], (at[rest] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> U(self._shift)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or an empty slot."""
        at = self._slot(keys)
        got = self.slot_key[at]
        wrong = np.flatnonzero((got != keys) & (got != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self._mask
            got = self.slot_key[at[wrong]]
            wrong = wrong[(got != keys[wrong]) & (got != -1)]
        return at

    def merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equally many symbols -> merged rows (left-aligned) and their lengths."""
        n, width = symbols.shape
        out = symbols.copy()
        lengths = np.full(n, width, np.int64)
        if width == 1:
            return out, lengths
        rows = np.arange(n)
        s = symbols.astype(np.int64)
        slots = self._find(((s[:, :-1] << 20) | s[:, 1:]).ravel()).reshape(n, width - 1)
        ranks, made = self.slot_rank[slots], self.slot_made[slots]
        while len(rows):
            p = ranks.argmin(1)
            k = np.arange(len(rows))
            live = ranks[k, p] != _NO_RANK
            if not live.all():
                done = ~live
                out[rows[done], : s.shape[1]] = s[done]
                rows, s, ranks, made, p = rows[live], s[live], ranks[live], made[live], p[live]
                k = np.arange(len(rows))
                if not len(rows):
                    break
            lengths[rows] -= 1
            s[k, p] = made[k, p]
            shift = np.arange(s.shape[1] - 1)[None, :] > p[:, None]
            s = np.where(shift, s[:, 1:], s[:, :-1])  # the last place of each row is free now
            if s.shape[1] == 1:
                out[rows, :1] = s
                break
            ranks = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            made = np.where(shift[:, :-1], made[:, 1:], made[:, :-1])
            for q in (p - 1, p):
                ok = (q >= 0) & (q < lengths[rows] - 1)
                kk, qq = k[ok], q[ok]
                slot = self._find((s[kk, qq] << 20) | s[kk, qq + 1])
                ranks[kk, qq], made[kk, qq] = self.slot_rank[slot], self.slot_made[slot]
            beyond = (p == lengths[rows] - 1) & (p < ranks.shape[1])
            ranks[k[beyond], p[beyond]] = _NO_RANK
        return out, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the first id of each text (one more than texts)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        low, off = buffers(texts)
        start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if len(texts) else 0
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[start : start + len(low)]
        kind = _CLASS[raw]
        # letters U+00C0 to U+00FF: two bytes, 0xC3 and 0x80 to 0xBF, but not the signs 0x97 and 0xB7
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        tail = raw[lead + 1]
        good = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
        kind[good] = kind[good + 1] = _LETTER
        capital = good[raw[good + 1] <= 0x9E] + 1
        low[capital] += 0x20
        special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)) if self.special else np.zeros(0, np.int64)
        kind[special] = _ODD
        n = len(raw)
        words = Words(low, off, _CLASS != _SPACE)
        odd = words.end - words.start > 1 << 12
        odd[np.searchsorted(words.start, np.flatnonzero(kind == _ODD), "right") - 1] = True
        # pieces: a word's start, a change of class, any digit; an odd word is one piece
        begins = np.zeros(n, bool)
        if n:
            begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins &= kind != _SPACE
        for k in np.flatnonzero(odd).tolist():
            begins[words.start[k] : words.end[k]] = False
        begins[words.start] = True
        p = Words.__new__(Words)
        p.buf, p.start = low, np.flatnonzero(begins)
        word = np.searchsorted(words.start, p.start, "right") - 1
        p.end = words.end[word]
        if len(p.start):
            same = word[1:] == word[:-1]
            p.end[:-1][same] = p.start[1:][same]
        is_odd = odd[word] if len(word) else np.zeros(0, bool)
        first, counts = self._pieces(p, is_odd, raw)
        total = np.zeros(len(p.start) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ids = self.pool[np.repeat(first - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[np.searchsorted(p.start, off)]

    def _forget(self) -> None:
        """Start the table of known pieces afresh; it never holds more than half of its places."""
        self.known = np.zeros(1 << _TABLE_BITS, U)  # 0: free
        self.known_first = np.zeros(1 << _TABLE_BITS, np.int64)
        self.known_count = np.zeros(1 << _TABLE_BITS, np.int32)
        self.pool, self.held, self.entries = np.zeros(1 << 20, np.int32), 0, 0
        self.by_library: dict[bytes, tuple[int, int]] = {}

    def _store(self, ids: np.ndarray) -> int:
        while self.held + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        return self.held - len(ids)

    def _places(self, key: np.ndarray) -> np.ndarray:
        """Each key's place in the table of known pieces, or a free place."""
        mask = (1 << _TABLE_BITS) - 1
        at = (key >> U(64 - _TABLE_BITS)).astype(np.int64)
        got = self.known[at]
        wrong = np.flatnonzero((got != key) & (got != 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            got = self.known[at[wrong]]
            wrong = wrong[(got != key[wrong]) & (got != 0)]
        return at

    def _pieces(self, p: Words, odd: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece its first place in the pool of ids and the number of ids; equal pieces share them."""
        size = p.end - p.start
        first, counts = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        if not len(size):
            return first, counts
        odd = odd | (size > LONGEST)
        plain = np.flatnonzero(~odd)
        if len(plain):
            key = p.hashes()[plain] | U(1)
            at = self._places(key)
            new = np.flatnonzero(self.known[at] == 0)
            if len(new):
                fresh, example = np.unique(key[new], return_index=True)
                if self.entries and self.entries + len(fresh) > 1 << (_TABLE_BITS - 1):
                    self._forget()
                    new = np.arange(len(plain))
                    fresh, example = np.unique(key, return_index=True)
                self._learn(fresh, p, plain[new[example]], size)
                at[new] = self._places(key[new])
            first[plain], counts[plain] = self.known_first[at], self.known_count[at]
        rest = np.flatnonzero(odd)
        if len(rest):
            spans = [raw[p.start[k] : p.end[k]].tobytes() for k in rest.tolist()]
            if len(self.by_library) > 200_000:
                self.by_library.clear()
            new = list(set(spans).difference(self.by_library))
            coded = self.library.encode_batch([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
            for w, e in zip(new, coded, strict=True):
                self.by_library[w] = (self._store(np.array(e.ids, np.int32)), len(e.ids))
            first[rest], counts[rest] = np.array([self.by_library[w] for w in spans]).T
        return first, counts

    def _learn(self, keys: np.ndarray, p: Words, example: np.ndarray, size: np.ndarray) -> None:
        """Merge pieces not seen before (one example each) and put them into the table."""
        lengths = size[example]
        begin, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        for width in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == width)
            chars = p.buf[p.start[example[at]][:, None] + np.arange(width)]
            symbols = self.inner[chars]
            symbols[:, -1] = self.final[chars[:, -1]]
            rows, n = self.merge(symbols)
            begin[at] = self._store(rows[np.arange(width)[None, :] < n[:, None]]) + np.cumsum(n) - n
            count[at] = n
        left = np.arange(len(keys))
        while len(left):
            at = self._places(keys[left])
            _, one = np.unique(at, return_index=True)
            self.known[at[one]], self.known_first[at[one]], self.known_count[at[one]] = keys[left[one]], begin[left[one]], count[left[one]]
            left = np.delete(left, one)
        self.entries += len(keys)
