"""Byte-level BPE over whole batches: texts to ids and ids back to bytes, as the rank-file library does it.

A batch of texts is one byte buffer. Vector operations over character classes cut it into pieces, the
matches of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and each different piece is merged once: pieces go into buckets of like length, a bucket is a padded matrix
of ids, and in every round every row merges its leftmost pair of the least rank. Ranks of pairs come from a
hash table of all pairs whose bytes together are a token. A row without such a pair leaves the matrix
(compaction), and a matrix gets narrower by one column a round. A piece that is a token as a whole is that
token. Pieces of more than ``LONGEST`` bytes, for which the matrix would be quadratic, follow the same
rule with a heap of pairs.

Pieces of up to 16 bytes are told apart by two words of eight bytes and their length, so exactly; longer
ones by their bytes.

Defined results: a null text is an empty one (no ids, no bytes); bytes that aren't UTF-8 count as U+FFFD;
repeated rows, null ids and very long texts are rows like any other; an empty table gives no rows; other
columns are not read. Rows are never shuffled. A text of over ``BLOCK`` bytes is cut in blocks at blanks
between ASCII letters, where a piece always begins, so memory follows the block.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import KERNEL_BYTES, id_text, text_batches

U = np.uint64
LONGEST = 512
BLOCK = 2 * KERNEL_BYTES
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_NO_RANK = np.int32(2**31 - 1)
#: Stands for no id in a padded matrix; it is in no pair.
_PAD = (1 << 20) - 1
#: Places of the table of known pieces (a power of two); at most half of them are taken.
_PLACES = 1 << 20
_MIX = U(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


@lru_cache(maxsize=1)
def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """Runs of code points of one class: first code point and class of each run.

    Letters, numbers and white space are what the rank-file library itself takes for them, since Unicode
    versions differ between libraries.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
        single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = single.decode_bytes(single.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    first = np.flatnonzero(np.append(True, table[1:] != table[:-1]))
    return first.astype(np.int32), table[first]


class Table:
    """Open addressing over several columns of keys; each row of keys is stored once."""

    def __init__(self, places: int, kinds: list):
        self.mask = places - 1
        self.keys = [np.zeros(places, k) for k in kinds]
        self.taken = np.zeros(places, bool)
        self.entries = 0

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The place of each row of keys, or the free place where it would go."""
        h = keys[0].astype(U)
        for k in keys[1:]:
            h = (h ^ (h >> U(29))) * _MIX + k.astype(U)
        at = (((h ^ (h >> U(31))) * _MIX) >> U(20)).astype(np.int64) & self.mask
        left = np.arange(len(at))
        while len(left):
            here = at[left]
            other = self.taken[here] & np.logical_or.reduce([mine[here] != k[left] for mine, k in zip(self.keys, keys, strict=True)])
            left = left[other]
            at[left] = (at[left] + 1) & self.mask
        return at

    def add(self, keys: list[np.ndarray]) -> np.ndarray:
        """Stores rows of keys, all different and none known yet; returns their places."""
        place = np.empty(len(keys[0]), np.int64)
        left = np.arange(len(place))
        while len(left):
            at = self.find([k[left] for k in keys])
            _, one = np.unique(at, return_index=True)  # rows that meet at one free place: the first takes it
            for mine, k in zip(self.keys, keys, strict=True):
                mine[at[one]] = k[left[one]]
            self.taken[at[one]] = True
            place[left[one]] = at[one]
            left = np.delete(left, one)
        self.entries += len(place)
        return place


def ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices first[k], ..., first[k] + count[k] - 1 for all k in a row, and where each k's begin (one more)."""
    ends = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=ends[1:])
    return np.repeat(first - ends[:-1], count) + np.arange(ends[-1]), ends


class ByteBpe:
    def __init__(self, path: str, classes: tuple[np.ndarray, np.ndarray] | None = None):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if any(bytes([b]) not in self.ranks for b in range(256)) or max(self.ranks.values()) >= _PAD:
            raise ValueError("a rank file needs all single bytes and ranks below 2^20 - 1")
        first, kind = classes or character_classes()
        self.kind = np.repeat(kind, np.diff(np.append(first, 0x110000)))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            size[rank] = len(token)
        self.known_id = size > 0
        self.token_first, self.token_size = np.cumsum(size) - size, size
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])), np.uint8)
        pairs = {(self.ranks[t[:k]] << 20) | self.ranks[t[k:]]: rank for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pairs = Table(1 << max(8, (4 * len(pairs)).bit_length()), [np.int64])
        self.pair_rank = np.full(self.pairs.mask + 1, _NO_RANK, np.int32)
        self.pair_rank[self.pairs.add([np.fromiter(pairs, np.int64, len(pairs))])] = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.by_pair = pairs
        self._forget()

    # cutting

    def _classes(self, buf: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        kind = self.kind[:256][buf & 0x7F]  # right for ASCII
        lead = np.flatnonzero(buf >= 0xC0)
        if len(lead):
            padded = np.append(buf, np.zeros(3, np.uint8)).astype(np.int32)
            b, c, d, e = (padded[lead + k] for k in range(4))
            two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
            code = np.where(two, (b & 0x1F) << 6 | c & 0x3F, np.where(three, (b & 0xF) << 12 | (c & 0x3F) << 6 | d & 0x3F, (b & 7) << 18 | (c & 0x3F) << 12 | (d & 0x3F) << 6 | e & 0x3F))
            of = self.kind[code]
            kind[lead] = kind[lead + 1] = of
            long = np.flatnonzero(~two)
            kind[lead[long] + 2] = of[long]
            long = np.flatnonzero(b >= 0xF0)
            kind[lead[long] + 3] = of[long]
        return kind

    def pieces(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the matches of the pattern begin, in a buffer of valid UTF-8 with text offsets ``off``."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64)
        kind = self._classes(buf)
        text_start = np.zeros(n + 1, bool)
        text_start[off] = True
        run = text_start[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        blank_before = np.zeros(n, bool)  # a blank that joins what follows it
        blank_before[1:] = buf[:-1] == 0x20
        blank_before &= ~text_start[:n]
        space = kind == _SPACE
        begins = run & (space | ~blank_before)
        # the last character of white space before something else stands alone, or goes with it if it is a blank
        after = np.flatnonzero(run & ~space & ~text_start[:n])
        last = after[space[after - 1]] - 1
        while len(back := np.flatnonzero((buf[last] & 0xC0) == 0x80)):
            last[back] -= 1
        begins[last] = True
        # contractions
        mark = np.flatnonzero((buf == 0x27) & run & ~blank_before)
        mark = mark[mark + 1 < n]
        mark = mark[~text_start[mark + 1]]
        if len(mark):
            wide = np.append(buf, np.zeros(2, np.uint8))
            x, y = wide[mark + 1], np.where(text_start[np.minimum(mark + 2, n)], 0, wide[mark + 2])
            short = np.isin(x, np.frombuffer(b"stmd", np.uint8))
            long = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
            hit = mark[short | long]
            end = hit + np.where(short, 2, 3)[short | long]
            begins[hit + 1] = False
            begins[end[end < n]] = True
        return np.flatnonzero(begins)

    # merging

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pair_rank[self.pairs.find([(a.astype(np.int64) << 20) | b])]

    def merge(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids, padded at the end -> merged rows, padded at the end, and their sizes."""
        out, out_size = np.full_like(ids, _PAD), size.copy()
        row = np.arange(len(ids))
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            k = np.arange(len(row))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[k, at] if rank.shape[1] else np.full(len(row), _NO_RANK)
            if (done := least == _NO_RANK).any():
                out[row[done], : ids.shape[1]] = ids[done]
                row, ids, rank, at, least = row[~done], ids[~done], rank[~done], at[~done], least[~done]
                k = np.arange(len(row))
                if not len(row):
                    break
            ids[k, at] = least  # a token's id is its rank
            behind = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            ids = np.where(behind, ids[:, 1:], ids[:, :-1])
            rank = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            out_size[row] -= 1
            for p in (at - 1, at):
                kk = np.flatnonzero((p >= 0) & (p < rank.shape[1]))
                rank[kk, p[kk]] = self._rank(ids[kk, p[kk]], ids[kk, p[kk] + 1])
        return out, out_size

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same rule for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, of = len(ids), self.by_pair
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := of.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j < 0 or of.get(ids[i] << 20 | ids[j]) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j] = r, -1
            nxt[i] = j = nxt[j]
            if j >= 0:
                prev[j] = i
                if (s := of.get(r << 20 | ids[j])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := prev[i]) >= 0 and (s := of.get(ids[h] << 20 | r)) is not None:
                heapq.heappush(heap, (s, h))
        return np.array([i for i in ids if i >= 0], np.int32)

    # known pieces

    def _forget(self) -> None:
        """Back to the tokens themselves as the only known pieces."""
        self.known = Table(_PLACES, [U, U, np.uint8])
        self.at_first, self.at_count = np.zeros(_PLACES, np.int64), np.zeros(_PLACES, np.int32)
        self.pool, self.held, self.long = np.zeros(1 << 20, np.int32), 0, {}
        short = {t: r for t, r in self.ranks.items() if len(t) <= 16}
        self._remember(self._keys([t.ljust(16, b"\0") for t in short], np.array([len(t) for t in short])), np.fromiter(short.values(), np.int32), np.ones(len(short), np.int32))

    @staticmethod
    def _keys(padded: list[bytes], size: np.ndarray) -> list[np.ndarray]:
        words = np.frombuffer(b"".join(padded), "<u8").reshape(-1, 2)
        return [words[:, 0], words[:, 1], size.astype(np.uint8)]

    def _store(self, ids: np.ndarray) -> int:
        if self.held + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        return self.held - len(ids)

    def _remember(self, keys: list[np.ndarray], ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        at = self.known.add(keys)
        self.at_first[at] = self._store(ids) + np.cumsum(count) - count
        self.at_count[at] = count
        return at

    def _merged(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most LONGEST bytes, in a row, and how many each has: a padded matrix per bucket of sizes."""
        count = np.ones(len(start), np.int32)
        rows: list[np.ndarray] = [np.zeros(0, np.int32)] * len(start)
        padded = np.append(buf, np.zeros(LONGEST, np.uint8))
        bucket = np.ceil(np.log2(size)).astype(int)
        for b in np.unique(bucket).tolist():
            mine = np.flatnonzero(bucket == b)
            width = int(size[mine].max())
            step = max(1, (1 << 21) // width)
            for lo in range(0, len(mine), step):
                part = mine[lo : lo + step]
                ids = self.single[padded[start[part][:, None] + np.arange(width)]]
                ids[np.arange(width)[None, :] >= size[part][:, None]] = _PAD
                ids, n = self.merge(ids, size[part])
                count[part] = n
                for k, row, m in zip(part.tolist(), ids, n.tolist(), strict=True):
                    rows[k] = row[:m]
        return np.concatenate([np.zeros(0, np.int32), *rows]), count

    def _look_up(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece its first place in the pool of ids and the number of ids."""
        if self.known.entries > _PLACES // 4 or self.held > 1 << 24 or len(self.long) > 1 << 17:
            self._forget()
        first, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        data = np.append(buf, np.zeros(16, np.uint8))
        word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        # at most an eighth of the places at a time, so the table never fills up
        short = np.flatnonzero(size <= 16)
        for lo in range(0, len(short), _PLACES // 8):
            s = short[lo : lo + _PLACES // 8]
            if self.known.entries > _PLACES // 4:
                pool = self.pool[: self.held]  # places handed out so far stay
                self._forget()
                shift = len(pool)
                self.pool = np.concatenate([pool, self.pool])
                self.at_first += shift
                self.held += shift
            keys = [word[start[s]] & _KEEP[np.minimum(size[s], 8)], word[start[s] + 8] & _KEEP[np.maximum(size[s] - 8, 0)], size[s].astype(np.uint8)]
            at = self.known.find(keys)
            new = np.flatnonzero(~self.known.taken[at])
            if len(new):
                order = new[np.lexsort([k[new] for k in keys])]
                differs = np.append(True, np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys]))
                one = order[differs]
                ids, n = self._merged(buf, start[s[one]], size[s[one]])
                place = self._remember([k[one] for k in keys], ids, n)
                at[order] = place[np.cumsum(differs) - 1]
            first[s], count[s] = self.at_first[at], self.at_count[at]
        rest = np.flatnonzero(size > 16)
        if len(rest):
            whole = buf.tobytes()
            spans = [whole[a : a + n] for a, n in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]
            fresh = {w: k for w, k in zip(spans, rest.tolist(), strict=True) if w not in self.long}
            here = {}
            bucketed = np.array([k for w, k in fresh.items() if len(w) <= LONGEST and w not in self.ranks], np.int64)
            if len(bucketed):
                ids, n = self._merged(buf, start[bucketed], size[bucketed])
                begin = self._store(ids) + np.cumsum(n) - n
                here = {whole[a : a + m]: (b, c) for a, m, b, c in zip(start[bucketed].tolist(), size[bucketed].tolist(), begin.tolist(), n.tolist(), strict=True)}
            for w in fresh:
                if w not in here:
                    ids = np.array([self.ranks[w]], np.int32) if w in self.ranks else self.merge_long(w)
                    here[w] = (self._store(ids), len(ids))
            self.long |= {w: v for w, v in here.items() if len(w) <= LONGEST}
            first[rest], count[rest] = np.array([here.get(w) or self.long[w] for w in spans]).T
        return first, count

    # whole texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the first id of each text (one more than texts)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        try:
            buf.tobytes().decode()
            whole_characters = not len(buf) or not (buf[off[off < len(buf)]] & 0xC0 == 0x80).any()
        except UnicodeDecodeError:
            whole_characters = False
        if not whole_characters:
            spans = [buf[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(off, off[1:], strict=False)]
            off = np.append(0, np.cumsum([len(s) for s in spans]))
            buf = np.frombuffer(b"".join(spans), np.uint8)
        if len(buf) <= BLOCK:
            return self._encode(buf, off)
        edges, parts, firsts, held = self._block_edges(buf), [], [], 0
        for a, b in zip(edges, edges[1:], strict=False):
            inside = off[(off > a) & (off < b)]
            ids, first = self._encode(buf[a:b], np.concatenate([[0], inside - a, [b - a]]))
            here = np.searchsorted(np.concatenate([[a], inside]), off[(off >= a) & (off < b)])
            parts.append(ids)
            firsts.append(first[here] + held)
            held += len(ids)
        return np.concatenate(parts), np.concatenate([*firsts, np.full(int((off == len(buf)).sum()), held)])

    @staticmethod
    def _block_edges(buf: np.ndarray) -> list[int]:
        """0, blanks between ASCII letters about ``BLOCK`` apart, the end."""
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        edges, at, n = [0], BLOCK, len(buf)
        while at < n - 1:
            near = buf[at - 1 : at + KERNEL_BYTES + 1]
            good = np.flatnonzero((near[1:-1] == 0x20) & letter[near[:-2]] & letter[near[2:]])
            if len(good):
                edges.append(at + int(good[0]))
                at = edges[-1] + BLOCK
            else:
                at += KERNEL_BYTES
        return [*edges, n]

    def _encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.pieces(buf, off)
        first, count = self._look_up(buf, start, np.diff(np.append(start, len(buf))))
        index, ends = ragged(first, count)
        return self.pool[index], ends[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and where each id's begin (one more than ids)."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known_id) and self.known_id[ids].all()):
            raise ValueError("an id is not in the rank file")
        index, ends = ragged(self.token_first[ids], self.token_size[ids])
        return self.token_bytes[index], ends


def _path(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""
    classes = character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(_path(ranks_path), classes)
        for b in text_batches(batches):
            ids, first = bpe.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(first.astype(np.int32), ids)], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Rows of ``encode`` with the bytes that their ids stand for (null where ``ids`` is null)."""
    classes = character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(_path(ranks_path), classes)
        for b in batches:
            at = lo = 0
            off = b.column(1).offsets.to_numpy()
            while lo < len(b):  # runs of rows with some KERNEL_BYTES of ids, or one row
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + KERNEL_BYTES // 4, "right")) - 1)
                part = b.slice(lo, hi - lo)
                data, ends = bpe.decode(part.column(1).flatten().to_numpy())
                sizes = np.diff(off[lo : hi + 1])
                at = ends[np.append(0, np.cumsum(np.where(part.column(1).is_valid().to_numpy(zero_copy_only=False), sizes, 0)))]
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
                if part.column(1).null_count:
                    import pyarrow.compute as pc

                    decoded = pc.if_else(part.column(1).is_valid(), decoded, pa.scalar(None, pa.large_binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), decoded.cast(pa.binary())], ["doc_id", "ids", "decoded"])
                lo = hi

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
