"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words, but not none, is
one window). Document side: the hash of every ``kgram`` words, of which each run of ``window - kgram
+ 1`` consecutive ones keeps its minimum; so every shared span of ``window`` words holds a kept
fingerprint. Benchmark side: all k-gram hashes. Kept fingerprints that the benchmark has are extended:
each window around them is looked up and compared word for word, and its words are hit. Items shorter
than ``window`` words are looked up by every window of their own length.

Words: ASCII letters in lower case, runs of letters, digits and characters beyond ASCII.

The benchmark goes to the executors in blocks of at most ``block_chars`` characters (a single longer
item is a block of its own), one pass over the documents for each block; hits of the blocks are
merged per document, so its size is bounded by no assumption.

Defined results: null or wordless documents have no words, no hits; null or wordless items have no
window; a null item_id still marks words but is not listed; an item_id that several rows share counts
once; repeated document rows each keep a row; empty tables give no rows or no hits; other columns
are not read (``clean_documents`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, text_batches
from .textbytes import ALNUM, U, Words, buffers, ngrams, within

WINDOW, KGRAM = 10, 6


class Block:
    """Lookup tables of one block of benchmark items: 20 bytes a window, whatever the items' number."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW, kgram: int = KGRAM):
        self.window, self.kgram = window, kgram
        self.ids = [None if i is None else str(i) for i, _ in items]
        w = self.words = Words(*buffers(pa.array([t for _, t in items], pa.large_string())), ALNUM)
        h = w.hashes()
        sizes = np.minimum(w.counts, window)
        item = w.doc()
        self.prints = np.unique(ngrams(h, kgram)[within(w.first, len(h), kgram) & (sizes[item] == window)[: max(len(h) - kgram + 1, 0)]])
        #: by window length: hashes, rising; where the windows of each start among all; their first words, and items
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(within(w.first, len(h), size) & (sizes[item] == size)[: max(len(h) - size + 1, 0)])
            g = ngrams(h, size)[at]
            order = np.argsort(g, kind="stable")
            g, at = g[order], at[order]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            self.windows[size] = g[first], np.append(first, len(g)), at.astype(np.int32), item[at].astype(np.int32)

    def starts(self, h: np.ndarray, w: Words, size: int) -> np.ndarray:
        """Word positions at which a window of ``size`` words may begin: a superset, found by hash."""
        hashes = self.windows[size][0]
        if size < self.window:
            g = ngrams(h, size)
            return np.flatnonzero(_among(g, hashes) & within(w.first, len(h), size))
        kept = winnow(h, w, self.window, self.kgram)
        kept = kept[_among(ngrams(h, self.kgram)[kept], self.prints)]
        reach = self.window - self.kgram
        begin = np.unique((kept[:, None] - np.arange(reach + 1)).ravel())
        n = len(h) - size + 1
        begin = begin[(begin >= 0) & (begin < n)]
        begin = begin[within(w.first, len(h), size)[begin]]
        g = _gather(h, begin, size)
        return begin[_among(g, hashes)]

    def hits(self, texts: pa.Array) -> tuple[Words, np.ndarray, dict[int, set]]:
        """Words of the batch, which of them are hit, and the item ids (as text) of each document by its index."""
        w = Words(*buffers(texts), ALNUM)
        hit = np.zeros(len(w) + 1, np.int64)
        items: dict[int, set] = {}
        h = w.hashes()
        for size, (hashes, first, start, item) in self.windows.items():
            at = self.starts(h, w, size)
            if not len(at):
                continue
            docs = np.searchsorted(w.first, at, "right") - 1
            place = np.searchsorted(hashes, _gather(h, at, size))
            good = np.zeros(len(at), bool)
            found: dict[int, set] = {}
            for k, (i, d, p) in enumerate(zip(at.tolist(), docs.tolist(), place.tolist(), strict=True)):
                # word for word; windows of one hash are equal but for a chance of n * n / 2^65 among n windows
                j = int(start[first[p]])
                if all(w.word(i + x) == self.words.word(j + x) for x in range(size)):
                    good[k] = True
                    found.setdefault(d, set()).add(p)
            for d, places in found.items():
                owners = np.unique(np.concatenate([item[first[p] : first[p + 1]] for p in places]))
                items.setdefault(d, set()).update(self.ids[o] for o in owners.tolist() if self.ids[o] is not None)
            np.add.at(hit, at[good], 1)
            np.add.at(hit, at[good] + size, -1)
        return w, np.cumsum(hit[:-1]) > 0, items


def _gather(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """ngrams(h, size)[at] without the rest."""
    wide = h[at[:, None] + np.arange(size)].ravel() if len(at) else np.zeros(0, U)
    return ngrams(wide, size)[::size]


def _among(g: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(g), bool)
    at = np.searchsorted(known, g)
    at[at == len(known)] = 0
    return known[at] == g


def winnow(h: np.ndarray, w: Words, window: int = WINDOW, kgram: int = KGRAM) -> np.ndarray:
    """Positions of the kept k-grams: the rightmost minimum of each run of window-kgram+1 k-grams in a document."""
    g = ngrams(h, kgram)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, arg = g[:n].copy(), np.zeros(n, np.int64)
    for s in range(1, window - kgram + 1):
        c = g[s : s + n]
        less = c <= best
        best = np.where(less, c, best)
        arg[less] = s
    keep = np.zeros(len(g), bool)
    ok = within(w.first, len(h), window)
    keep[(np.arange(n) + arg)[ok]] = True
    return np.flatnonzero(keep)


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The different items in bounded blocks, each fetched alone."""
    rows = id_text(benchmark, "item_id").where("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == i) if n > 1 else rows
        yield [(r[0], r[1]) for r in part.collect()]


_MARKS = "row long, hit binary, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, kgram: int = KGRAM, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, items array of item ids as text, sorted); one row per document row.

    One pass over the documents if the benchmark is one block. Else the documents are numbered and written once, each
    block has a job of its own that keeps the marks of documents with a hit, and a last pass joins them.
    """
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    pieces = blocks(benchmark, block_chars)
    first = next(pieces)
    following = next(pieces, None)
    if following is None:
        none = [F.lit(None).cast("array<binary>").alias("hits"), F.array().cast("array<string>").alias("items")]
        return rows.select("doc_id", "text", *none).mapInArrow(_final(Block(first, window, kgram)), "doc_id long, n_words long, n_hit long, items array<string>")
    rows, marks = cut(rows), None
    while first is not None:
        part = cut(rows.select("row", "text").mapInArrow(_marker(Block(first, window, kgram)), _MARKS))
        marks = part if marks is None else marks.unionByName(part)
        first, following = following, next(pieces, None) if following is not None else None
    merged = marks.groupBy("row").agg(F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.join(merged, "row", "left").select("doc_id", "text", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return joined.mapInArrow(_final(None), "doc_id long, n_words long, n_hit long, items array<string>")


def _marker(block: Block):
    """Marks of the documents with a hit: (row, text) -> row, a bit for each word, item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            w, hit, items = block.hits(b.column(1))
            docs = np.unique(w.doc()[hit]).tolist()
            bits = [np.packbits(hit[w.first[d] : w.first[d + 1]]).tobytes() for d in docs]
            lists = pa.array([sorted(items.get(d, ())) for d in docs], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(bits, pa.binary()), lists], names=["row", "hit", "items"])

    return run


def _final(block: Block | None):
    """(doc_id, text, hits of all blocks, items), or one block's own marks -> counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            if block is not None:
                w, hit, items = block.hits(b.column(1))
                sums = np.append(0, np.cumsum(hit))
                n_hit = sums[w.first[1:]] - sums[w.first[:-1]]
                lists = pa.array([sorted(items.get(d, ())) for d in range(b.num_rows)], pa.list_(pa.string()))
            else:
                w, lists = Words(*buffers(b.column(1)), ALNUM), b.column(3)
                n_hit = np.zeros(b.num_rows, np.int64)
                for d, parts in enumerate(b.column(2).to_pylist()):
                    if parts:
                        n_hit[d] = np.unpackbits(np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in parts]), count=int(w.counts[d])).sum()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), lists], names=["doc_id", "n_words", "n_hit", "items"])

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_chars: int = 8_000_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns; nothing is shuffled.

    Each further block of the benchmark has a job of its own, over the rows that the blocks before it kept, written to
    the shared folder.
    """
    at = docs.columns.index(text_col)
    out, waiting = docs, None
    for items in blocks(benchmark, block_chars):
        if waiting is not None:
            out = cut(out.mapInArrow(_dropper(Block(waiting), at), docs.schema))
        waiting = items
    return out.mapInArrow(_dropper(Block(waiting), at), docs.schema)


def _dropper(block: Block, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, at):
            w, hit, _ = block.hits(b.column(at))
            dirty = np.zeros(b.num_rows, bool)
            dirty[w.doc()[hit]] = True
            yield b.filter(pa.array(~dirty))

    return run
