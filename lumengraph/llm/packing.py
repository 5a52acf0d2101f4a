"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents are one token stream in doc_id order. A window is a run of the stream of at most ``window``
tokens; cuts are allowed after a document (free), after a sentence (``sentence_cost``) and, inside a
sentence longer than ``stride`` tokens, after every ``stride`` tokens (``hard_cost``). The cost of a
packing is its padding plus its cut costs, in tokens; padding is window * windows - tokens, so

    best(j) = cost(j) + window + min of best(i) over cuts i with j - window <= i < j

and a monotone queue gives the minimum of the sliding range in amortised constant time per cut.

Tokens: a public tokenizer file (``bpe``); each document's ids, then ``end_id``.

The stream is cut into range partitions by (doc_id, hash of the text); each is packed by itself, so a
partition adds at most one part-filled window, and memory is bounded by ``SPAN`` tokens: a partition
is packed in spans of whole documents of about that many tokens.

Defined results: a null text is an empty document (one token, ``end_id``); null doc_ids come first;
repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe
from .common import id_text, text_batches

WINDOW, SENTENCE_COST, HARD_COST, STRIDE = 2048, 8, 32, 256
SPAN = 1 << 21


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, stride: int, sentence_cost: float, hard_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts (token positions, rising, from 0 to len(ids)) and the cost of each."""
    cost = np.full(len(ids) + 1, np.inf)
    cost[np.flatnonzero(ends_sentence[ids]) + 1] = sentence_cost
    cost[doc_ends] = 0
    cost[0] = cost[-1] = 0
    at = np.flatnonzero(np.isfinite(cost))
    gaps = np.diff(at)
    for k in np.flatnonzero(gaps > stride):
        cost[at[k] + stride : at[k + 1] : stride] = hard_cost
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """Indices into ``at`` of the cuts of a cheapest packing, first and last included.

    Among equals the earlier cut is taken, so windows that end a span are the long ones.
    """
    pos, extra = at.tolist(), cost.tolist()
    best, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque[int] = deque([0])
    for j in range(1, len(pos)):
        low = pos[j] - window
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        b = best[j] = best[i] + window + extra[j]
        back[j] = i
        while queue and best[queue[-1]] > b:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return [0, *reversed(cuts)]


def pack_span(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, window: int = WINDOW, sentence_cost: float = SENTENCE_COST, hard_cost: float = HARD_COST, stride: int = STRIDE) -> tuple[np.ndarray, ...]:
    """Pieces of a span of documents (their ids in a row, and where each ends): document index, start in
    it, length, window index, offset in the window."""
    sizes = np.diff(ends, prepend=0)
    at, cost = cut_points(ids, ends, ends_sentence, min(stride, window), sentence_cost, hard_cost)
    edges = at[best_cuts(at, cost, window)]
    begin = np.union1d(edges[:-1], ends[:-1])
    length = np.diff(np.append(begin, len(ids)))
    doc = np.searchsorted(ends, begin, "right")
    seq = np.searchsorted(edges, begin, "right") - 1
    return doc, begin - (ends - sizes)[doc], length, seq, begin - edges[seq]


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = 1, partitions: int | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``with_ids`` a last column ``ids`` holds the piece's tokens (array of int).
    """
    rows = id_text(docs)
    key = F.xxhash64("text")
    ranged = rows.repartitionByRange(partitions, "doc_id", key) if partitions else rows.repartitionByRange("doc_id", key)
    return ranged.sortWithinPartitions("doc_id", key).mapInArrow(
        _packer(tokenizer_path, window, end_id, with_ids),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids,
    )


def _packer(path: str | None, window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        tok = Bpe(path or public_tokenizers.path("word_bpe_49k.json"))
        sequence = TaskContext.get().partitionId() << 32
        names: list[pa.Array] = []
        coded: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            ids, total = np.concatenate(coded), np.concatenate(sizes)
            doc, start, length, seq, offset = pack_span(ids, np.cumsum(total), tok.ends_sentence, window)
            first = np.cumsum(length) - length
            whole = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            columns = {"doc_id": pa.chunked_array(names).combine_chunks().take(pa.array(doc)), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": total[doc], "sequence_id": seq + sequence, "offset": offset}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(np.append(0, np.cumsum(length)).astype(np.int32), ids.astype(np.int32))
            sequence += int(seq[-1]) + 1
            for gathered in (names, coded, sizes):
                gathered.clear()
            held = 0
            return pa.RecordBatch.from_pydict(columns)

        for b in text_batches(batches):
            ids, first = tok.encode(b.column(1))
            coded.append(np.insert(ids, first[1:], end_id))
            sizes.append(np.diff(first) + 1)
            names.append(b.column(0))
            held += len(coded[-1])
            if held >= SPAN:
                yield flush()
        if held:
            yield flush()

    return run
