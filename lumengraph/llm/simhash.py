"""SimHash near-duplicate groups by tiled exact comparison.

``fingerprints``   one 64-bit SimHash per document over word shingles (XXH64, majority of bits).
``link_forest``    every pair of distinct fingerprints within the radius, reduced to spanning forests:
                   fingerprints are tiled by the population counts of their four 16-bit quarters; the
                   Hamming distance of two fingerprints is at least the L1 distance of those counts, so
                   only tile pairs within the radius are compared (numpy exclusive-or and bit counts).
``components``     smallest reachable member by alternating large-star and small-star rounds, each
                   written to the shared checkpoint folder.
``near_duplicates`` the three together; one row per input row.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a null doc_id
keeps its row and never is a component's id unless the component holds no other (then null); repeated
rows each keep a row; an empty table gives an empty result; other columns of the input are not read.

Cost: linear in the text up to the fingerprints; quadratic in distinct fingerprints within a tile
neighbourhood (about 5 % of all pairs for evenly spread bits). No candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, join_hot, text_batches
from .textbytes import NOT_SPACE, U, Words, buffers, xxh64_spans

_LANES = U(0x0101010101010101)


def simhash_batch(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (unsigned) of a batch of texts."""
    buf, off = buffers(texts)
    raw, edge = buf.tobytes(), off.tolist()
    joined = [b" ".join(raw[a:b].split()) for a, b in zip(edge, edge[1:], strict=False)]
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    flat = np.frombuffer(b" ".join(joined) if joined else b"", np.uint8)
    offs = np.zeros(len(joined) + 1, np.int64)
    np.cumsum(lengths + 1, out=offs[1:])
    offs[-1] = max(offs[-1] - 1, 0)
    w = Words(flat, offs, NOT_SPACE)
    n_shingles = np.where(w.counts == 0, 0, np.maximum(w.counts - shingle + 1, 1))
    doc_first = np.zeros(len(joined) + 1, np.int64)
    np.cumsum(n_shingles, out=doc_first[1:])
    total = int(doc_first[-1])
    out = np.zeros(len(joined), U)
    if not total:
        return out
    head = np.repeat(w.first[:-1] - doc_first[:-1], n_shingles) + np.arange(total)
    tail = np.minimum(head + shingle, np.repeat(w.first[1:], n_shingles)) - 1
    return majority(xxh64_spans(flat, w.start[head], w.end[tail], seed), doc_first)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document (hashes first[d] to first[d+1]): the bits that are set in over half of its hashes.

    Eight bit counters ride in the bytes of one word; runs of at most 255 hashes are summed so, then
    added up per document.
    """
    n = np.diff(first)
    out = np.zeros(len(n), U)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    n_runs = -(-n[full] // 255)
    run_doc = np.repeat(np.arange(len(full)), n_runs)
    run_first = np.zeros(len(full) + 1, np.int64)
    np.cumsum(n_runs, out=run_first[1:])
    begin = first[full][run_doc] + 255 * (np.arange(len(run_doc)) - run_first[run_doc])
    for j in range(8):
        sums = np.add.reduceat((hashes >> U(j)) & _LANES, begin)
        per_byte = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(per_byte, run_first[:-1], axis=0)
        on = (2 * counts > n[full][:, None]).astype(U)
        for b in range(8):
            out[full] |= on[:, b] << U(8 * b + j)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fp): fp is the signed long with the fingerprint's bits, mark a hash of the text as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            fp = simhash_batch(b.column(1), shingle, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "mark", "fp"])

    return id_text(docs).withColumn("mark", _mark("text")).mapInArrow(run, "doc_id long, mark long, fp long")


def _mark(text: str):
    return F.xxhash64(F.col(f"`{text}`"), F.isnull(F.col(f"`{text}`")))


def _neighbour_steps(radius: int, parts: int = 4) -> list[tuple[int, ...]]:
    """Steps between tile coordinates, one of each opposite pair, whose L1 length is within the radius."""
    zero = (0,) * parts
    return [s for s in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius and s >= zero]


def _quarter_counts(fp):
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes, the smallest node it reaches over edges a-b (numpy hooking and jumping)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(j := new[new], new):
            new = j
        if np.array_equal(new, label):
            return label
        label = new


def compare_blocks(x: np.ndarray, y: np.ndarray, radius: int, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest edges (as values) of all pairs of x and y that differ in at most ``radius`` bits."""
    rows = max(1, step // max(len(y), 1))
    n = len(x)
    label = np.arange(n + len(y))
    for lo in range(0, n, rows):
        i, j = np.nonzero(np.bitwise_count(x[lo : lo + rows, None] ^ y[None, :]) <= radius)
        if len(i):
            label = _join(label, i + lo, j + n)
    values = np.concatenate([x, y])
    root = values[label]
    moved = root != values
    return values[moved], root[moved]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the groups that edges i-j connect; ``label`` names each node's group by a member."""
    reached = forest(label[i], label[j], len(label))
    return reached[label]


def link_forest(nodes: DataFrame, radius: int = 3, block: int = 4096) -> DataFrame:
    """Edges (a, b) of fingerprints: a spanning forest for each compared tile pair; ``nodes`` has distinct fp."""
    fp = F.col("fp")
    tiled = nodes.select("fp", F.array(*[c.cast("int") for c in _quarter_counts(fp)]).alias("at"))
    code = lambda at: sum((at[q] * (32**q) for q in range(4)), F.lit(0))
    tiled = tiled.select("fp", code(F.col("at")).alias("tile"))
    # at most 17^4 rows, whatever the input: a tile's number of blocks
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    blocks = (
        tiled.join(F.broadcast(sizes), "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
        .agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    )
    blocks = cut(blocks)
    codes = F.array(*[F.struct(*[F.lit(v).alias(f"s{q}") for q, v in enumerate(s)]) for s in _neighbour_steps(radius)])
    coords = [F.pmod(F.floor(F.col("tile") / 32**q), F.lit(32)).cast("int") for q in range(4)]
    left = blocks.withColumn("step", F.explode(codes))
    moved = [coords[q] + F.col(f"step.s{q}") for q in range(4)]
    inside = moved[0].between(0, 16)
    for m in moved[1:]:
        inside = inside & m.between(0, 16)
    left = left.where(inside).select(
        F.col("tile").alias("a_tile"), F.col("block").alias("a_block"), F.col("fps").alias("a"),
        sum((moved[q] * (32**q) for q in range(4)), F.lit(0)).alias("tile"),
    )
    # one key for each pair of blocks: a tile of many blocks is many keys
    left = left.join(F.broadcast(sizes), "tile").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.where((F.col("a_tile") != F.col("tile")) | (F.col("a_block") <= F.col("block"))).select("tile", "block", "a")
    pairs = left.join(blocks.select("tile", "block", F.col("fps").alias("b")), ["tile", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ca, cb = rb.column(0), rb.column(1)
            oa, ob = ca.offsets.to_numpy(), cb.offsets.to_numpy()
            va, vb = ca.values.to_numpy().view(U), cb.values.to_numpy().view(U)
            heads, roots = [], []
            for k in range(rb.num_rows):
                h, r = compare_blocks(va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]], radius)
                if len(h):
                    heads.append(h)
                    roots.append(r)
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (heads, roots)], names=["a", "b"])

    return pairs.select("a", "b").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node it reaches.

    Large-star and small-star rounds keep the components and end in stars; each round aggregates a
    minimum per node and joins it back, so no neighbour list is ever gathered. Rounds go on until one
    changes nothing; their number grows with the logarithm of the graph.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _groups(docs: DataFrame, radius: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints by row; nodes (fp, low, n, root); the first row of each group (root, first, rows of nodes).

    A row is known by (no id, doc_id, text hash): the first row of a group has the smallest id, rows without ids come last.
    """
    fps = cut(fingerprints(docs, shingle, seed))
    row = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "mark")
    nodes = cut(fps.groupBy("fp").agg(F.min(row).alias("low"), F.count("*").alias("n")))
    stars = components(link_forest(nodes.select("fp"), radius))
    rooted = cut(nodes.join(stars, nodes["fp"] == stars["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    return fps, rooted, rooted.groupBy("root").agg(F.min("low").alias("first"), F.count("*").alias("nodes"))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest doc_id of its component)."""
    fps, rooted, groups = _groups(docs, radius, shingle, seed)
    n_rows, n_nodes = fps.count(), rooted.count()
    member = join_hot(rooted, groups.select("root", F.col("first.doc_id").alias("component_id"), "nodes"), "root", "nodes", n_nodes)
    return join_hot(fps, member.select("fp", "component_id", "n"), "fp", "n", n_rows).select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: of the smallest doc_id, without one only if none has any.

    Rows that repeat both doc_id and text are one row (any of them). They are merged before the shuffle, so a text that a third
    of all rows repeats is one row per task.
    """
    _, _, groups = _groups(docs, radius, 3, 42)
    first = groups.select(F.col("first.doc_id").alias("__id"), F.col("first.mark").alias("__mark"))
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), _mark("text").alias("__mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    one = rows.groupBy("__id", "__mark").agg(F.first("__row").alias("__row"))
    kept = one.join(first, one["__id"].eqNullSafe(first["__id"]) & (one["__mark"] == first["__mark"]), "left_semi")
    return kept.select("__row.*")
