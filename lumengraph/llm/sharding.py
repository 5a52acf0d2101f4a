"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Each shard owns ``vnodes`` points on a 32-bit ring. A row's key is its text, so equal texts meet; it
belongs to the first point clockwise of the key's hash. Shards hold a bounded number of rows; rows that
overflow a full shard go on clockwise to the next shard with room. With ``slack`` 0 the bounds are
exactly even (row counts differ by at most one); with ``slack`` e a shard holds at most
ceil((1 + e) * rows / shards), and fewer rows move when a shard is added.

How: count rows by (arc, cell), at most shards * vnodes * ``cells`` counts; spill arc by arc on the
driver over those bounded counts; rank rows within their cell by a window; look the rank up in the
arc's spill list. The cell is a hash of the row's identity, so an arc that a third of all rows share
is ranked by ``cells`` tasks. The text itself is never shuffled.

Defined results: a null text is a key of its own (size 1, checksum 0); a null doc_id is hashed like a
value; rows that repeat a doc_id and text are told apart only by their rank; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text

RING = 1 << 32


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node, in ring order; a shard's points don't depend on the others."""
    point = lambda s, v: zlib.crc32(f"shard {s} point {v} {zlib.crc32(f'{v}/{s}'.encode())}".encode())
    return sorted((point(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-(1 + slack) * rows // shards)] * shards


def spill(counts: list[int], owners: list[int], caps: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc (shard, rows, first slot) in rank order: its own shard as far as there is room, then clockwise.

    All arcs first fill their own shards, in ring order; then what is left moves on.
    """
    room, used = list(caps), [0] * len(caps)
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    left = list(counts)

    def put(arc: int, shard: int) -> None:
        n = min(left[arc], room[shard])
        if n:
            out[arc].append((shard, n, used[shard]))
            left[arc] -= n
            room[shard] -= n
            used[shard] += n

    for arc, shard in enumerate(owners):
        put(arc, shard)
    for arc in range(len(counts)):
        step = 1
        while left[arc]:
            put(arc, owners[(arc + step) % len(owners)])
            step += 1
    return out


def assign(docs: DataFrame, shards: int = 8, vnodes: int = 64, slack: float = 0.0, cells: int = 64) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    points = ring_points(shards, vnodes)
    owners = [s for _, s in points]
    text = F.coalesce("text", F.lit(""))
    rows = id_text(docs).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("text", F.isnull("text")), F.lit(RING)).alias("at"),
    )
    bounds = F.array(*[F.lit(p).cast("long") for p, _ in points])
    # the number of points before the key: its arc; the last arc wraps round to the first point
    arc = F.pmod(_points_before(bounds, F.col("at"), len(points)), F.lit(len(points)))
    rows = rows.withColumn("arc", arc.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "at", F.lit(7)), F.lit(cells)).cast("int"))
    counted = {(r["arc"], r["cell"]): r["n"] for r in rows.groupBy("arc", "cell").agg(F.count("*").alias("n")).collect()}
    per_arc = [sum(counted.get((a, c), 0) for c in range(cells)) for a in range(len(points))]
    plan = spill(per_arc, owners, capacities(sum(per_arc), shards, slack))
    firsts, parts = {}, {}
    for a, pieces in enumerate(plan):
        at = 0
        for c in range(cells):
            if (n := counted.get((a, c))) is not None:
                firsts[a, c] = at
                at += n
        at = 0
        for shard, n, slot in pieces:
            parts.setdefault(a, []).append({"from": at, "shard": shard, "slot": slot})
            at += n
    lookup = [{"arc": a, "cell": c, "first": first, "parts": parts[a]} for (a, c), first in firsts.items()]
    spark = docs.sparkSession
    schema = "array<struct<arc int, cell int, first long, parts array<struct<`from` long, shard int, slot long>>>>"
    plan_df = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(lookup)), schema)))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("arc", "cell").orderBy("at", "doc_id", "text_crc32")) - 1)
    placed = ranked.join(F.broadcast(plan_df), ["arc", "cell"])
    rank = F.col("first") + F.col("r")
    part = F.element_at(F.filter("parts", lambda p: p["from"] <= rank), -1)
    return placed.select("doc_id", "size", "text_crc32", part["shard"].alias("shard"), (part["slot"] + rank - part["from"]).alias("slot"))


def _points_before(bounds, at, n: int):
    """How many of the n sorted bounds lie before ``at``: a binary search as a fold over the step sizes."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])

    def onward(lo, step):
        probe = lo + step
        return F.when((probe <= n) & (F.get(bounds, probe - 1) < at), probe).otherwise(lo)

    return F.aggregate(steps, F.lit(0), onward)
