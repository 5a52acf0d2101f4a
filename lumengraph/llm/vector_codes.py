"""Product codes of vectors by integer codebooks, assigned by partial-distance search.

A component x becomes the integer floor(256 * x). Vectors are cut into equal consecutive parts, and each part
position has a codebook of its own, which starts as that part of the vectors of the smallest ids. A round gives
every part to its nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to the
floor of the mean of its parts; an entry without parts stays.

Nearest entries are found by partial distances: dimensions are taken in descending order of their variance over
the codebook. The first one is added up for all entries, and the entry that leads there gives a first complete
distance. After each dimension a mask drops the pairs of part and entry whose sum so far is strictly above the best
complete distance known for that part; pairs at exactly that distance stay, so ties are decided among all of them. With
every dimension added, what stays is complete.

Rows meet only as sums: a round shuffles at most entries x parts rows per task, and the codebooks are the only
thing that passes through the driver (64 entries of 64 components by default, whatever the input).

Defined results: a vector that is null or has null or non-finite components is left out, and so is one whose
length differs from that of the kept vector of the smallest id (or from ``dims``). That length must be a positive
multiple of the number of parts; an empty vector is left out. Null ids come after all others, vectors of equal id are
ordered by their components; repeated rows are rows of their own; fewer vectors than entries make smaller codebooks;
no vectors give no rows. Integers must stay below 2^27 in size, so that all sums fit; beyond, the job fails and says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_hot

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that one call of the kernel works on.
ROWS = 4096
_BOUND = 1 << 27


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts (rows x dimensions) and a codebook (entries x dimensions), integers -> index and distance of each part's nearest entry."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    parts, book = parts[:, order], book[:, order]
    rows, entries = len(parts), len(book)
    partial = (parts[:, :1] - book[None, :, 0]) ** 2
    lead = partial.argmin(1)
    best = ((parts - book[lead]) ** 2).sum(1)
    row, entry = np.nonzero(partial <= best[:, None])
    held = partial[row, entry]
    for d in range(1, book.shape[1]):
        held = held + (parts[row, d] - book[entry, d]) ** 2
        stays = held <= best[row]
        if d < book.shape[1] - 1 and not stays.all():
            row, entry, held = row[stays], entry[stays], held[stays]
            # the pair that leads now may have a better complete distance
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.minimum.reduceat(held, first)
            ahead = np.flatnonzero(held == np.repeat(least, np.diff(np.append(first, len(row)))))
            complete = ((parts[row[ahead]] - book[entry[ahead]]) ** 2).sum(1)
            np.minimum.at(best, row[ahead], complete)
            stays = held <= best[row]
        row, entry, held = row[stays], entry[stays], held[stays]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if rows else np.zeros(0, np.int64)
    distance = np.minimum.reduceat(held, first) if rows else np.zeros(0, np.int64)
    entry = np.where(held == np.repeat(distance, np.diff(np.append(first, len(row)))), entry, entries)
    return (np.minimum.reduceat(entry, first) if rows else np.zeros(0, np.int64)), distance


def integers(vectors: pa.ListArray, dims: int, scale: int = SCALE) -> np.ndarray:
    """Vectors of ``dims`` finite components as integers, rows x dims."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dims)
    if x.size and np.abs(x).max() >= _BOUND:
        raise ValueError(f"a component is {_BOUND // scale} or more in size")
    return x.astype(np.int64)


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector isn't null or empty and holds finite components only."""
    finite = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(f"`{vector_col}`").isNotNull() & (F.size(F.col(f"`{vector_col}`")) > 0) & F.coalesce(finite, F.lit(False)))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), ROWS):
            yield b.slice(lo, ROWS)


class Codebooks:
    """Integer codebooks, ``books`` (parts x entries x components of a part); fitted on all vectors."""

    def __init__(self, books: np.ndarray, scale: int = SCALE):
        self.books, self.scale = books, scale
        self.dims = books.shape[0] * books.shape[2]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Integer vectors -> codes (rows x parts) and squared distances (rows x parts)."""
        found = [nearest(part, book) for part, book in zip(np.split(x, len(self.books), axis=1), self.books, strict=True)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def components(self) -> Iterator[int]:
        """All components by part, entry and position in the part."""
        return map(int, self.books.ravel())


def _vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int | None = None) -> DataFrame:
    kept = usable(vectors, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return kept.where(F.size("v") == dims) if dims else kept


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dims: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all kept vectors; None if there are none."""
    rows = _vectors(vectors, id_col, vector_col)
    by_id = (F.col("vec_id").asc_nulls_last(), "v")
    if dims is None:
        if not (head := rows.orderBy(*by_id).limit(1).select(F.size("v")).collect()):
            return None
        dims = head[0][0]
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == dims)
    start = rows.orderBy(*by_id).limit(entries).toArrow()
    if not len(start):
        return None
    x = integers(start.column("v").combine_chunks(), dims, scale)
    books = Codebooks(x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy(), scale)
    for _ in range(rounds):
        books = _round(rows, books)
    return books


def _round(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Entries moved to the floored means of their parts: each task sums its rows, then the sums are added up."""
    parts, entries, width = books.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in _batches(batches):
            x = integers(b.column(0), books.dims, books.scale)
            codes, _ = books.assign(x)
            slot = (codes + np.arange(parts) * entries).ravel()
            order = np.argsort(slot, kind="stable")
            seen, first = np.unique(slot[order], return_index=True)
            total[seen] += np.add.reduceat(x.reshape(-1, width)[order], first)
            count += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))], ["slot", "position", "total", "count"])

    sums = rows.select("v").mapInArrow(run, "slot long, position long, total long, count long").groupBy("slot", "position").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    moved = books.books.copy().reshape(-1, width)
    for slot, position, total, count in sums.collect():  # at most parts x entries x width rows
        moved[slot, position] = total // count
    return Codebooks(moved.reshape(books.books.shape), books.scale)


def encode(vectors: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id",), vector_col: str = "embedding") -> DataFrame:
    """The kept rows: row (a struct of the columns ``keep``), code (binary, a byte per part), error (summed squared distances)."""
    rows = usable(vectors, vector_col).where(F.size(F.col(f"`{vector_col}`")) == books.dims)
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            codes, error = books.assign(integers(b.column(1), books.dims, books.scale))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(error.sum(1))], ["row", "code", "error"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]))


def label_errors(coded: DataFrame, label: str, error: str, out: str) -> DataFrame:
    """``coded`` with the error summed over equal labels (nulls together): summed in each task first, labels of many rows sent to all tasks."""
    key = F.when(F.col(label).isNull(), "").otherwise(F.concat(F.lit("="), F.col(label).cast("string")))
    rows = coded.withColumn("__key", key)
    sums = cut(rows.groupBy("__key").agg(F.sum(error).alias(out), F.count("*").alias("__rows")))
    total = sums.agg(F.sum("__rows")).first()[0] or 0
    return join_hot(rows, sums, "__key", "__rows", total).drop("__key")
