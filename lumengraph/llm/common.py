"""Shared helpers of the training-data operators: shared folders, input columns, text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy kernel call works on; a longer single text gets a call of its own.
KERNEL_BYTES = 2 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session, whose executors are the driver, may go without: it gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, whatever else the input carries."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_slices(texts: pa.Array, limit: int = KERNEL_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs [lo, hi) whose texts hold at most ``limit`` bytes together, or one text."""
    sizes = [0 if s is None else s for s in _byte_lengths(texts)]
    lo, held = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and held + s > limit:
            yield lo, i
            lo, held = i, 0
        held += s
    if lo < len(sizes):
        yield lo, len(sizes)


def _byte_lengths(texts: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(texts).to_pylist()


def text_batches(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that numpy temporaries stay near ``KERNEL_BYTES`` times a small constant."""
    for b in batches:
        for lo, hi in text_slices(b.column(column)):
            yield b.slice(lo, hi - lo)


def held_out(column: str, modulus: int, remainder: int):
    """crc32 of the id written as text, modulo ``modulus``, equals ``remainder`` (null id: false)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join on ``key``, unique in ``right``, whose column ``rows`` says how many rows of ``left`` have it.

    Keys of more than a thousandth of all rows (a thousand at least) are sent to all tasks, at most a thousand of them, so no
    task gets all rows of such a key; the others are shuffled.
    """
    limit = max(1000, total // 1000)
    hot, cold = right.where(F.col(rows) > limit).drop(rows), right.where(F.col(rows) <= limit).drop(rows)
    spread = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return spread.unionByName(rest)
