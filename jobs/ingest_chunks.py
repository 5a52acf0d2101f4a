"""Incremental ingest: new documents are checked, cleaned and cut into chunks that later steps embed, link and cite.

The documents are a file stream. Each run takes the files that are new since the checkpoint, in micro-batches,
and ends. A batch writes two tables, both partitioned by the batch's number first:

* ``ledger``: how many rows of each doc_id were left out and why, or "accepted" (batch, reason);
* ``chunks``: the accepted documents' chunks, of cleaned text, with code-point offsets (batch, lang).

A batch that is run again after a failure replaces its own partitions and looks only at earlier ones, so its result
is the same. A document is accepted once: rows whose doc_id an earlier batch has accepted are "already_done",
and of several rows of one doc_id in a batch the one of the smallest text hash is taken, the others are "repeated".
Blank or null ids, languages, sources and texts are "missing_field"; texts under ``min_chars`` are "too_short".

    python -m jobs.ingest_chunks --documents DIR --output DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, read_config, read_if_there, replace_partitions
from lumengraph.functions.chunking import chunk_rows
from lumengraph.functions.cleaning import clean
from lumengraph.sources.documents import fault

DEFAULTS = os.path.join(os.path.dirname(__file__), "ingest_chunks.json")
LEDGER = "doc_id long, lang string, source string, rows long, batch long, reason string"
CHUNKS = "doc_id long, source string, seq int, chunk_id string, char_offset int, chunk_text string, batch long, lang string"


def sorted_out(rows: DataFrame, done: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(accepted documents, ledger) of rows (doc_id, lang, source, text); ``done``: doc_id of what earlier batches accepted.

    Rows of one doc_id are added up before anything is joined, so a repeated id is no hot key. Which of them counts
    depends on the rows alone, so a task that is run again takes the same one.
    """
    marked = rows.withColumn("reason", fault(["doc_id", "lang", "source", "text"], F.length("text") < min_chars))
    marked = marked.withColumn("hash", F.xxhash64("lang", "source", "text"))
    fine, known = marked.where("reason IS NULL"), done.select("doc_id", F.lit(True).alias("known")).distinct()
    accepted = fine.groupBy("doc_id").agg(F.min(F.struct("hash", "lang", "source", "text")).alias("d")).join(known, "doc_id", "left_anti").select("doc_id", "d.lang", "d.source", "d.text")
    counted = fine.groupBy("doc_id").agg(F.min(F.struct("hash", "lang", "source")).alias("d"), F.count("*").alias("n")).join(known, "doc_id", "left")
    told = F.when(F.col("known"), F.array(F.struct(F.lit("already_done").alias("reason"), F.col("n").alias("rows")))).otherwise(
        F.array(F.struct(F.lit("accepted").alias("reason"), F.lit(1).cast("long").alias("rows")), F.struct(F.lit("repeated").alias("reason"), (F.col("n") - 1).alias("rows")))
    )
    good = counted.select("doc_id", "d.lang", "d.source", F.explode(told).alias("t")).select("doc_id", "lang", "source", "t.rows", "t.reason").where("rows > 0")
    bad = marked.where("reason IS NOT NULL").groupBy("doc_id", "lang", "source", "reason").agg(F.count("*").alias("rows"))
    return accepted, good.unionByName(bad)


def stream_path(there: DataFrame, path: str) -> str:
    """``path`` as a file stream takes it: a folder as it is, a single file as a pattern that matches only that file."""
    one = there.select(F.col("_metadata.file_path")).first()
    single = one is not None and one[0].rstrip("/").endswith("/" + path.rstrip("/").rpartition("/")[2])
    return f"{path[:-1]}[{path[-1]}]" if single else path


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: str | None = None) -> dict:
    """Takes what is new under ``documents`` (Parquet: doc_id, text, lang, source); returns the counts of what it wrote."""
    settings = read_config(config, DEFAULTS)
    wrote = {"batches": 0, "rows": 0, "accepted": 0, "chunks": 0}

    def take(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        written = read_if_there(session, f"{output}/ledger", LEDGER)
        done = written.where((F.col("batch") < batch) & (F.col("reason") == "accepted")).select("doc_id")
        accepted, told = sorted_out(rows, done, settings["min_chars"])
        number = F.lit(batch).cast("long")
        cleaned = accepted.withColumn("text", clean(F.col("text"), tuple(settings["drop"]))).withColumn("batch", number)
        replace_partitions(chunk_rows(cleaned, "text", settings["target"], settings["longest"], settings["shortest"]), f"{output}/chunks", "batch", "lang")
        # the ledger comes last: a batch that it lists is complete
        replace_partitions(told.withColumn("batch", number), f"{output}/ledger", "batch", "reason")
        reasons = {r["reason"]: r["n"] for r in read_if_there(session, f"{output}/ledger", LEDGER).where(F.col("batch") == batch).groupBy("reason").agg(F.sum("rows").alias("n")).collect()}
        chunks = read_if_there(session, f"{output}/chunks", CHUNKS).where(F.col("batch") == batch).count()
        log.info("batch %d: read %d rows of %s, %s; wrote %d chunks to %s", batch, sum(reasons.values()), documents, reasons, chunks, output)
        for key, value in (("batches", 1), ("rows", sum(reasons.values())), ("accepted", reasons.get("accepted", 0)), ("chunks", chunks)):
            wrote[key] += value

    there = spark.read.parquet(documents)
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", settings["max_files_per_batch"]).parquet(stream_path(there, documents))
    columns = stream.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    columns.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("ingest of %s into %s: %s", documents, output, wrote)
    return wrote


def main() -> None:
    p = argparse.ArgumentParser(prog="ingest_chunks", description=__doc__.split("\n")[0])
    for name in ("documents", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    command_line(p, run)


if __name__ == "__main__":
    main()
