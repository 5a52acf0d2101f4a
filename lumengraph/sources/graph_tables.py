"""Graph snapshots, upsert sinks and result ledgers as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import drop_orphans


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges with a missing endpoint are left out."""
    nodes = spark.read.parquet(f"{path}/nodes")
    return nodes, drop_orphans(spark.read.parquet(f"{path}/edges"), nodes)


def merge_latest(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, the new ones winning by key."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__v")))
    return both.withColumn("__r", r).where("__r = 1").drop("__v", "__r")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("run_signature").parquet(path)


def pending(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Work that the ledger doesn't have yet."""
    key = ["question_id", "method", "graph_view", "run_signature"]
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def content_digest(spark: SparkSession, paths: list[str]) -> str:
    """SHA-256 over the named files' names and digests, in the given order."""
    import hashlib

    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return hashlib.sha256("\n".join(f"{r[0]} {r[1]}" for r in sorted(files.collect())).encode()).hexdigest()
