"""Sessions, tables and the stand-in property graph that the registered queries run on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lumengraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and times in UTC; other settings by keyword."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names for the driver and all executors; only a local session may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or '/tmp/checkpoints'}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder the cluster names, or in one of our own where a local session names none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "cuts"))
    return df.checkpoint(eager=True)


def cut_to_table(df: DataFrame) -> DataFrame:
    """Write the frame once to a table of its own in the shared folder and go on from there; unlike a checkpoint it is
    computed once and its size is known, so small results are joined without a shuffle."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def acted_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers act in the orders they have lines in; rows repeat as lines do."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("head_id"), F.lit("acted_in").alias("type"), F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")).alias("tail_id"))


def directed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers direct their orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("head_id"), F.lit("directed").alias("type"), F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("tail_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(head_id, type, tail_id), each edge once."""
    return acted_raw(spark, sf_dir).unionByName(directed_raw(spark, sf_dir)).distinct()
