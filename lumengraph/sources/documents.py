"""Document sources and sinks: JSON folders, JSON lines, validation, incremental skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wikitext import strip

RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "title", "url", "entity_type", "text")] + [T.StructField("infobox", T.MapType(T.StringType(), T.StringType())), T.StructField("_corrupt_record", T.StringType())])
REQUIRED = ["doc_id", "title", "entity_type", "text"]


def json_folder(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file; unreadable files keep their text in ``_corrupt_record``; ``source`` is the file."""
    return spark.read.schema(RAW).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("source", F.input_file_name())


def validate(rows: DataFrame, required: list[str] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason); all required fields but the text are trimmed."""
    missing = F.array_compact(F.array(*[F.when(strip(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(c)) for c in required]))
    reason = F.when(F.col("_corrupt_record").isNotNull(), F.lit("unreadable")).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    tagged = rows.withColumn("reason", reason)
    ok = tagged.where("reason IS NULL").drop("reason", "_corrupt_record")
    for c in ("doc_id", "title", "url", "entity_type"):
        ok = ok.withColumn(c, strip(F.col(c)))
    return ok, tagged.where("reason IS NOT NULL").select("source", "reason")


def skip_done(rows: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def fault(required: list[str], too_short: Column) -> Column:
    """Why a row by itself is left out; null if it isn't."""
    blank = F.lit(False)
    for c in required:
        blank = blank | (strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    return F.when(blank, "missing_field").when(too_short, "too_short")


def ledger(rows: DataFrame, required: list[str], too_short: Column, done: DataFrame, key: str) -> DataFrame:
    """Each row with why it is left out, or "accepted"."""
    marked = rows.join(done.select(F.col(key), F.lit(True).alias("__done")).distinct(), key, "left")
    reason = F.coalesce(fault(required, too_short), F.when(F.col("__done"), "already_done").otherwise("accepted"))
    return marked.withColumn("reason", reason).drop("__done")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> tuple[DataFrame, int]:
    """Good records (at most ``limit``) and the number of bad lines."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache()
    bad = rows.where("_corrupt_record IS NOT NULL").count()
    good = rows.where("_corrupt_record IS NULL").drop("_corrupt_record")
    return (good.limit(limit) if limit is not None else good), bad


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def variant_table(spark: SparkSession, path: str) -> tuple[str, str]:
    """Lines of two characters ("#" starts a comment) -> what to translate from and to."""
    pairs = [r[0] for r in spark.read.text(path).where(~F.col("value").startswith("#")).collect()]
    good = [p.strip() for p in pairs if len(p.strip()) == 2]
    return "".join(p[0] for p in good), "".join(p[1] for p in good)


def embedding_misses(texts: DataFrame, cache: DataFrame, encoder: str) -> DataFrame:
    """Texts whose (encoder, text) digest the cache doesn't have."""
    key = F.sha2(F.to_json(F.struct(F.lit(encoder).alias("encoder"), "text")), 256)
    return texts.withColumn("key", key).join(cache.select("key"), "key", "left_anti")
