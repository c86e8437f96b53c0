"""JSON-lines tables: declared schemas, order of lines, tolerant reads, resumable logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def line_order() -> Column:
    """Sort key in file order: file, block within the file, line within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_jsonl(
    spark: SparkSession, path: str, schema: str | T.StructType, order: str | None = None
) -> DataFrame:
    """A1: rows of a JSON-lines file; a line which is not JSON is an error.

    `order` names a column for the line order, where the rows carry no position of their own.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.withColumn(order, line_order()) if order else df


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A3: skip lines which are not JSON; keep rows whose key is present and not empty."""
    df = (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    kept = F.col(CORRUPT).isNull() & F.col(key).isNotNull() & (F.col(key) != "")
    return df.filter(kept).drop(CORRUPT)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A2: UTF-8 JSON lines, null fields written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def pending(rows: DataFrame, done: DataFrame, key: str, retry_errors: bool = False) -> DataFrame:
    """Rows the log does not hold yet. Failed rows count as done unless retried."""
    if retry_errors:
        done = done.filter(F.coalesce("status", F.lit("")) == "ok")
    return rows.join(done.select(key).distinct(), key, "left_anti")


def append_pending(
    rows: DataFrame, path: str, key: str, produce, retry_errors: bool = False
) -> DataFrame:
    """Produce results for the rows a log is missing, append them, return the whole log.

    `produce` maps the pending rows to results which carry the key. Results are written once;
    a run that dies before its commit leaves the log as it was. A log that is there but cannot be
    read, or lacks the key, is an error. With `retry_errors` a key's latest row is returned.
    """
    spark = rows.sparkSession
    todo = pending(rows, spark.read.parquet(path), key, retry_errors) if path_exists(spark, path) else rows
    produce(todo).write.mode("append").parquet(path)
    log = spark.read.parquet(path)
    if not retry_errors:
        return log
    latest = Window.partitionBy(key).orderBy(
        F.col("_metadata.file_modification_time").desc(), (F.col("status") == "ok").desc_nulls_last())
    return log.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") == 1).drop("_rn")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def next_shard(shards: DataFrame, column: str = "shard") -> DataFrame:
    """Number of the shard which takes the missing rows."""
    return shards.agg((F.max(column) + 1).alias("next_shard"))


def corpus_slice(texts: DataFrame, n: int, min_chars: int = 600, pos: str = "pos") -> DataFrame:
    """A10: the first n texts with at least `min_chars` characters; fails when there are fewer."""
    from capsonde.functions.text import strip

    picked = (
        texts.filter(F.char_length(strip(F.col("text"))) >= min_chars).orderBy(pos).limit(n)
    )
    found = picked.count()
    if found != n:
        raise ValueError(f"only found {found} qualifying texts")
    return picked
