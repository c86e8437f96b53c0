"""Hidden-state tables: load, co-located storage, and long sinks for arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYER = ["tag", "layer"]


def read_hidden(
    spark: SparkSession, path: str, tags: list[str] | None = None, layers: list[int] | None = None
) -> DataFrame:
    """Hidden states stored as parquet partitioned by (tag, layer); unread partitions are pruned."""
    df = spark.read.parquet(path)
    if tags:
        df = df.filter(F.col("tag").isin(tags))
    if layers:
        df = df.filter(F.col("layer").isin(layers))
    return df


def write_hidden(hidden: DataFrame, path: str) -> None:
    hidden.write.mode("overwrite").partitionBy(*LAYER).parquet(path)


def write_bucketed(
    df: DataFrame, name: str, buckets: int, by: str = "uid", partition_by: list[str] | None = None
) -> None:
    """Store a table bucketed by its join key, inside partitions of `partition_by`.

    With hidden states and texts both bucketed by uid, attaching the texts reads bucket
    beside bucket and shuffles no vector. Hidden states partitioned by (tag, layer) as well are
    read for the wanted layers alone.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def load_hidden(hidden: DataFrame, texts: DataFrame) -> DataFrame:
    """A5: hidden states with their text's dataset, tags and log length.

    Several shards arrive as one table (union); hidden rows whose uid has no text drop out.
    """
    described = texts.select(
        "uid", "dataset_id", "clusters",
        F.log1p(F.char_length("text").cast("double")).alias("log_len"),
    )
    return hidden.withColumn("h", F.col("h").cast("array<float>")).join(described, "uid")


def dropped_hidden(hidden: DataFrame, texts: DataFrame) -> DataFrame:
    """Number of hidden rows per (tag, layer) which no text claims."""
    return (
        hidden.join(texts.select("uid"), "uid", "left_anti")
        .groupBy(*LAYER).agg(F.count(F.lit(1)).alias("dropped"))
    )


def write_vectors(df: DataFrame, vector: str, path: str) -> None:
    """A table of vectors as long rows (..., dim, value)."""
    keys = [c for c in df.columns if c != vector]
    df.select(*keys, F.posexplode(vector).alias("dim", "value")).write.mode("overwrite").parquet(path)
