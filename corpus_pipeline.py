"""The training-data pipeline: documents in, cleaned and encoded documents out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as
Parquet before the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsonde.llm import decontamination, jaccard_join, pii, quality, sampled_encoding
from capsonde.llm.registry import ORACLES, PIECES, QUERIES, SURROGATE_KEY, THRESHOLD, table, training_labels
from capsonde.llm.storage import free_names, stored


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores at least THRESHOLD; a null text is scored as the empty one.

    The word vectors come from all rows; the network is fitted on a bounded sample of labelled
    ones. A column called score in the input is the caller's and is kept.
    """
    columns = docs.columns
    vectors = quality.context_vectors(docs)
    network = quality.fit(docs, training_labels(spark, sf_dir), vectors)
    return quality.score(docs, vectors, network, "__quality").where(F.col("__quality") >= THRESHOLD).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Documents without words are in no group. A doc_id that stands on several texts loses only those
    that are copies, and keeps one of its own texts that are copies of each other. Of rows that
    repeat a doc_id and a text one stays. Rows with a null doc_id can't be told apart and stay, one
    for each text.
    """
    names = docs.columns
    groups = stored(jaccard_join.similarity_components(docs), "groups")
    later = groups.where("component_id < doc_id").select("doc_id", "class")
    own = groups.where("component_id = doc_id AND class IS NOT NULL")
    first = own.groupBy("doc_id").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
    others = own.join(first, "doc_id").where("class > least").select("doc_id", "class")
    gone = stored(later.unionByName(others).distinct(), "duplicates")
    # Texts are only compared where a doc_id, or none, stands in several rows.
    id_, of_, kind = free_names(names, 3)
    often = stored(groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_)), "repeated-ids")
    same = F.col("doc_id").eqNullSafe(F.col(id_))
    single = docs.join(often, same, "left_anti").join(gone.select("doc_id"), "doc_id", "left_anti")
    several = jaccard_join.add_class(docs.join(often, same, "left_semi"), kind)
    copies = gone.select(F.col("doc_id").alias(id_), F.col("class").alias(of_))
    several = several.join(copies, (F.col("doc_id") == F.col(id_)) & (F.col(kind) == F.col(of_)), "left_anti")
    # Texts of one class under one doc_id are copies; without a class, or an id, only equal texts are.
    alike = F.when(F.col("doc_id").isNotNull() & F.col(kind).isNotNull(), F.col(kind).cast("string")).otherwise(F.col("text"))
    one = several.withColumn(kind, F.struct(F.col(kind).isNull().alias("empty"), alike.alias("alike"))).dropDuplicates(["doc_id", kind])
    return single.select(*names).unionByName(one.select(*names))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold less benchmark text than the contamination rule allows; they stay unchanged."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontamination.contaminated()).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates for the personal data in their texts and n_chars to match."""
    replaced = pii.replace_entities(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        changed = F.col("n_entities") > 0
        kind = docs.schema["n_chars"].dataType
        replaced = replaced.withColumn(
            "n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return replaced.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its sampled segmentations, which decode to its text."""
    return sampled_encoding.encode(docs, PIECES)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # a trained network decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES) | {"pipeline": run}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
