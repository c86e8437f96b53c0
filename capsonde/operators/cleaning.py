"""Cross-model voting on dataset-to-capability mappings, and applying its verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsonde.functions.scalars import MODERATE, round_binary
from capsonde.session import broadcast_if_small

# Fixed values of the rule.
CHANCE = 0.5
MIN_VOTES = 3
MIN_SHARE = 0.6
REMOVED_NOTE = "removed_by_probe_cleaning"

MAPPING = ["cluster_id", "dataset_id"]

# Fixed value: mappings removed by hand, whatever the votes say.
MANUAL_REMOVALS = [("cap071", "Putnam-AXIOM/putnam-axiom-dataset-ICML-2025-522")]


def manual_removals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANUAL_REMOVALS, "cluster_id string, dataset_id string")


def votes(fold_aucs: DataFrame, summary: DataFrame, bar: float = MODERATE) -> DataFrame:
    """Per mapping, models whose capability generalises and those finding it suspect.

    `fold_aucs` (tag, cluster_id, dataset_id, auc) and `summary` (tag, cluster_id, lobo_med)
    are each model's results at its best layer. Limits act on rounded values (H7).
    """
    able = summary.filter(F.col("lobo_med") >= F.lit(bar)).select("tag", "cluster_id")
    return (
        fold_aucs.join(able, ["tag", "cluster_id"])
        .groupBy(*MAPPING)
        .agg(
            F.count_if(round_binary(F.col("auc")) < F.lit(CHANCE)).alias("suspect"),
            F.count(F.lit(1)).alias("eligible"),
        )
    )


def is_outvoted():
    share = F.try_divide(F.col("suspect"), F.col("eligible"))
    return (F.col("eligible") >= MIN_VOTES) & (share >= F.lit(MIN_SHARE))


def removals(voted: DataFrame, manual: DataFrame) -> DataFrame:
    """Outvoted mappings together with the manual list."""
    return voted.filter(is_outvoted()).select(*MAPPING).union(manual.select(*MAPPING)).distinct()


def cleaning_log(voted: DataFrame, manual: DataFrame) -> DataFrame:
    """Verdict on every mapping with a suspect vote, and the manual ones."""
    verdict = F.when(is_outvoted(), "removed").otherwise("kept")
    noted = voted.filter(is_outvoted() | (F.col("suspect") > 0)).withColumn("verdict", verdict)
    by_hand = manual.select(
        *MAPPING,
        F.lit(None).cast("bigint").alias("suspect"),
        F.lit(None).cast("bigint").alias("eligible"),
        F.lit("manual").alias("verdict"),
    )
    return noted.unionByName(by_hand)


def _by_dataset(removed: DataFrame) -> DataFrame:
    """One row per touched dataset: at most as many entries as there are capabilities."""
    listed = removed.groupBy("dataset_id").agg(
        F.array_sort(F.collect_set("cluster_id")).alias("_bad")
    )
    return broadcast_if_small(listed, 128, sized_by=removed)


def patch_texts(texts: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop removed capabilities from the texts' tags; texts and uids stay.

    A text left without tags stays and may serve as a negative (H4). `patched` marks changes.
    """
    bad = F.coalesce("_bad", F.array().cast("array<string>"))
    return (
        texts.join(_by_dataset(removed), "dataset_id", "left")
        .withColumn("_kept", F.array_except("clusters", bad))
        .withColumn("patched", F.size("_kept") < F.size("clusters"))
        .withColumn("clusters", F.col("_kept"))
        .drop("_kept", "_bad")
    )


def patch_matches(matches: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop entries naming a removed capability as "(id)" from matched records.

    A record which loses its last capability this way loses its match too.
    """
    bad = _by_dataset(removed).withColumnRenamed("dataset_id", "match")
    kept = F.filter(
        "clusters",
        lambda x: ~F.exists(
            F.coalesce("_bad", F.array().cast("array<string>")),
            lambda c: F.contains(x, F.concat(F.lit("("), c, F.lit(")"))),
        ),
    )
    emptied = F.col("edited") & (F.size("_kept") == 0)
    return (
        matches.join(bad, "match", "left")
        .withColumn("_kept", kept)
        .withColumn("edited", F.size("_kept") < F.size("clusters"))
        .withColumn("clusters", F.col("_kept"))
        .withColumn("match", F.when(~emptied, F.col("match")))
        .withColumn("note", F.when(emptied, F.lit(REMOVED_NOTE)).otherwise(F.col("note")))
        .drop("_kept", "_bad")
    )
