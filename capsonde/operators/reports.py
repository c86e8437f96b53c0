"""Summary tables over probe results. Inputs are one row per cell, fold or capability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsonde.functions.numbering import positions, value_bucket
from capsonde.functions.scalars import MODERATE, STRONG, round_binary

LAYER = ["tag", "layer"]


def at_least(limit: float, score: str) -> Column:
    return F.count_if(F.col(score) >= F.lit(limit))


def layer_cells(summary: DataFrame, within: DataFrame) -> DataFrame:
    """One row per (model, layer, capability): LOBO scores where it has folds, and `within`."""
    inside = within.select(*LAYER, "cluster_id", round_binary(F.col("auc")).alias("within"))
    return inside.join(summary, [*LAYER, "cluster_id"], "left")


def best_layer(cells: DataFrame) -> DataFrame:
    """Layer with the highest mean score per model, the shallowest on a tie.

    A capability without folds counts with its within score.
    """
    scores = cells.groupBy(*LAYER).agg(F.avg(F.coalesce("lobo_med", "within")).alias("score"))
    return scores.groupBy("tag").agg(
        F.max_by("layer", F.struct(F.col("score"), -F.col("layer"))).alias("best_layer"),
        F.max("score").alias("score"),
    )


def tier_counts(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Strong, moderate and weak capabilities, and the mean of their medians.

    A summary with `spec_rank` also has how many capabilities rank first on their own direction.
    """
    keys = keys or LAYER
    med = F.col("lobo_med")
    first = [F.count_if(F.col("spec_rank") == 1).alias("spec_first")] if "spec_rank" in summary.columns else []
    return (
        summary.filter(med.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_lobo"),
            at_least(STRONG, "lobo_med").alias("strong"),
            F.count_if((med >= F.lit(MODERATE)) & (med < F.lit(STRONG))).alias("moderate"),
            F.count_if(med < F.lit(MODERATE)).alias("weak"),
            F.avg(med).alias("mean_median"),
            *first,
        )
    )


METHODS = ["diffmean", "pca", "lr"]


def long_methods(results: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """One row per (model, layer, capability, method) from a wide method table."""
    methods = methods or METHODS
    pairs = F.array(*[
        F.struct(F.lit(i).alias("method_no"), F.lit(m).alias("method"), F.col(m).alias("auc"))
        for i, m in enumerate(methods)
    ])
    return results.select(*LAYER, "cluster_id", F.inline(pairs))


def wide_methods(cells: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Method scores side by side, one row per (model, layer, capability)."""
    return cells.groupBy(*LAYER, "cluster_id").pivot("method", methods or METHODS).agg(F.max("auc"))


def method_means(cells: DataFrame) -> DataFrame:
    """Mean, median and strong count of the scored cells per (model, layer, method)."""
    return (
        cells.filter(F.col("auc").isNotNull())
        .groupBy(*LAYER, "method")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("auc").alias("mean"),
            F.median("auc").alias("median"),
            at_least(STRONG, "auc").alias("strong"),
        )
    )


def best_depth(means: DataFrame) -> DataFrame:
    """Per (model, method) the depth with the highest mean, and every depth's mean.

    The shallower depth wins a tie.
    """
    first = F.struct(F.col("mean"), -F.col("layer"))
    depths = F.array_sort(F.collect_list(F.struct("layer", "mean")))
    return means.groupBy("tag", "method").agg(
        F.max("mean").alias("auc"),
        F.max_by("layer", first).alias("layer"),
        F.map_from_entries(depths).alias("all_layers"),
    )


def best_depth_table(best: DataFrame, methods: list[str]) -> DataFrame:
    """F20 in report form: one row per model with each method's score and depth."""
    return best.groupBy("tag").pivot("method", methods).agg(
        F.max("auc").alias("auc"), F.max("layer").alias("layer")
    )


def cells_at_best_depth(cells: DataFrame, best: DataFrame) -> DataFrame:
    return cells.join(best.select("tag", "method", "layer"), ["tag", "method", "layer"])


def method_wins(cells: DataFrame) -> DataFrame:
    """I4: how many (model, capability) cells each method wins, and its share.

    Equal scores go to the method listed first (`method_no`).
    """
    winner = (
        cells.filter(F.col("auc").isNotNull())
        .groupBy("tag", "cluster_id")
        .agg(F.max_by("method", F.struct(F.col("auc"), -F.col("method_no"))).alias("method"))
    )
    wins = winner.groupBy("method").agg(F.count(F.lit(1)).alias("wins"))
    share = F.col("wins") / F.sum("wins").over(Window.partitionBy(F.lit(0)))
    return wins.withColumn("share", share)


def numbered_by_score(summary: DataFrame, score: str, *keys: str) -> DataFrame:
    """G3 as a column: every row's `position`, highest score first, a missing score as zero."""
    value = F.coalesce(score, F.lit(0.0))
    return positions(summary, [value.desc(), *map(F.col, keys)], -value_bucket(value))


def by_score(summary: DataFrame, score: str, key: str = "cluster_id") -> DataFrame:
    """Highest score first, a missing score as zero."""
    return summary.orderBy(F.coalesce(score, F.lit(0.0)).desc(), key)


def score_summary(cells: DataFrame, key: str, score: str) -> DataFrame:
    """Concepts, mean, and how many score at least .8 or under .7."""
    return cells.groupBy(key).agg(
        F.count(score).alias("concepts"),
        F.avg(score).alias("mean_acc"),
        at_least(0.8, score).alias("ge_0_8"),
        F.count_if(F.col(score) < F.lit(0.7)).alias("lt_0_7"),
    )


def delta_summary(cells: DataFrame, key: str, delta: str, band: float = 0.0) -> DataFrame:
    """Steering deltas above, below and inside a neutral band around zero."""
    d = F.col(delta)
    return cells.groupBy(key).agg(
        F.count(delta).alias("concepts"),
        F.avg(delta).alias("mean_delta"),
        F.count_if(d > F.lit(band)).alias("positive"),
        F.count_if(d < F.lit(-band)).alias("negative"),
        F.count_if(F.abs(d) <= F.lit(band)).alias("neutral"),
    )


def transfer_summary(pairs: DataFrame, key: str, accuracy: str, success: float = 0.55) -> DataFrame:
    """Cross-benchmark pairs per model, those above chance, and those which succeed."""
    return pairs.groupBy(key).agg(
        F.count(accuracy).alias("pairs"),
        F.count_if(F.col(accuracy) > F.lit(0.5)).alias("positive_pairs"),
        F.count_if(F.col(accuracy) > F.lit(success)).alias("success"),
        F.avg(accuracy).alias("avg_acc"),
    )


def ablation_deltas(
    runs: DataFrame, key: str, variant: str, value: str, base: str, variants: list[str]
) -> DataFrame:
    """Each variant's mean minus the base variant's, per model."""
    wide = runs.groupBy(key).pivot(variant, [base, *variants]).agg(F.avg(value))
    return wide.select(
        key,
        F.col(base).alias("base"),
        *[(F.col(v) - F.col(base)).alias(f"delta_{v}") for v in variants],
    )


def report_rows(
    protocol_rows: DataFrame, taxonomy: DataFrame, score: str = "lobo_med"
) -> DataFrame:
    """Result rows with the capability's name, strongest first."""
    return by_score(protocol_rows.join(taxonomy, "cluster_id"), score)
