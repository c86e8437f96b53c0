"""Single-feature probes: rank every feature on a fold's training rows, test the best one.

A fold's training negatives are the same whichever dataset is held out, so each positive's
wins over them are counted once and a fold's training wins are its capability's total minus
the held-out dataset's. Absent scores are zeros below every present one: the zero block
enters through counts alone, and a sparse encoding is never made dense.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsonde.operators.auc import auc_of, count_wins
from capsonde.operators.lobo import fold_summary
from capsonde.operators.reports import best_depth, method_means

LAYER = ["tag", "layer"]


def role_scores(encoded: DataFrame) -> DataFrame:
    """One row per (capability, role, feature) of each present score.

    `encoded` holds a text's roles and its parallel arrays `features` and `values`. Roles are
    `pos` for a member, `train` and `test` for a sampled negative.
    """
    def entries(role: str, column: str) -> Column:
        return F.transform(
            column, lambda c: F.struct(F.lit(role).alias("role"), c.alias("cluster_id"))
        )

    roles = F.concat(
        entries("pos", "clusters"), entries("train", "neg_train"), entries("test", "neg_test")
    )
    each = encoded.select(
        *LAYER, "dataset_id", F.inline(roles), F.arrays_zip("features", "values").alias("_z")
    )
    return each.select(
        *LAYER, "cluster_id", "role", "dataset_id", F.inline("_z")
    ).select(
        *LAYER, "cluster_id", "role", "dataset_id",
        F.col("features").alias("feature"), F.col("values").alias("score"),
    )


def negative_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("cluster_id").agg(
        F.count_if(F.col("part") == "train").alias("neg_train"),
        F.count_if(F.col("part") == "test").alias("neg_test"),
    )


def with_zeros(wins: Column, present_pos: Column, all_pos: Column, zero_neg: Column) -> Column:
    """Wins including absent scores: a present positive beats every absent negative, an
    absent positive ties with it."""
    return wins + F.lit(0.5) * zero_neg * (all_pos + present_pos)


def train_aucs(scores: DataFrame, fold_table: DataFrame, split: DataFrame) -> DataFrame:
    """per fold the training AUC of every feature which one of its training rows has."""
    keys = [*LAYER, "cluster_id", "feature"]
    training = scores.filter(F.col("role").isin("pos", "train"))
    wins = count_wins(
        training.withColumn("_y", F.col("role") == "pos"), keys, "score", "_y", "dataset_id"
    ).select(*keys, "dataset_id", "wins", F.col("n_pos").alias("present"))
    by_dataset = wins.withColumnRenamed("dataset_id", "hold")
    whole = training.groupBy(*keys).agg(
        F.count_if(F.col("role") == "train").alias("present_neg")
    ).join(
        wins.groupBy(*keys).agg(F.sum("wins").alias("all_wins"), F.sum("present").alias("all_present")),
        keys, "left",
    )
    none = F.lit(0)
    held_in = F.coalesce("all_present", none) - F.coalesce("present", none)
    total = with_zeros(
        F.coalesce("all_wins", F.lit(0.0)) - F.coalesce("wins", F.lit(0.0)),
        held_in,
        F.col("n_train"),
        F.col("neg_train") - F.col("present_neg"),
    )
    return (
        whole.join(fold_table.select("cluster_id", "hold", "n_train"), "cluster_id")
        .join(negative_sizes(split).filter("neg_train > 0 AND neg_test > 0"), "cluster_id")
        .join(by_dataset, [*keys, "hold"], "left")
        .filter((held_in > 0) | (F.col("present_neg") > 0))
        .select(
            *LAYER, "cluster_id", "hold", "feature",
            auc_of(total, F.col("n_train"), F.col("neg_train")).alias("train_auc"),
        )
    )


def best_features(aucs: DataFrame, either_sign: bool, absent_feature: int | None = None) -> DataFrame:
    """the feature with the highest training AUC per fold; the lowest order wins a tie.

    With `either_sign` an AUC under .5 counts as its mirror. `absent_feature` stands for the
    features which no training row has: all of them score exactly .5. A column `order` ranks
    ties where the feature number does not.
    """
    order = F.col("order") if "order" in aucs.columns else F.col("feature")
    a = F.col("train_auc")
    strength = F.greatest(a, F.lit(1.0) - a) if either_sign else a
    sign = F.when(a >= F.lit(0.5), 1).otherwise(-1) if either_sign else F.lit(1)
    choices = aucs.select(
        *LAYER, "cluster_id", "hold",
        F.struct(strength.alias("s"), (-order).alias("o"), "feature", sign.alias("sign")).alias("_c"),
    )
    fold = [*LAYER, "cluster_id", "hold"]
    best = choices.groupBy(*fold).agg(F.max("_c").alias("_c"))
    if absent_feature is not None:
        blank = F.struct(
            F.lit(0.5).alias("s"), F.lit(-absent_feature).alias("o"),
            F.lit(absent_feature).alias("feature"), F.lit(1).alias("sign"),
        )
        best = best.withColumn("_c", F.greatest("_c", blank.cast(best.schema["_c"].dataType)))
    return best.select(*fold, "_c.feature", "_c.sign", F.col("_c.s").alias("train_auc"))


def held_out_aucs(
    scores: DataFrame, chosen: DataFrame, fold_table: DataFrame, split: DataFrame
) -> DataFrame:
    """the chosen feature's AUC on the held-out dataset against the test negatives."""
    fold = [*LAYER, "cluster_id", "hold"]
    wanted = chosen.select(*fold, "feature")
    positives = (
        scores.filter(F.col("role") == "pos")
        .withColumnRenamed("dataset_id", "hold")
        .join(wanted, [*fold, "feature"])
        .select(*fold, "score", F.lit(True).alias("_y"))
    )
    negatives = (
        scores.filter(F.col("role") == "test").drop("dataset_id")
        .join(wanted, [*LAYER, "cluster_id", "feature"])
        .select(*fold, "score", F.lit(False).alias("_y"))
    )
    wins = count_wins(positives.unionByName(negatives), fold, "score", "_y")
    none = F.lit(0)
    total = with_zeros(
        F.coalesce("wins", F.lit(0.0)), F.coalesce("n_pos", none), F.col("n_test"),
        F.col("neg_test") - F.coalesce("n_neg", none),
    )
    auc = auc_of(total, F.col("n_test"), F.col("neg_test"))
    return (
        chosen.join(fold_table.select("cluster_id", "hold", "n_test"), ["cluster_id", "hold"])
        .join(negative_sizes(split), "cluster_id")
        .join(wins, fold, "left")
        .select(
            *fold, "feature", "sign", "train_auc",
            F.when(F.col("sign") > 0, auc).otherwise(F.lit(1.0) - auc).alias("auc"),
        )
    )


@dataclass(frozen=True)
class FeatureReport:
    """cells: one row per (model, layer, capability); layers: mean, median and strong count of each
    layer, and whether it is the model's best; chosen: what each fold chose at the best layer;
    comparison: the best layer beside other methods' cells."""

    cells: DataFrame
    layers: DataFrame
    chosen: DataFrame
    comparison: DataFrame


def feature_report(folds: DataFrame, method: str, others: DataFrame | None = None) -> FeatureReport:
    """F15/F18 from per-fold rows (`held_out_aucs`).

    The best layer of a model has the highest mean over capabilities of their median AUC; the
    shallower one wins a tie. `others` (tag, layer, cluster_id, method, auc) are compared as given.
    """
    cells = fold_summary(folds.filter(F.col("auc").isNotNull()))
    scored = cells.select(*LAYER, "cluster_id", F.lit(method).alias("method"), F.col("lobo_med").alias("auc"))
    means = method_means(scored)
    best = best_depth(means).select("tag", F.col("layer").alias("best_layer"))
    layers = means.join(best, "tag").withColumn("best", F.col("layer") == F.col("best_layer"))
    at_best = F.col("layer") == F.col("best_layer")
    chosen = folds.join(best, "tag").filter(at_best).drop("best_layer")
    own = layers.filter("best").drop("best", "best_layer")
    comparison = own if others is None else own.unionByName(method_means(others))
    return FeatureReport(cells, layers.drop("best_layer"), chosen, comparison)
