"""Probe protocols on diff-mean directions: LOBO, within, length confound, specificity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsonde.functions.scalars import MODERATE, round_binary
from capsonde.operators import directions as D
from capsonde.operators import sampling as S
from capsonde.operators.auc import rank_sum_auc
from capsonde.operators.scoring import number_directions, projection_sums, score_rows
from capsonde.session import BROADCAST_LIMIT, broadcast_if_small, materialize

LAYER = D.LAYER


class Protocol:
    """The split, the folds and the directions of one evaluation, each written once.

    Metadata (split, folds, halves) comes from the text table alone. `rows` joins it to the
    hidden states; the directions take one aggregation over `rows`, the scores one more scan.
    """

    def __init__(
        self,
        hidden: DataFrame,
        texts: DataFrame,
        kinds: tuple[str, ...] = ("lobo",),
        per_dataset: int = S.NEGATIVES_PER_DATASET,
        per_positive: int = S.NEGATIVES_PER_POSITIVE,
        min_rows: int = S.MIN_FOLD_ROWS,
        seed: int = 0,
        limit: int = BROADCAST_LIMIT,
    ):
        self.texts, self.limit, self.min_rows = texts, limit, min_rows
        self.split = materialize(S.negative_split(texts, per_dataset, per_positive, seed))
        self.folds = materialize(S.folds(texts, min_rows))
        cuts = S.half_cuts(texts, seed) if "within" in kinds else None
        self.rows = D.with_roles(hidden, texts, self.split, cuts, seed)
        self.moments = materialize(D.group_moments(self.rows))
        self.directions = number_directions(
            D.diff_mean_directions(self.moments, self.folds, kinds)
        )

    def of_kind(self, kind: str) -> DataFrame:
        return self.directions.filter(F.col("kind") == kind)

    def scores(self, *kinds: str) -> DataFrame:
        chosen = self.directions.filter(F.col("kind").isin(*kinds))
        return score_rows(self.rows, chosen, self.limit)

    def aucs(self, *kinds: str, scores: DataFrame | None = None) -> DataFrame:
        """AUC per direction with its keys, from a new scan or from scores at hand."""
        scores = self.scores(*kinds) if scores is None else scores
        auc = rank_sum_auc(scores, ["dir_id"], "score", "positive")
        keys = self.directions.select("dir_id", *LAYER, "kind", "cluster_id", "hold")
        return auc.join(keys.filter(F.col("kind").isin(*kinds)), "dir_id").drop("dir_id")


def lobo_folds(protocol: Protocol) -> DataFrame:
    """F6 per fold: tag, layer, cluster_id, hold, auc, n_pos, n_neg."""
    return protocol.aucs("lobo").drop("kind").filter(F.col("auc").isNotNull())


def fold_summary(fold_aucs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and interpolated median over a capability's folds, rounded as published."""
    keys = keys or [*LAYER, "cluster_id"]
    return fold_aucs.groupBy(*keys).agg(
        round_binary(F.avg("auc")).alias("lobo"),
        round_binary(F.median("auc")).alias("lobo_med"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def within_auc(protocol: Protocol) -> DataFrame:
    """direction from half of a capability's texts, tested on the other half."""
    return protocol.aucs("within").drop("kind", "hold")


def length_confound(protocol: Protocol, scores: DataFrame | None = None) -> DataFrame:
    """|Spearman| of projection against log length over the test negatives.

    Test negatives are capped per dataset by the sampler, so a group's windows sort a number
    of rows set by the number of datasets. Lengths are the texts' own, or their `n_chars`.
    """
    sampled = broadcast_if_small(protocol.split.select("uid").distinct(), 256)
    known = "n_chars" in protocol.texts.columns
    n_chars = F.col("n_chars") if known else F.char_length("text")
    lengths = protocol.texts.join(sampled, "uid", "left_semi").select(
        "uid", F.log1p(n_chars.cast("double")).alias("_len")
    )
    full = protocol.of_kind("full")
    scores = protocol.scores("full") if scores is None else scores
    scored = (
        scores.filter(~F.col("positive"))
        .join(full.select("dir_id"), "dir_id", "left_semi")
        .join(lengths, "uid")
    )

    def ranked(column: str):
        group = Window.partitionBy("dir_id")
        ties = Window.partitionBy("dir_id", column)
        return F.rank().over(group.orderBy(column)) + (
            F.count(F.lit(1)).over(ties) - F.lit(1)
        ) / F.lit(2.0)

    ranks = scored.select("dir_id", ranked("score").alias("_a"), ranked("_len").alias("_b"))
    rho = F.try_divide(
        F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")
    )
    keys = full.select("dir_id", *LAYER, "cluster_id")
    return (
        ranks.groupBy("dir_id")
        .agg(F.abs(rho).alias("len_r"), F.count(F.lit(1)).alias("n_neg"))
        .join(keys, "dir_id")
        .drop("dir_id")
    )


def transfer_matrix(
    protocol: Protocol, narrow: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """mean z-scored projection of capability `cluster_id`'s texts on `direction`.

    `narrow` picks rows and directions, by (tag, layer) say, before anything is projected.
    """
    spec = narrow(protocol.of_kind("spec"))
    sums = projection_sums(narrow(protocol.rows), spec, protocol.limit)
    mean = F.col("total") / F.col("n")
    whole = sums.filter(F.col("cluster_id").isNull()).select(
        "dir_id",
        mean.alias("_mean"),
        F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("_sd"),
    )
    keys = spec.select("dir_id", *LAYER, F.col("cluster_id").alias("direction"))
    return (
        sums.filter(F.col("cluster_id").isNotNull())
        .join(whole, "dir_id")
        .join(keys, "dir_id")
        .select(
            *LAYER, "cluster_id", "direction",
            ((mean - F.col("_mean")) / (F.col("_sd") + F.lit(1e-8))).alias("z_mean"),
        )
    )


def spec_rank(matrix: DataFrame) -> DataFrame:
    """How many capabilities project on a direction at least as far as its own."""
    own = matrix.filter(F.col("cluster_id") == F.col("direction")).select(
        *LAYER, "direction", F.col("z_mean").alias("_own")
    )
    return (
        matrix.join(own, [*LAYER, "direction"])
        .groupBy(*LAYER, F.col("direction").alias("cluster_id"))
        .agg(F.count_if(F.col("z_mean") >= F.col("_own")).alias("spec_rank"))
    )


def suspects(
    fold_aucs: DataFrame, summary: DataFrame, bar: float = MODERATE, chance: float = 0.5
) -> DataFrame:
    """folds under chance in a capability which otherwise generalises."""
    good = summary.filter(F.col("lobo_med") >= F.lit(bar)).select(
        *LAYER, "cluster_id", "lobo_med"
    )
    return (
        fold_aucs.withColumn("auc", round_binary(F.col("auc")))
        .filter(F.col("auc") < F.lit(chance))
        .join(good, [*LAYER, "cluster_id"])
        .select(*LAYER, "cluster_id", F.col("hold").alias("dataset_id"), "auc", "lobo_med")
    )
