"""exact, tie-aware ROC AUC of many groups at once.

AUC is the share of (positive, negative) pairs in which the positive scores higher, a tie
counting half. The pairs are never formed: equal scores collapse in a map-side aggregate,
each group is cut into value buckets, and wins are counted inside a bucket and then lifted by the number of negatives in the buckets below. No group is ever
sorted in one task.

Wins add up over positives. A score whose negatives are the same for several folds is
therefore ranked once, with the positives of each dataset counted apart by `part`; the wins
of any union of datasets are plain sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsonde.functions.numbering import cut_heavy_buckets, ranked, value_bucket


def count_wins(
    scored: DataFrame, keys: list[str], score: str, positive: str, part: str | None = None,
    heavy_rows: int | None = None,
) -> DataFrame:
    """Rows (keys[, part], wins, n_pos, n_neg); negatives are shared by all parts of a group.

    A part appears when it has a positive; a group without negatives reports n_neg 0. Rows whose
    score is NaN or null count on neither side; infinite scores rank outermost. With `heavy_rows`
    buckets above it are cut at borders of their own (`cut_heavy_buckets`), for scores that lie
    closer together than the fixed steps.
    """
    parts = [part] if part else []
    is_pos = F.col(positive)
    part_of = [F.when(is_pos, F.col(p)).alias(p) for p in parts]
    ties = (
        ranked(scored, score).select(*keys, *part_of, F.col(score).cast("double").alias("_s"), is_pos.alias("_y"))
        .withColumn("_b", value_bucket(F.col("_s")))
        .groupBy(*keys, "_b", "_s", *parts)
        .agg(F.count_if("_y").alias("_p"), F.count_if(~F.col("_y")).alias("_q"))
    )
    cut = ["_b"]
    if heavy_rows is not None:
        named = F.col("_p") + F.col("_q") + sum((F.when(F.col(p).isNull(), 0).otherwise(0) for p in parts), F.lit(0))
        ties, cut = cut_heavy_buckets(ties, keys, "_s", named, heavy_rows=heavy_rows), ["_b", "_c"]
    in_bucket = Window.partitionBy(*keys, *cut)
    up_to = in_bucket.orderBy("_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Without parts a score is one row of its bucket, and a bucket one row of its group.
    tied = F.sum("_q").over(Window.partitionBy(*keys, *cut, "_s")) if part else F.col("_q")
    beaten = F.sum("_q").over(up_to) - tied * F.lit(0.5)
    by_bucket = (
        ties.withColumn("_w", F.col("_p") * beaten)
        .groupBy(*keys, *cut, *parts)
        .agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    )
    group = Window.partitionBy(*keys)
    up_to_bucket = group.orderBy(F.struct(*cut)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum("_q").over(in_bucket) if part else F.col("_q")
    below = F.sum("_q").over(up_to_bucket) - own
    lifted = by_bucket.withColumn("_w", F.col("_w") + F.col("_p") * below)
    if not part:
        return lifted.groupBy(*keys).agg(
            F.sum("_w").alias("wins"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg")
        )
    return (
        lifted.withColumn("_n", F.sum("_q").over(group))
        .groupBy(*keys, part)
        .agg(F.sum("_w").alias("wins"), F.sum("_p").alias("n_pos"), F.max("_n").alias("n_neg"))
        .filter(F.col(part).isNotNull())
    )


def auc_of(wins: Column, n_pos: Column, n_neg: Column) -> Column:
    """Null when either class is empty."""
    return F.try_divide(wins.cast("double"), n_pos.cast("double") * n_neg)


def rank_sum_auc(
    scored: DataFrame, keys: list[str], score: str, positive: str, heavy_rows: int | None = None
) -> DataFrame:
    """One row per group: keys, auc, n_pos, n_neg."""
    wins = count_wins(scored, keys, score, positive, heavy_rows=heavy_rows)
    auc = auc_of(F.col("wins"), F.col("n_pos"), F.col("n_neg"))
    return wins.select(*keys, auc.alias("auc"), "n_pos", "n_neg")
