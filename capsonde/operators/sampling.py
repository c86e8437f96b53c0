"""Positives, stratified negatives, splits and leave-one-dataset-out folds.

All of it runs on the text table (uid, dataset_id, clusters); no vector is touched. Random
draws are replaced by hash orders, so a split is a function of (seed, capability) and is the
same for every model, layer and method.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsonde.functions.numbering import hash_bucket
from capsonde.functions.scalars import draw_key
from capsonde.session import broadcast_if_small, materialize

# Fixed values of the protocol.
NEGATIVES_PER_DATASET = 30
NEGATIVES_PER_POSITIVE = 6
MIN_FOLD_ROWS = 10


def members(texts: DataFrame) -> DataFrame:
    """One row per (capability, text) membership."""
    return texts.select(F.explode("clusters").alias("cluster_id"), "dataset_id", "uid")


def dataset_counts(texts: DataFrame) -> DataFrame:
    """Texts and distinct datasets per capability."""
    per_dataset = members(texts).groupBy("cluster_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return per_dataset.groupBy("cluster_id").agg(
        F.sum("_n").alias("n_pos"), F.count(F.lit(1)).alias("n_datasets")
    )


def _pool(texts: DataFrame, per_dataset: int, seed: int) -> DataFrame:
    """The few texts of which every capability's draw consists.

    The draw inside a dataset uses one order for all capabilities, so the first rows of each
    (dataset, tag set) contain every capability's draw; texts are cut to them map-side. `own` lists
    the capabilities that occur in the dataset, `_place` is a row's place in the dataset's draw.
    """
    tagged = texts.select(
        "uid", "dataset_id", F.array_sort("clusters").alias("clusters")
    ).withColumn("_draw", draw_key(seed, F.col("uid")))
    in_tag_set = Window.partitionBy("dataset_id", "clusters").orderBy("_draw", "uid")
    pool = tagged.withColumn("_rn", F.row_number().over(in_tag_set)).filter(
        F.col("_rn") <= per_dataset
    )
    in_dataset = Window.partitionBy("dataset_id")
    own = F.array_distinct(F.flatten(F.collect_set("clusters").over(in_dataset)))
    placed = F.row_number().over(in_dataset.orderBy("_draw", "uid"))
    return pool.select("uid", "dataset_id", "clusters", "_draw", own.alias("own"), placed.alias("_place"))


def _taxonomy(pool: DataFrame) -> DataFrame:
    return pool.select(F.explode("clusters").alias("cluster_id")).distinct()


def _first_draws(drawn: DataFrame, per_dataset: int) -> tuple[DataFrame, DataFrame]:
    """The first cut of E6 without pairing texts and capabilities.

    A capability that no text of a dataset has draws the dataset's own first rows: `plain`
    (dataset_id, uid, own). Only the others are paired with the pool: `touching` (cluster_id,
    dataset_id, uid).
    """
    plain = drawn.filter(F.col("_place") <= per_dataset).select("dataset_id", "uid", "own")
    in_pair = Window.partitionBy("cluster_id", "dataset_id").orderBy("_draw", "uid")
    touching = (
        drawn.withColumn("cluster_id", F.explode(F.array_except("own", "clusters")))
        .withColumn("_rn", F.row_number().over(in_pair))
        .filter(F.col("_rn") <= per_dataset)
        .select("cluster_id", "dataset_id", "uid")
    )
    return plain, touching


def _listed(capabilities: DataFrame, *columns: str):
    """The taxonomy as one array of structs, for each row to take its own part of."""
    return capabilities.agg(F.array_sort(F.collect_list(F.struct("cluster_id", *columns)))).scalar()


def negative_candidates(
    texts: DataFrame, per_dataset: int = NEGATIVES_PER_DATASET, seed: int = 0
) -> DataFrame:
    """C7 and the first cut of E6: up to `per_dataset` non-members per (capability, dataset)."""
    return _paired(_pool(texts, per_dataset, seed), per_dataset)


def _paired(pool: DataFrame, per_dataset: int) -> DataFrame:
    plain, touching = _first_draws(pool, per_dataset)
    others = F.filter("_all", lambda x: ~F.array_contains("own", x["cluster_id"]))
    paired = plain.withColumn("_all", _listed(_taxonomy(pool))).select(F.explode(others).alias("c"), "dataset_id", "uid").select("c.cluster_id", "dataset_id", "uid")
    return paired.unionByName(touching)


def sampled_candidates(
    texts: DataFrame,
    per_dataset: int = NEGATIVES_PER_DATASET,
    per_positive: int = NEGATIVES_PER_POSITIVE,
    seed: int = 0,
) -> DataFrame:
    """The candidates that can be among a capability's `per_positive` per positive, in hash order.

    Counts of every capability's candidates by the leading digits of their hash give the digits up
    to which enough of them lie; candidates above are dropped where they arise, before any shuffle.
    Columns cluster_id, dataset_id, uid, _key, and the sizes n_all and n_pos.
    """
    key = draw_key(seed, F.col("cluster_id"), F.col("uid"))
    pool = materialize(_pool(texts, per_dataset, seed))
    bins = (
        _paired(pool, per_dataset).groupBy("cluster_id", hash_bucket(key).alias("_b"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    size = members(texts).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_pos"))
    group = Window.partitionBy("cluster_id")
    upto = F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    cuts = materialize(
        bins.join(size, "cluster_id")
        .withColumn("n_all", F.sum("_n").over(group))
        .withColumn("_before", upto - F.col("_n"))
        .filter(F.col("_before") < F.col("n_pos") * per_positive)
        .groupBy("cluster_id").agg(F.max("_b").alias("cut"), F.first("n_all").alias("n_all"), F.first("n_pos").alias("n_pos"))
    )
    plain, touching = _first_draws(pool, per_dataset)
    others = F.filter("_all", lambda x: (
        ~F.array_contains("own", x["cluster_id"])
        & (hash_bucket(draw_key(seed, x["cluster_id"], F.col("uid"))) <= x["cut"])))
    listed = plain.withColumn("_all", _listed(cuts, "cut", "n_all", "n_pos"))
    paired = listed.select(F.explode(others).alias("c"), "dataset_id", "uid").select("c.*", "dataset_id", "uid")
    below = touching.join(cuts, "cluster_id").filter(hash_bucket(key) <= F.col("cut"))
    return paired.unionByName(below).select("cluster_id", "dataset_id", "uid", key.alias("_key"), "n_all", "n_pos")


def negative_split(
    texts: DataFrame,
    per_dataset: int = NEGATIVES_PER_DATASET,
    per_positive: int = NEGATIVES_PER_POSITIVE,
    seed: int = 0,
) -> DataFrame:
    """E6 + E7: sampled negatives per capability with a train or test half each.

    The window below sorts little more than the rows that are kept: a number set by a capability's
    positives, which are capped per dataset.
    """
    shuffled = Window.partitionBy("cluster_id").orderBy("_key", "uid")
    n = F.least("n_all", F.col("n_pos") * per_positive)
    kept = (
        sampled_candidates(texts, per_dataset, per_positive, seed)
        .withColumn("neg_rank", F.row_number().over(shuffled))
        .withColumn("_n", n)
        .filter(F.col("neg_rank") <= F.col("_n"))
    )
    part = F.when(F.col("neg_rank") <= F.floor(F.col("_n") / 2), "train").otherwise("test")
    return kept.select("cluster_id", "dataset_id", "uid", "neg_rank", part.alias("part"))


def half_cuts(texts: DataFrame, seed: int = 0) -> DataFrame:
    """Per capability the hash up to which its texts form the training half.

    A text is in the training half when its own hash does not exceed the cut, so a
    capability's half is tested row by row, with one short row per capability to look up.
    """
    keyed = members(texts).select(
        "cluster_id", draw_key(seed, F.col("cluster_id"), F.col("uid")).alias("_key")
    ).withColumn("_b", hash_bucket(F.col("_key")))
    bins = keyed.groupBy("cluster_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("cluster_id")
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    half = F.floor(F.col("n_pos") / 2)
    # Only the bucket which holds the middle row is sorted.
    middle = (
        bins.withColumn("n_pos", F.sum("_n").over(group))
        .withColumn("_upto", F.sum("_n").over(upto))
        .filter((F.col("_upto") >= half) & (F.col("_upto") - F.col("_n") < half))
        .select("cluster_id", "_b", "n_pos", (half - F.col("_upto") + F.col("_n")).alias("_place"))
    )
    inside = Window.partitionBy("cluster_id", "_b").orderBy("_key")
    return (
        keyed.join(broadcast_if_small(middle, 128), ["cluster_id", "_b"])
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_rn") == F.col("_place"))
        .select("cluster_id", F.col("_key").alias("half_cut"), "n_pos")
    )


def folds(texts: DataFrame, min_rows: int = MIN_FOLD_ROWS) -> DataFrame:
    """Eligible (capability, held-out dataset) pairs with their sizes."""
    per_dataset = members(texts).groupBy("cluster_id", F.col("dataset_id").alias("hold")).agg(
        F.count(F.lit(1)).alias("n_test")
    )
    group = Window.partitionBy("cluster_id")
    return (
        per_dataset.withColumn("n_datasets", F.count(F.lit(1)).over(group))
        .withColumn("n_train", F.sum("n_test").over(group) - F.col("n_test"))
        .filter(
            (F.col("n_datasets") >= 2)
            & (F.col("n_train") >= min_rows)
            & (F.col("n_test") >= min_rows)
        )
        .select("cluster_id", "hold", "n_train", "n_test", "n_datasets")
    )


def fold_members(texts: DataFrame, min_rows: int = MIN_FOLD_ROWS) -> DataFrame:
    """E9 in long form: every positive of every fold, marked train or test."""
    part = F.when(F.col("dataset_id") == F.col("hold"), "test").otherwise("train")
    return (
        members(texts)
        .join(folds(texts, min_rows).select("cluster_id", "hold"), "cluster_id")
        .select("cluster_id", "hold", "uid", "dataset_id", part.alias("part"))
    )
