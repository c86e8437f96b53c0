"""Standardisation and diff-mean directions from one pass over the hidden states.

Folds are not materialised. One aggregation yields the moments of each dataset and the mean
of each capability's training negatives; a fold's training sum is its capability's sum minus
the held-out dataset's. Standardising is affine, so it is applied to those means and folded
into the direction: a raw vector is scored as `dot(h, w) - shift`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsonde.functions import vectors as V
from capsonde.functions.arrow import layer_slices, list_rows, matrix_of
from capsonde.functions.scalars import draw_key
from capsonde.session import broadcast_if_small

LAYER = ["tag", "layer"]
SD_FLOOR = 1e-6  # fixed value added to every standard deviation


def with_roles(
    hidden: DataFrame, texts: DataFrame, split: DataFrame, cuts: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """Hidden states joined to their text's dataset, tags and sampled roles.

    Hidden rows without a text drop out. Both tables are keyed by uid: stored bucketed by
    uid (`sources.hidden.write_bucketed`) the join moves no vector. The split is small,
    and goes in by a size-checked broadcast.
    """
    by_uid = split.groupBy("uid").agg(
        F.collect_list(F.when(F.col("part") == "train", F.col("cluster_id"))).alias("neg_train"),
        F.collect_list(F.when(F.col("part") == "test", F.col("cluster_id"))).alias("neg_test"),
    )
    none = F.array().cast("array<string>")
    roles = (
        texts.select("uid", "dataset_id", F.array_sort("clusters").alias("clusters"))
        .join(broadcast_if_small(by_uid, 128, sized_by=split), "uid", "left")
        .withColumn("neg_train", F.coalesce("neg_train", none))
        .withColumn("neg_test", F.coalesce("neg_test", none))
    )
    rows = hidden.join(roles, "uid")
    if cuts is None:
        return rows.withColumn("half", none)
    # Tested on the joined rows: below the join, Spark would infer a filter from the key.
    by_capability = cuts.agg(
        F.map_from_entries(F.collect_list(F.struct("cluster_id", "half_cut")))
    ).scalar()
    first_half = F.filter(
        "clusters",
        lambda c: draw_key(seed, c, F.col("uid")) <= F.try_element_at(F.col("_cuts"), c),
    )
    return rows.withColumn("_cuts", by_capability).withColumn("half", first_half).drop("_cuts")


GROUP = "kind string, cluster_id string, dataset_id string, clusters array<string>"
PARTIAL = "tag string, layer int, g string, n bigint, mean array<double>, var array<double>"
OPEN_GROUPS = 2048


def _groups() -> Column:
    """The groups a row belongs to, as JSON keys: its dataset and tags, and its sampled roles."""
    def entries(kind: str, column: str) -> Column:
        return F.transform(
            column,
            lambda c: F.to_json(F.struct(F.lit(kind).alias("kind"), c.alias("cluster_id"))),
        )

    own = F.to_json(F.struct(F.lit("own").alias("kind"), "dataset_id", "clusters"))
    return F.concat(
        F.array(own), entries("train", "neg_train"), entries("test", "neg_test"), entries("half", "half")
    )


class _Moments:
    """Running count, mean and squared deviations of one group."""

    def __init__(self, width: int):
        self.n, self.mean, self.m2 = 0, np.zeros(width), np.zeros(width)

    def add(self, x: np.ndarray) -> None:
        n, mean = len(x), x.mean(axis=0)
        both, gap = self.n + n, mean - self.mean
        self.m2 += ((x - mean) ** 2).sum(axis=0) + gap * gap * (self.n * n / both)
        self.mean += gap * (n / both)
        self.n = both


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of the groups of one task; far more groups than usual are emitted in between."""
    def emit(open_groups: dict) -> pa.RecordBatch:
        keys, moments = list(open_groups), list(open_groups.values())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.string()),
                pa.array([m.n for m in moments], pa.int64()),
                pa.array([m.mean for m in moments], pa.list_(pa.float64())),
                pa.array([m.m2 / m.n for m in moments], pa.list_(pa.float64())),
            ],
            names=["tag", "layer", "g", "n", "mean", "var"],
        )

    open_groups: dict[tuple, _Moments] = {}
    for batch in batches:
        for key, part in layer_slices(batch):
            h = matrix_of(part["h"])
            row, groups = list_rows(part["groups"])
            groups = groups.dictionary_encode()
            code = groups.indices.to_numpy()
            by_group = np.argsort(code, kind="stable")
            row, code = row[by_group], code[by_group]
            used, start = np.unique(code, return_index=True)
            for c, lo, hi in zip(used, start, [*start[1:], len(row)]):
                name = (*key, groups.dictionary[int(c)].as_py())
                if name not in open_groups:
                    open_groups[name] = _Moments(h.shape[1])
                open_groups[name].add(h[row[lo:hi]])
        if len(open_groups) > OPEN_GROUPS:
            yield emit(open_groups)
            open_groups.clear()
    if open_groups:
        yield emit(open_groups)


def group_moments(rows: DataFrame) -> DataFrame:
    """Count, mean and population variance of every group the directions need.

    kind `own`: a dataset's texts of one tag set; `train`, `test`: a capability's sampled
    negatives; `half`: the training half of its positives. A vector crosses to Python once
    and feeds its own group once however many tags it has; a task's partial moments, one row
    per group, are all that is shuffled.
    """
    partial = rows.select(*LAYER, _groups().alias("groups"), "h").mapInArrow(
        _partial_moments, PARTIAL
    )
    second = F.zip_with("var", "mean", lambda v, m: v + m * m)
    merged = partial.groupBy(*LAYER, "g").agg(
        F.sum("n").alias("n"),
        V.vector_mean(F.col("mean"), F.col("n")).alias("mean"),
        V.vector_mean(second, F.col("n")).alias("_second"),
    )
    variance = F.zip_with("_second", "mean", lambda q, m: F.greatest(q - m * m, F.lit(0.0)))
    return merged.select(
        *LAYER, F.from_json("g", GROUP).alias("g"), "n", "mean", variance.alias("var")
    ).select(*LAYER, "g.*", "n", "mean", "var")


def standardiser(moments: DataFrame) -> DataFrame:
    """Mean and floored population deviation per (model, layer) over all texts."""
    own = moments.filter(F.col("kind") == "own")
    centre = own.groupBy(*LAYER).agg(V.vector_mean(F.col("mean"), F.col("n")).alias("mu"))
    # Spread within a group plus the group mean's distance from the overall mean.
    spread = F.zip_with(
        "var", V.subtract(F.col("mean"), F.col("mu")), lambda v, d: v + d * d
    )
    return (
        own.join(centre, LAYER)
        .groupBy(*LAYER)
        .agg(
            F.first("mu").alias("mu"),
            V.vector_mean(spread, F.col("n")).alias("_var"),
            F.sum("n").alias("n_rows"),
        )
        .select(
            *LAYER, "mu",
            F.transform("_var", lambda x: F.sqrt(x) + F.lit(SD_FLOOR)).alias("sd"),
            "n_rows",
        )
    )


def _capability_sums(moments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positive (n, sum) per (capability, dataset) and per capability."""
    own = (
        moments.filter(F.col("kind") == "own")
        .select(
            *LAYER, F.explode("clusters").alias("cluster_id"), F.col("dataset_id").alias("hold"),
            "n", V.scale(F.col("mean"), F.col("n")).alias("total"),
        )
        .groupBy(*LAYER, "cluster_id", "hold")
        .agg(F.sum("n").alias("n"), V.vector_sum(F.col("total")).alias("total"))
    )
    whole = own.groupBy(*LAYER, "cluster_id").agg(
        F.sum("n").alias("n_all"), V.vector_sum(F.col("total")).alias("total_all")
    )
    return own, whole


def _oriented(pairs: DataFrame, scaling: DataFrame, pos: Column, neg: Column) -> DataFrame:
    """Unit direction in standardised space, with the raw-space weights and shift."""
    gap = V.divide(V.subtract(pos, neg), F.col("sd"))
    return (
        pairs.join(scaling.select(*LAYER, "mu", "sd"), LAYER)
        .withColumn("v", V.unit(gap))
        .withColumn("w", V.divide(F.col("v"), F.col("sd")))
        .withColumn("shift", V.dot(F.col("mu"), F.col("w")))
        .select(*LAYER, "kind", "cluster_id", "hold", "v", "w", "shift")
    )


def diff_mean_directions(
    moments: DataFrame, fold_table: DataFrame, kinds: tuple[str, ...] = ("lobo",)
) -> DataFrame:
    """directions (tag, layer, kind, cluster_id, hold, v, w, shift).

    lobo: without the held-out dataset, against the training negatives;
    full: all positives, against the training negatives;
    within: the training half of the positives, against the training negatives;
    spec: all positives, against all sampled negatives (H3).
    """
    scaling = standardiser(moments)
    own, whole = _capability_sums(moments)
    neg = moments.filter(F.col("kind") == "train").select(
        *LAYER, "cluster_id", F.col("n").alias("n_neg"), F.col("mean").alias("neg")
    )
    no_hold = F.lit(None).cast("string").alias("hold")
    out = []
    if "lobo" in kinds:
        pairs = (
            own.join(fold_table.select("cluster_id", "hold"), ["cluster_id", "hold"])
            .join(whole, [*LAYER, "cluster_id"])
            .join(neg, [*LAYER, "cluster_id"])
            .withColumn("_n", F.col("n_all") - F.col("n"))
            .withColumn("kind", F.lit("lobo"))
        )
        held_in = V.subtract(F.col("total_all"), F.col("total"))
        pos = F.transform(held_in, lambda x: x / F.col("_n"))
        out.append(_oriented(pairs, scaling, pos, F.col("neg")))
    if "full" in kinds:
        pairs = whole.join(neg, [*LAYER, "cluster_id"]).select("*", F.lit("full").alias("kind"), no_hold)
        pos = F.transform("total_all", lambda x: x / F.col("n_all"))
        out.append(_oriented(pairs, scaling, pos, F.col("neg")))
    if "within" in kinds:
        half = moments.filter(F.col("kind") == "half").select(
            *LAYER, "cluster_id", F.col("mean").alias("pos")
        )
        pairs = half.join(neg, [*LAYER, "cluster_id"]).select("*", F.lit("within").alias("kind"), no_hold)
        out.append(_oriented(pairs, scaling, F.col("pos"), F.col("neg")))
    if "spec" in kinds:
        both = (
            moments.filter(F.col("kind").isin("train", "test"))
            .groupBy(*LAYER, "cluster_id")
            .agg(V.vector_mean(F.col("mean"), F.col("n")).alias("neg"))
        )
        pairs = whole.join(both, [*LAYER, "cluster_id"]).select("*", F.lit("spec").alias("kind"), no_hold)
        pos = F.transform("total_all", lambda x: x / F.col("n_all"))
        out.append(_oriented(pairs, scaling, pos, F.col("neg")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def standardise(hidden: DataFrame, texts: DataFrame) -> DataFrame:
    """standardised vectors `z`, for callers who need them materialised.

    The probes never do: they standardise the direction instead.
    """
    none = texts.sparkSession.createDataFrame([], "cluster_id string, uid string, part string")
    rows = with_roles(hidden, texts, none)
    scaling = standardiser(group_moments(rows)).select(*LAYER, "mu", "sd")
    z = V.divide(V.subtract(F.col("h"), F.col("mu")), F.col("sd"))
    return rows.join(broadcast_if_small(scaling, 1 << 18), LAYER).select(
        *LAYER, "uid", "dataset_id", "clusters", z.alias("z")
    )
