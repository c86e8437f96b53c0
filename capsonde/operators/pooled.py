"""Pooled capability vectors, their clusters, and the capability landscape."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.functions import vectors as V
from capsonde.session import materialize

LAYER = ["tag", "layer"]


def _own(moments: DataFrame) -> DataFrame:
    """Moments of each dataset's texts of one tag set, once for every capability."""
    own = moments.filter("kind = 'own'")
    return own.select(*LAYER, "dataset_id", F.explode("clusters").alias("cluster_id"), F.col("mean").alias("m"), "n")


def member_means(moments: DataFrame) -> DataFrame:
    """Mean vector of a capability's texts, from `group_moments`; no vector is read again."""
    return _own(moments).groupBy(*LAYER, "cluster_id").agg(V.vector_mean(F.col("m"), F.col("n")).alias("mean"))


def pooled_vectors(moments: DataFrame) -> DataFrame:
    """Per capability the mean over its datasets of each dataset's mean vector."""
    by_dataset = _own(moments).groupBy(*LAYER, "cluster_id", "dataset_id").agg(
        V.vector_mean(F.col("m"), F.col("n")).alias("m"))
    return by_dataset.groupBy(*LAYER, "cluster_id").agg(
        V.vector_mean(F.col("m")).alias("pooled"), F.count(F.lit(1)).alias("n_datasets")
    )


def silhouette(vectors: DataFrame, label: str, column: str = "pooled", keys: list[str] | None = None) -> DataFrame:
    """Mean silhouette under squared Euclidean distance of a labelling, per (model, layer) or other keys.

    A cluster's count, vector sum and sum of squares give the mean distance of a point to it, so no
    pairs of points are made. A point alone in its cluster counts 0, and so does a single cluster.
    """
    keys = keys or LAYER
    rows = vectors.select(*keys, "cluster_id", F.col(label).alias("_own"), F.col(column).alias("_x"))
    middle = rows.groupBy(*keys).agg(V.vector_mean(F.col("_x")).alias("_mid"))
    rows = rows.join(middle, keys).withColumn("_x", V.subtract(F.col("_x"), F.col("_mid"))).drop("_mid")
    rows = rows.withColumn("_q", V.dot(F.col("_x"), F.col("_x")))
    moments = rows.withColumnRenamed("_own", "_label").groupBy(*keys, "_label").agg(
        F.count(F.lit(1)).alias("_n"), V.vector_sum(F.col("_x")).alias("_s"), F.sum("_q").alias("_qs"))
    whole = F.col("_n") * F.col("_q") + F.col("_qs")
    total = whole - 2 * V.dot(F.col("_x"), F.col("_s"))
    total = F.when(total > 1e-12 * whole, total).otherwise(0.0)  # equal points are not apart by rounding
    same = F.col("_own") == F.col("_label")
    points = rows.join(moments, keys).groupBy(*keys, "cluster_id").agg(
        F.max(F.when(same, total / F.greatest(F.col("_n") - 1, F.lit(1)))).alias("own"),
        F.max(F.when(same, F.col("_n"))).alias("size"),
        F.min(F.when(~same, total / F.col("_n"))).alias("near"),
    )
    wide = F.greatest("own", "near")
    score = F.when((F.col("size") > 1) & (wide > 0) & F.col("near").isNotNull(), (F.col("near") - F.col("own")) / wide)
    return points.groupBy(*keys).agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("silhouette"))


def far_points(points: DataFrame, most: int) -> DataFrame:
    """(tag, layer, centre, c): points in farthest-first order, from the smallest cluster_id on.

    Each step takes the point farthest from those taken, ties to the smallest cluster_id.
    """
    state, taken = points.withColumn("gap", F.lit(float("inf"))), []
    for rank in range(most):
        state = materialize(state)
        c = F.min_by("x", F.struct(-F.col("gap"), F.col("cluster_id"))).alias("c")
        best = state.groupBy(*LAYER).agg(c)
        taken.append(best.withColumn("centre", F.lit(rank)))
        state = state.join(best, LAYER).select(
            *points.columns, F.least("gap", V.squared_distance(F.col("x"), F.col("c"))).alias("gap"))
    return reduce(DataFrame.unionByName, taken)


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Every point with the nearest centre of each k as its label, ties to the first one."""
    lists = centres.groupBy(*LAYER, "k").agg(F.collect_list(F.struct("centre", "c")).alias("centres"))  # k entries
    gaps = F.transform("centres", lambda e: F.struct(V.squared_distance(F.col("x"), e["c"]).alias("gap"), e["centre"].alias("centre")))
    return points.join(lists, LAYER).select(*LAYER, "k", "cluster_id", "x", F.array_min(gaps)["centre"].alias("label"))


def k_means(points: DataFrame, ks: Iterable[int], steps: int = 50) -> DataFrame:
    """(tag, layer, k, cluster_id, x, label): every k of every (model, layer), all in the same steps.

    The k centres start at the first points of `far_points` and move to the means of their points
    until none moves, or for so many steps; a centre without points stays. Only k below the number
    of points are tried. The centres are a stored table.
    """
    sizes = points.groupBy(*LAYER).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    ks = [k for k in ks if 1 < k < largest]
    if not ks:
        return points.select(*LAYER, F.lit(0).alias("k"), "cluster_id", "x", F.lit(0).alias("label")).limit(0)
    tried = far_points(points, max(ks)).join(sizes, LAYER).withColumn("k", F.explode(F.lit(ks)))
    centres = materialize(tried.where("centre < k AND k < n").select(*LAYER, "k", "centre", "c"))
    for _ in range(steps):
        means = nearest(points, centres).groupBy(*LAYER, "k", F.col("label").alias("centre")).agg(V.vector_mean(F.col("x")).alias("m"))
        moved = V.squared_distance(F.col("c"), F.col("m")) > 1e-20 * V.dot(F.col("c"), F.col("c"))
        both = materialize(centres.join(means, [*LAYER, "k", "centre"], "left").withColumn("moved", F.coalesce(moved, F.lit(False))))
        centres = both.select(*LAYER, "k", "centre", F.coalesce("m", "c").alias("c"))
        if both.where("moved").isEmpty():
            break
    return nearest(points, centres)


def silhouette_sweep(vectors: DataFrame, ks: Iterable[int] = range(4, 16), column: str = "pooled") -> DataFrame:
    """Silhouette of a k-means clustering of the capabilities for every (model, layer) and k.

    A k that leaves no two capabilities together has no row.
    """
    points = materialize(vectors.select(*LAYER, "cluster_id", F.col(column).alias("x")))
    return silhouette(materialize(k_means(points, ks)), "label", "x", [*LAYER, "k"])


def adjusted_rand(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency counts."""
    def choose2(n):
        n = n.cast("double")
        return n * (n - F.lit(1.0)) / F.lit(2.0)

    cells = pairs.groupBy(left, right).agg(F.count(F.lit(1)).alias("_n"))
    by_left = cells.groupBy(left).agg(F.sum("_n").alias("_a")).agg(
        F.sum(choose2(F.col("_a"))).alias("a"), F.sum("_a").alias("n")
    )
    by_right = cells.groupBy(right).agg(F.sum("_n").alias("_b")).agg(
        F.sum(choose2(F.col("_b"))).alias("b")
    )
    both = cells.agg(F.sum(choose2(F.col("_n"))).alias("index"))
    one = F.lit(1).alias("_k")
    joined = (
        both.select("*", one).join(by_left.select("*", one), "_k").join(by_right.select("*", one), "_k")
    )
    expected = F.col("a") * F.col("b") / choose2(F.col("n"))
    most = (F.col("a") + F.col("b")) / F.lit(2.0)
    return joined.select(
        F.coalesce(F.try_divide(F.col("index") - expected, most - expected), F.lit(1.0)).alias("ari")
    )


def landscape(mentions: DataFrame, min_benchmarks: int = 2) -> DataFrame:
    """Per family its mentions, concepts, clusters, and clusters with enough benchmarks.

    `mentions` (family, cluster_id, concept, benchmark).
    """
    benchmarks = (
        mentions.groupBy("family", "cluster_id", "benchmark").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("family", "cluster_id")
        .agg(F.sum("_n").alias("_n"), F.count("benchmark").alias("_b"))
    )
    clusters = benchmarks.groupBy("family").agg(
        F.sum("_n").alias("mentions"),
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("_b") >= min_benchmarks).alias("covered"),
    )
    concepts = mentions.select("family", "concept").distinct().groupBy("family").agg(
        F.count("concept").alias("concepts")
    )
    return clusters.join(concepts, "family").withColumn(
        "uncovered", F.col("clusters") - F.col("covered")
    )
