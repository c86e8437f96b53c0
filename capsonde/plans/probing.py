"""Probe sweep of a set of models: all layers, then the best layer of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.functions.scalars import round_binary, tier
from capsonde.operators import directions as D
from capsonde.operators import linear_probes as M
from capsonde.operators import lobo as L
from capsonde.operators import reports as R
from capsonde.operators import sampling as S
from capsonde.session import materialize

LAYER = ["tag", "layer"]


@dataclass(frozen=True)
class Sweep:
    """cells: one row per (model, layer, capability); folds: one per held-out dataset;
    best: one per model; results: one per (model, capability) at the model's best layer."""

    cells: DataFrame
    folds: DataFrame
    best: DataFrame
    results: DataFrame
    suspects: DataFrame


def at_layers(df: DataFrame, best: DataFrame) -> DataFrame:
    """Rows of each model's best layer. Models are few, so their layers become a literal
    filter, which prunes partitions of a table stored by (tag, layer)."""
    chosen = None
    for r in best.select("tag", "best_layer").collect():
        one = (F.col("tag") == r["tag"]) & (F.col("layer") == r["best_layer"])
        chosen = one if chosen is None else chosen | one
    return df.filter(chosen if chosen is not None else F.lit(False))


def layer_sweep(protocol: L.Protocol) -> tuple[DataFrame, DataFrame]:
    """Fold AUCs, and cells with within, LOBO and length scores rounded as published.

    All scores come from one scan of the hidden states and are written once.
    """
    scores = materialize(protocol.scores("lobo", "within", "full"))
    aucs = materialize(protocol.aucs("lobo", "within", scores=scores))
    folds = aucs.filter("kind = 'lobo' AND auc IS NOT NULL").drop("kind")
    within = aucs.filter("kind = 'within'").drop("kind", "hold")
    lengths = L.length_confound(protocol, scores).select(
        *LAYER, "cluster_id", round_binary(F.col("len_r")).alias("len_r")
    )
    cells = (
        R.layer_cells(L.fold_summary(folds), within)
        .join(lengths, [*LAYER, "cluster_id"], "left")
        .join(S.dataset_counts(protocol.texts), "cluster_id")
    )
    return folds, cells


def sweep(
    hidden: DataFrame, texts: DataFrame, per_dataset: int = S.NEGATIVES_PER_DATASET, seed: int = 0
) -> Sweep:
    protocol = L.Protocol(
        hidden, texts, ("lobo", "within", "full", "spec"), per_dataset=per_dataset, seed=seed
    )
    folds, cells = layer_sweep(protocol)
    cells = materialize(cells)
    best = R.best_layer(cells)

    at_best = at_layers(protocol.rows, best)
    lr = M.lobo_methods(protocol, D.standardiser(protocol.moments), ("lr",), at_best)
    lobo_lr = lr.groupBy(*LAYER, "cluster_id").agg(round_binary(F.avg("auc")).alias("lobo_lr"))
    ranks = L.spec_rank(materialize(L.transfer_matrix(protocol, lambda df: at_layers(df, best))))
    results = (
        at_layers(cells, best)
        .join(lobo_lr, [*LAYER, "cluster_id"], "left")
        .join(ranks, [*LAYER, "cluster_id"], "left")
        .withColumn("tier", tier(F.col("lobo_med")))
    )
    folds_at_best = at_layers(folds, best)
    return Sweep(
        cells=cells,
        folds=folds,
        best=best,
        results=results,
        suspects=L.suspects(folds_at_best, at_layers(cells, best)),
    )
