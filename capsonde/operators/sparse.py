"""Sparse-feature probes: JumpReLU encoding and the best single feature of each fold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsonde.functions.arrow import matrix_of
from capsonde.operators import selection as X
from capsonde.operators.tiles import each, row_tiles, share
from capsonde.session import BROADCAST_LIMIT, materialize

LAYER = ["tag", "layer"]
CARRIED = ["dataset_id", "clusters", "neg_train", "neg_test"]


@dataclass(frozen=True)
class Encoder:
    """Weights of one layer's encoder: input x feature matrix, bias and threshold."""

    w_enc: np.ndarray
    b_enc: np.ndarray
    threshold: np.ndarray


def encode(
    rows: DataFrame, encoders: dict[tuple[str, int], Encoder], limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """non-zero features of each row as parallel arrays, the row's other columns kept.

    `encoders` is keyed by (tag, layer); rows of other models and layers drop out. Every layer is
    one pass over its own rows, through tiles of features under the limit.
    """
    kept = [c for c in rows.columns if c != "h"]
    schema = rows.select(*kept).schema.add("features", T.ArrayType(T.IntegerType())).add(
        "values", T.ArrayType(T.DoubleType())
    )
    out = None
    for (tag, layer), e in sorted(encoders.items()):
        own = rows.filter((F.col("tag") == tag) & (F.col("layer") == layer))
        part = own.mapInArrow(_encoder(own, e, kept, limit), schema)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _encoder(rows: DataFrame, e: Encoder, kept: list[str], limit: int):
    cuts = row_tiles(e.w_enc.shape[1], e.w_enc[:, :1].nbytes, limit)
    width = e.w_enc.shape[0]
    shared = share(rows.sparkSession, ((c.start, e.w_enc[:, c], e.b_enc[c], e.threshold[c]) for c in cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = matrix_of(batch["h"])
            if h.shape[1] != width:
                raise ValueError(f"rows have {h.shape[1]} values, weights {width}")
            found = []
            for start, w, b, threshold in each(shared):
                pre = h @ w + b
                z = np.where(pre > threshold, np.maximum(pre, 0.0), 0.0)
                row, feature = np.nonzero(z > 0)
                found.append((row, feature + start, z[row, feature]))
            row, feature, value = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(row, kind="stable")
            offsets = pa.array(np.searchsorted(row[order], np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in kept]
                + [
                    pa.ListArray.from_arrays(offsets, pa.array(feature[order], pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(value[order])),
                ],
                names=[*kept, "features", "values"],
            )

    return run


def mean_l0(encoded: DataFrame) -> DataFrame:
    """Mean number of non-zero features per text."""
    return encoded.groupBy(*LAYER).agg(
        (F.sum(F.size("features")) / F.countDistinct("uid")).alias("mean_l0")
    )


def sparse_lobo(
    rows: DataFrame, encoders: dict[tuple[str, int], Encoder], fold_table: DataFrame, split: DataFrame
) -> DataFrame:
    """F14/F15 per fold: chosen feature, sign, training and held-out AUC.

    The encoding is a small part of the hidden states' size and is read twice, so it is
    written once.
    """
    encoded = materialize(encode(rows.select(*LAYER, "uid", *CARRIED, "h"), encoders))
    scores = X.role_scores(encoded)
    aucs = X.train_aucs(scores, fold_table, split)
    chosen = materialize(X.best_features(aucs, either_sign=True, absent_feature=0))
    return X.held_out_aucs(scores, chosen, fold_table, split)
