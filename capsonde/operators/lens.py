"""Lens probes: read hidden states as token scores and test capability words per fold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsonde.functions.arrow import matrix_of
from capsonde.functions.text import label_words
from capsonde.operators import selection as X
from capsonde.operators.tiles import each, row_tiles, share, top_per_row
from capsonde.session import BROADCAST_LIMIT, materialize

LAYER = ["tag", "layer"]
CARRIED = ["dataset_id", "clusters", "neg_train", "neg_test"]
CANDIDATE_BYTES = 64  # of one (capability, token) in a task, at most about


def lens_layers(models: DataFrame, key: str) -> DataFrame:
    """The captured depths a lens can read, all but the deepest, with their lens layer."""
    readable = F.slice("layers", F.lit(1), F.size("layers") - 1)
    return models.select(key, F.explode(readable).alias("layer")).select(
        key, "layer", (F.col("layer") - 1).alias("lens_layer")
    )


def whole_word_candidates(verbalizers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """B16, whole: words which are one ordinary token after a blank, in word order, each once."""
    words = verbalizers.select("name", F.posexplode("words").alias("word_no", "word"))
    tokens = vocabulary.filter(~F.col("is_special")).select("token_id", "text")
    return (
        words.join(tokens, F.concat(F.lit(" "), "word") == F.col("text"))
        .groupBy("name", "token_id").agg(F.min("word_no").alias("order"))
    )


def fragment_candidates(names: DataFrame, vocabulary: DataFrame, pieces: DataFrame) -> DataFrame:
    """B16, fragment: tokens which are a label word, else the word's pieces; in token order.

    `pieces` (word, token_id) lists the tokens a word breaks into, alone or after a blank.
    """
    words = names.select("name", F.explode(label_words(F.col("name"))).alias("word")).distinct()
    spelled = words.select(
        "name", "word", F.explode(F.array("word", F.concat(F.lit(" "), "word"))).alias("text")
    )
    exact = spelled.join(vocabulary.select("text", "token_id", "is_special"), "text").drop("text")
    split_up = (
        words.join(exact.select("name", "word"), ["name", "word"], "left_anti")
        .join(pieces, "word")
        .join(vocabulary.select("token_id", "is_special"), "token_id")
        .select("name", "word", "token_id", "is_special")
    )
    return (
        exact.unionByName(split_up).filter(~F.col("is_special"))
        .select("name", "token_id").distinct()
        .withColumn("order", F.col("token_id"))
    )


def candidate_coverage(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Capabilities with candidates, and the fewest, mean and most per capability."""
    counts = names.select("name").join(
        candidates.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "left"
    ).select("name", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("n") > 0).alias("covered"),
        F.min("n").alias("fewest"),
        F.avg("n").alias("mean"),
        F.max("n").alias("most"),
    )


def require_coverage(names: DataFrame, candidates: DataFrame) -> None:
    missing = names.select("name").join(candidates, "name", "left_anti").limit(20)
    uncovered = [r["name"] for r in missing.collect()]
    if uncovered:
        raise ValueError(f"capabilities without a valid candidate: {uncovered}")


@dataclass(frozen=True)
class Lens:
    """Readout of one model: one transport matrix per layer, final norm and token rows."""

    jacobians: dict[int, np.ndarray]
    unembed: np.ndarray
    token_ids: list[int]
    norm_weight: np.ndarray
    eps: float = 1e-6
    softcap: float | None = None
    zero_centered: bool = False

    def gain(self) -> np.ndarray:
        return 1.0 + self.norm_weight if self.zero_centered else self.norm_weight


def _shared_candidates(candidates: DataFrame, lens: Lens, limit: int) -> list:
    """Columns of the token rows that each capability wants, in pieces of capabilities under the limit."""
    place = {t: i for i, t in enumerate(lens.token_ids)}
    pieces = max(-(-candidates.count() * CANDIDATE_BYTES // limit), 1)

    def piece(i: int) -> dict[str, np.ndarray]:
        some = candidates.filter(F.pmod(F.xxhash64("cluster_id"), F.lit(pieces)) == i) if pieces > 1 else candidates
        table = some.select("cluster_id", "token_id").toArrow()
        wanted: dict[str, list[int]] = {}
        for cluster, token in zip(table["cluster_id"].to_pylist(), table["token_id"].to_pylist()):
            if token in place:
                wanted.setdefault(cluster, []).append(place[token])
        return {c: np.array(columns) for c, columns in wanted.items()}

    return share(candidates.sparkSession, (piece(i) for i in range(pieces)))


def token_scores(
    rows: DataFrame, lenses: dict[str, Lens], candidates: DataFrame | None = None,
    limit: int = BROADCAST_LIMIT, top: int | None = None,
) -> DataFrame:
    """F16: lens score of tokens as parallel arrays `features`, `values` beside each row.

    `lenses` is keyed by tag; rows of other models, and of layers that a lens lacks, drop out.
    Every (tag, layer) is one pass over its own rows: its transport matrix and the token rows go
    through in tiles under the limit. With `candidates` (cluster_id, token_id) a row only carries
    the tokens of capabilities it has a role in; with `top` its so many best tokens of all, best
    first, ties to the smaller id, and never more scores than a tile's beside them.
    """
    kept = [c for c in rows.columns if c != "h"]
    schema = rows.select(*kept).schema.add("features", T.ArrayType(T.IntegerType())).add(
        "values", T.ArrayType(T.DoubleType())
    )
    out = None
    for tag, lens in sorted(lenses.items()):
        spark = rows.sparkSession
        width = lens.unembed.shape[1]
        tokens = share(spark, (
            (cut.start, lens.unembed[cut], np.asarray(lens.token_ids[cut])) for cut in row_tiles(len(lens.unembed), width * 8, limit)))
        wanted = None if candidates is None else _shared_candidates(candidates, lens, limit)
        for layer, jacobian in sorted(lens.jacobians.items()):
            own = rows.filter((F.col("tag") == tag) & (F.col("layer") == layer))
            moves = share(spark, (jacobian[cut] for cut in row_tiles(len(jacobian), jacobian[0].nbytes, limit)))
            part = own.mapInArrow(_reader(moves, tokens, wanted, lens.gain(), lens.eps, lens.softcap, kept, top), schema)
            out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _reader(moves: list, tokens: list, wanted: list | None, gain: np.ndarray, eps: float, softcap: float | None, kept: list[str], top: int | None):
    roles = ["clusters", "neg_train", "neg_test"]

    def picks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows and token columns asked for, each pair once, by row and column."""
        pairs = [np.zeros((0, 2), np.int64)]
        clusters = [{c for part in row for c in part} for row in zip(*(batch[r].to_pylist() for r in roles))]
        for known in each(wanted):
            for i, row in enumerate(clusters):
                pairs += [np.column_stack([np.full(len(known[c]), i), known[c]]) for c in row if c in known]
        asked = np.unique(np.concatenate(pairs), axis=0)
        return asked[:, 0], asked[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h = matrix_of(batch["h"])
            moved = np.concatenate([h @ j.T for j in each(moves)], axis=1)
            moved = moved / np.sqrt((moved * moved).mean(axis=1, keepdims=True) + eps) * gain
            asked = picks(batch) if wanted is not None else None
            found, best = [], (np.zeros((n, 0)), np.zeros((n, 0), np.int64))
            for start, unembed, ids in each(tokens):
                logits = moved @ unembed.T
                if softcap is not None:
                    logits = softcap * np.tanh(logits / softcap)
                if top is not None:
                    both = np.concatenate([best[0], logits], axis=1), np.concatenate([best[1], np.broadcast_to(ids, logits.shape)], axis=1)
                    best = top_per_row(*both, top)
                elif asked is None:
                    found.append((np.repeat(np.arange(n), len(ids)), np.tile(ids, n), logits.ravel()))
                else:
                    here = (asked[1] >= start) & (asked[1] < start + len(ids))
                    row, column = asked[0][here], asked[1][here] - start
                    found.append((row, ids[column], logits[row, column]))
            if top is not None:
                found = [(np.repeat(np.arange(n), best[0].shape[1]), best[1].ravel(), best[0].ravel())]
            row, token, value = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(row, kind="stable")
            offsets = pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in kept]
                + [
                    pa.ListArray.from_arrays(offsets, pa.array(token[order], pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(value[order])),
                ],
                names=[*kept, "features", "values"],
            )

    return run


def lens_lobo(
    rows: DataFrame, lenses: dict[str, Lens], candidates: DataFrame, fold_table: DataFrame, split: DataFrame,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """F17/F18 per fold: the capability's best training token and its held-out AUC.

    `candidates` (cluster_id, token_id, order). Layers share one split (`split`). A capability
    with folds but without candidates is an error (D17).
    """
    require_coverage(
        fold_table.select(F.col("cluster_id").alias("name")).distinct(),
        candidates.select(F.col("cluster_id").alias("name")),
    )
    read = rows.select(*LAYER, "uid", *CARRIED, "h")
    scores = X.role_scores(materialize(token_scores(read, lenses, candidates, limit)))
    own = candidates.select("cluster_id", F.col("token_id").alias("feature"), "order")
    scores = scores.join(own.drop("order"), ["cluster_id", "feature"])
    aucs = X.train_aucs(scores, fold_table, split).join(own, ["cluster_id", "feature"])
    chosen = materialize(X.best_features(aucs, either_sign=False))
    return X.held_out_aucs(scores, chosen, fold_table, split)
