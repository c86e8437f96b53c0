"""PCA and logistic directions under the leave-one-dataset-out protocol of F6.

Vectors are standardised and packed once, where they are, into blocks of one (model, layer,
capability); no vector is shuffled, whatever the number of folds, and every training row counts.

PCA needs only second moments. They add up: a fold's matrix is its capability's minus the held-out
dataset's, so one pass emits tiles of one matrix per dataset and the folds are differences of tiles.
Logistic fits of all folds run together: each pass over the blocks emits every fold's loss and
gradient, partial sums per task, and a stored table of one row per fold holds weights and the last
steps, from which a limited-memory quasi-Newton step follows. Folds that are done take no more part.
Diff-mean is F6's own direction, which needs nothing beyond the moments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsonde.functions import vectors as V
from capsonde.functions.arrow import layer_slices, matrix_of
from capsonde.operators import lobo as L
from capsonde.operators.auc import rank_sum_auc
from capsonde.operators.scoring import layer_blocks, unite
from capsonde.session import BROADCAST_LIMIT, materialize, scratch_path

LAYER = ["tag", "layer"]
GROUP = [*LAYER, "cluster_id"]
FOLD = [*GROUP, "hold"]
METHODS = ("diffmean", "pca", "lr")

# Fixed values of the protocol.
PCA_K = 10
LR_C = 0.1
LR_MAX_ITER = 300

LR_TOL = 1e-4  # largest entry of the gradient at which a fit is done
MEMORY = 8  # steps that a fit remembers
ROWS = 1024  # of one block
TILE = 512  # rows and columns of one tile
OPEN_BYTES = 512 << 20  # matrices that a task holds at once
TRAIN, TEST, POSITIVE = 0, 1, 2

BLOCKS = "tag string, layer int, cluster_id string, n int, z binary, role binary, code binary, datasets array<string>"


def protocol_blocks(rows: DataFrame, scaling: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Standardised rows of each capability in blocks: members, training and test negatives.

    A task sorts its own rows by capability and packs them; nothing is exchanged. Means and
    deviations go to the tasks by whole (model, layer)s under the limit.
    """
    def entries(role: int, column: str):
        return F.transform(column, lambda c: F.struct(c.alias("cluster_id"), F.lit(role).alias("role")))

    roles = F.concat(entries(POSITIVE, "clusters"), entries(TRAIN, "neg_train"), entries(TEST, "neg_test"))
    each = rows.select(*LAYER, "dataset_id", "h", F.inline(roles))
    parts = (_packed(*b) for b in layer_blocks(each, scaling.select(*LAYER, "sd", F.col("mu").alias("w")), limit))
    packed = unite(parts, rows, BLOCKS)
    path = scratch_path(rows.sparkSession, "protocol-blocks")
    packed.write.partitionBy(*LAYER).parquet(path)
    return rows.sparkSession.read.schema(BLOCKS).parquet(path)


def _packed(rows: DataFrame, scaling: DataFrame) -> DataFrame:
    table = scaling.toArrow()
    keys = zip(table["tag"].to_pylist(), table["layer"].to_pylist(), strict=True)
    known = dict(zip(keys, zip(*([x.values.to_numpy() for x in table[c]] for c in ("w", "sd")), strict=True), strict=True))
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def block(key: tuple, held: list) -> pa.RecordBatch:
        z = np.concatenate([x[0] for x in held])
        names: dict[str, int] = {}
        code = np.concatenate([[names.setdefault(d, len(names)) for d in x[2]] for x in held]).astype(np.int32)
        return pa.RecordBatch.from_pylist([{
            "tag": key[0], "layer": key[1], "cluster_id": key[2], "n": len(z), "z": z.tobytes(),
            "role": np.concatenate([x[1] for x in held]).astype(np.int8).tobytes(), "code": code.tobytes(), "datasets": list(names),
        }], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for layer, part in layer_slices(batch):
                mu, sd = shared.value[layer]
                z = (matrix_of(part["h"]) - mu) / sd
                role = part["role"].to_numpy()
                dataset = part["dataset_id"].to_pylist()
                cluster = part["cluster_id"].dictionary_encode()
                code = cluster.indices.to_numpy()
                for c in dict.fromkeys(code.tolist()):
                    at = np.flatnonzero(code == c)
                    key = (*layer, cluster.dictionary[c].as_py())
                    if current != key:
                        if held:
                            yield block(current, held)
                        current, held = key, []
                    for lo in range(0, len(at), ROWS):
                        some = at[lo : lo + ROWS]
                        held.append((z[some], role[some], [dataset[i] for i in some]))
                        if sum(len(x[0]) for x in held) >= ROWS:
                            yield block(current, held)
                            held = []
        if held:
            yield block(current, held)

    schema = pa.schema([
        ("tag", pa.string()), ("layer", pa.int32()), ("cluster_id", pa.string()), ("n", pa.int32()), ("z", pa.binary()),
        ("role", pa.binary()), ("code", pa.binary()), ("datasets", pa.list_(pa.string()))])
    ordered = rows.sortWithinPartitions(*GROUP)
    return ordered.select(*GROUP, "role", "dataset_id", "h").mapInArrow(run, BLOCKS)


class Block:
    """One row of `protocol_blocks` as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.layer = (batch["tag"][i].as_py(), batch["layer"][i].as_py())
        self.cluster = batch["cluster_id"][i].as_py()
        self.z = np.frombuffer(batch["z"][i].as_py(), np.float64).reshape(batch["n"][i].as_py(), -1)
        self.role = np.frombuffer(batch["role"][i].as_py(), np.int8)
        self.code = np.frombuffer(batch["code"][i].as_py(), np.int32)
        self.datasets = batch["datasets"][i].as_py()

    def held(self, hold: str) -> np.ndarray:
        """Members of the dataset a fold leaves out."""
        code = self.datasets.index(hold) if hold in self.datasets else -1
        return (self.role == POSITIVE) & (self.code == code)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i)


# -- second moments and PCA ---------------------------------------------------------------------

TILES = "tag string, layer int, cluster_id string, dataset_id string, ti int, tj int, cells array<double>"


def product_tiles(blocks: DataFrame, tile: int = TILE, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """Sums of [z, 1][z, 1]' of each capability's members per dataset, and of its training negatives
    (dataset null), in the upper tiles of the matrix. The sums of partial tiles are tiles."""

    def emit(key: tuple, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = range(0, len(matrix), tile)
        for i, a in enumerate(cuts):
            for j, b in enumerate(cuts):
                if j >= i:
                    cells = matrix[a : a + tile, b : b + tile].ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([key[2]]), pa.array([key[3]], pa.string()),
                         pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([cells], pa.list_(pa.float64()))],
                        ["tag", "layer", "cluster_id", "dataset_id", "ti", "tj", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in _blocks(batches):
            z = np.column_stack([b.z, np.ones(len(b.z))])
            groups = [(d, (b.role == POSITIVE) & (b.code == i)) for i, d in enumerate(b.datasets)] + [(None, b.role == TRAIN)]
            for dataset, mask in groups:
                if mask.any():
                    key = (*b.layer, b.cluster, dataset)
                    part = z[mask].T @ z[mask]
                    held[key] = held[key] + part if key in held else part
            while sum(m.nbytes for m in held.values()) > open_bytes:
                key = next(iter(held))
                yield from emit(key, held.pop(key))
        for key, matrix in held.items():
            yield from emit(key, matrix)

    partial = blocks.mapInArrow(run, TILES)
    return partial.groupBy(*GROUP, "dataset_id", "ti", "tj").agg(V.vector_sum(F.col("cells")).alias("cells"))


def fold_tiles(tiles: DataFrame, fold_table: DataFrame) -> DataFrame:
    """Training matrices of all folds: everything of a capability less the held-out dataset's members."""
    place = [*GROUP, "ti", "tj"]
    whole = tiles.groupBy(*place).agg(V.vector_sum(F.col("cells")).alias("whole"))
    own = tiles.withColumnRenamed("dataset_id", "hold").join(fold_table.select("cluster_id", "hold"), ["cluster_id", "hold"])
    return own.join(whole, place).select(*FOLD, "ti", "tj", V.subtract(F.col("whole"), F.col("cells")).alias("cells"))


AXES = "tag string, layer int, cluster_id string, hold string, axis int, size double, v array<double>, n_fit long, residual double"


def principal_axes(tiles: DataFrame, k: int = PCA_K) -> DataFrame:
    """The k leading axes of each fold from its own matrix, a group of fixed size whatever the rows."""

    def fit(key, group):
        placed = {
            (i, j): np.array(c) for i, j, c in zip(
                group["ti"].to_pylist(), group["tj"].to_pylist(), (c.values.to_numpy() for c in group["cells"]), strict=True)}
        last = max(i for i, _ in placed)
        corner = int(round(len(placed[last, last]) ** 0.5))
        edge = len(placed[0, last]) // corner if last else corner
        width = edge * last + corner
        s = np.zeros((width, width))
        for (i, j), cells in placed.items():
            a, b = i * edge, j * edge
            cells = cells.reshape(min(edge, width - a), -1)
            s[a : a + cells.shape[0], b : b + cells.shape[1]] = cells
            s[b : b + cells.shape[1], a : a + cells.shape[0]] = cells.T
        n = int(round(s[-1, -1]))
        some = min(k, n - 1, width - 1)
        mean = s[:-1, -1] / max(n, 1)
        c = s[:-1, :-1] - n * np.outer(mean, mean)
        size, axes = np.linalg.eigh(c)
        size, axes = size[::-1][: max(some, 0)], axes[:, ::-1][:, : max(some, 0)]
        gap = np.abs(c @ axes - axes * size).max(axis=0) / max(size.max(initial=0), 1e-300) if some > 0 else []
        m = max(some, 0)
        keys = {name: pa.array([x.as_py()] * m, x.type) for name, x in zip(FOLD, key, strict=True)}
        return pa.table(keys | {
            "axis": pa.array(range(m), pa.int32()), "size": pa.array(size, pa.float64()),
            "v": pa.array(list(axes.T), pa.list_(pa.float64())), "n_fit": pa.array([n] * m, pa.int64()),
            "residual": pa.array(gap, pa.float64())})

    return tiles.groupBy(*FOLD).applyInArrow(fit, AXES)


def _shared(directions: DataFrame):
    """Weights of each (tag, layer) by capability, as plain arrays; `layer_blocks` bounds their size."""
    table = directions.select(*FOLD, "dir_id", "w").toArrow()
    out: dict[tuple, dict[str, list]] = {}
    for tag, layer, cluster, hold, dir_id, w in zip(
        *(table[c].to_pylist() for c in (*FOLD, "dir_id")), (w.values.to_numpy() for w in table["w"]), strict=True):
        out.setdefault((tag, layer), {}).setdefault(cluster, []).append((hold, dir_id, w))
    packed = {
        layer: {c: ([x[0] for x in some], np.array([x[1] for x in some]), np.array([x[2] for x in some])) for c, some in by.items()}
        for layer, by in out.items()}
    return directions.sparkSession.sparkContext.broadcast(packed)


SCORES = "dir_id long, held boolean, positive boolean, score double"


def score_blocks(blocks: DataFrame, directions: DataFrame, parts: tuple[bool, ...] = (True,), limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(dir_id, held, positive, score): every direction's held-out rows and, where `parts` asks, its training rows."""

    def scored(blocks: DataFrame, directions: DataFrame) -> DataFrame:
        shared = _shared(directions)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _blocks(batches):
                holds, ids, weights = shared.value.get(b.layer, {}).get(b.cluster, ((), None, None))
                if not len(holds):
                    continue
                products = b.z @ weights.T
                outside = {h: b.held(h) for h in set(holds)}
                for held in parts:
                    for hold, dir_id, score in zip(holds, ids, products.T, strict=True):
                        out = outside[hold]
                        mask = out | (b.role == TEST) if held else (b.role == TRAIN) | ((b.role == POSITIVE) & ~out)
                        n = int(mask.sum())
                        if n:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, dir_id), pa.int64()), pa.array(np.full(n, held)),
                                 pa.array(b.role[mask] == POSITIVE), pa.array(score[mask])], ["dir_id", "held", "positive", "score"])

        return blocks.mapInArrow(run, SCORES)

    return unite((scored(*b) for b in layer_blocks(blocks, directions, limit)), blocks, SCORES)


def pca_directions(blocks: DataFrame, fold_table: DataFrame, k: int = PCA_K, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(fold, v, n_fit, residual, auc): of each fold's k axes the one which separates the training
    rows best, the larger first in a tie, turned to the positives, and its held-out AUC.

    `residual` is how far v is from solving its eigenvalue equation, relative to the largest
    eigenvalue. A fold whose training rows have one label has no direction.
    """
    axes = principal_axes(fold_tiles(product_tiles(blocks), fold_table), k)
    numbered = materialize(axes.withColumnRenamed("v", "w").withColumn("dir_id", F.monotonically_increasing_id()))
    scores = score_blocks(blocks, numbered, (False, True), limit)
    aucs = rank_sum_auc(scores, ["dir_id", "held"], "score", "positive").groupBy("dir_id").agg(
        F.max(F.when(~F.col("held"), F.col("auc"))).alias("train"), F.max(F.when(F.col("held"), F.col("auc"))).alias("test"))
    a = F.col("train")
    best = F.max(F.when(a.isNotNull(), F.struct(F.greatest(a, 1 - a).alias("s"), (-F.col("axis")).alias("o"), "dir_id", "train", "test")))
    chosen = numbered.select(*FOLD, "axis", "dir_id").join(aucs, "dir_id").groupBy(*FOLD).agg(best.alias("c")).select("c.*")
    turned = F.when(F.col("train") >= 0.5, 1.0).otherwise(-1.0)
    return numbered.join(chosen.drop("s", "o"), "dir_id").select(
        *FOLD, V.scale(F.col("w"), turned).alias("v"), "n_fit", "residual",
        F.when(F.col("train") >= 0.5, F.col("test")).otherwise(1 - F.col("test")).alias("auc"))


# -- logistic fits ------------------------------------------------------------------------------

SUMS = "tag string, layer int, cluster_id string, hold string, loss double, n_pos long, n_neg long, slope array<double>"
STATE = (
    "tag string, layer int, cluster_id string, hold string, dir_id long, w array<double>, best array<double>, loss double, "
    "slope array<double>, steps array<array<double>>, turns array<array<double>>, size double, n_fit long, passes int, gap double, done boolean")


def layer_groups(directions: DataFrame, limit: int) -> list[tuple[Column, Column]]:
    """Filters on blocks and on directions: whole (model, layer)s whose `w` stay under the limit
    together; a layer above it alone comes in parts of its directions."""
    sizes = directions.groupBy(*LAYER).agg(F.sum(F.size("w")).alias("n")).orderBy(*LAYER).collect()
    out, total = [], limit + 1
    for r in sizes:
        one, size = (F.col("tag") == r["tag"]) & (F.col("layer") == r["layer"]), r["n"] * 8
        of = -(-size // max(limit, 1))
        total += size
        if of > 1:
            out += [(one, one & (F.pmod(F.xxhash64("dir_id"), F.lit(of)) == i)) for i in range(of)]
            total = limit + 1
        elif total > limit:
            out.append((one, one))
            total = size
        else:
            out[-1] = (out[-1][0] | one, out[-1][1] | one)
    return out


def _loss_sums(blocks: DataFrame, shared, c: float) -> DataFrame:
    """Partial loss and gradient of every fold at its trial weights, one row per task and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for b in _blocks(batches):
            holds, _, weights = shared.value.get(b.layer, {}).get(b.cluster, ((), None, None))
            if not len(holds):
                continue
            margins = b.z @ weights[:, :-1].T + weights[:, -1]
            side = np.where(b.role == POSITIVE, 1.0, -1.0)[:, None]
            fits = np.column_stack([(b.role == TRAIN) | ((b.role == POSITIVE) & ~b.held(h)) for h in holds])
            losses = c * np.where(fits, np.logaddexp(0.0, -side * margins), 0.0).sum(axis=0)
            pull = np.where(fits, -c * side * 0.5 * (1.0 - np.tanh(0.5 * side * margins)), 0.0)
            slopes = np.column_stack([pull.T @ b.z, pull.sum(axis=0)])
            positive = fits & (side > 0)
            for i, hold in enumerate(holds):
                key = (*b.layer, b.cluster, hold)
                have = sums.setdefault(key, [0.0, 0, 0, np.zeros(slopes.shape[1])])
                have[0] += losses[i]
                have[1] += int(positive[:, i].sum())
                have[2] += int(fits[:, i].sum() - positive[:, i].sum())
                have[3] += slopes[i]
        if sums:
            yield pa.RecordBatch.from_pylist(
                [dict(zip((*FOLD, "loss", "n_pos", "n_neg", "slope"), (*k, *v), strict=True)) for k, v in sums.items()], pa.schema([
                    *[(n, pa.int32() if n == "layer" else pa.string()) for n in FOLD],
                    ("loss", pa.float64()), ("n_pos", pa.int64()), ("n_neg", pa.int64()), ("slope", pa.list_(pa.float64()))]))

    return blocks.mapInArrow(run, SUMS)


def next_trial(row: dict, c: float, tol: float, max_iter: int) -> dict:
    """A fold's state after a pass: `at`, `loss_sum` and `slope_sum` belong to the trial weights `w`.

    A trial that does not lower the loss enough is taken half as far from `best`; else it becomes
    `best`, and the step from it comes from the last MEMORY differences of weights and gradients.
    """
    w, best = np.array(row["w"]), np.array(row["best"])
    ridge = np.append(np.ones(len(w) - 1), 0.0)
    loss = row["loss_sum"] + 0.5 * (ridge * w) @ w
    slope = np.array(row["slope_sum"]) + ridge * w
    first = row["loss"] is None
    old = None if first else np.array(row["slope"])
    out = dict(row, passes=row["passes"] + 1)
    one_label = not row["n_pos"] or not row["n_neg"]
    moved = w - best
    if not first and loss > row["loss"] + 1e-4 * (old @ moved) + 1e-12 * abs(row["loss"]) and row["size"] > 1e-8:
        out.update(w=(best + 0.5 * moved).tolist(), size=row["size"] * 0.5)
    else:
        steps, turns = [np.array(x) for x in row["steps"]], [np.array(x) for x in row["turns"]]
        if not first and moved @ (slope - old) > 1e-300:
            steps, turns = [*steps, moved][-MEMORY:], [*turns, slope - old][-MEMORY:]
        step, back = slope.copy(), []
        for s, t in zip(steps[::-1], turns[::-1], strict=True):
            back.append((s @ step) / (s @ t))
            step -= back[-1] * t
        # Standardised columns have a mean square near one, so the curvature is at most about c n / 4.
        step *= (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1]) if steps else 1.0 / (1.0 + 0.25 * c * (row["n_pos"] + row["n_neg"]))
        for s, t, a in zip(steps, turns, back[::-1], strict=True):
            step += s * (a - (t @ step) / (s @ t))
        gap = float(np.abs(slope).max())
        out.update(
            best=w.tolist(), loss=float(loss), slope=slope.tolist(), steps=[s.tolist() for s in steps],
            turns=[t.tolist() for t in turns], w=(w - step).tolist(), size=1.0, gap=gap,
            done=gap < tol or (not first and row["size"] <= 1e-8))
    out.update(n_fit=row["n_pos"] + row["n_neg"], done=bool(out["done"] or one_label or out["passes"] >= max_iter))
    if one_label:
        out["gap"] = None
    return out


def _advanced(state: DataFrame, sums: DataFrame, c: float, tol: float, max_iter: int) -> DataFrame:
    names = [f.split()[0] for f in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r if r["done"] else next_trial(r, c, tol, max_iter) for r in batch.to_pylist()]
            schema = pa.schema([batch.schema.field(n) for n in names])
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)

    whole = sums.groupBy(*FOLD).agg(
        F.sum("loss").alias("loss_sum"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), V.vector_sum(F.col("slope")).alias("slope_sum"))
    return state.join(whole, FOLD, "left").mapInArrow(run, STATE)


def logistic_directions(
    blocks: DataFrame, fold_table: DataFrame, c: float = LR_C, max_iter: int = LR_MAX_ITER, tol: float = LR_TOL,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """(fold, v, intercept, n_fit, gap, passes): L2-penalised logistic fits with a free intercept.

    `gap` is the largest entry of the gradient over all training rows at v; the fit is done below
    `tol`. A fold whose training rows have one label has no direction.
    """
    width = F.max(F.octet_length("z") / (F.col("n") * 8)).cast("int")
    groups = materialize(blocks.groupBy(*GROUP).agg(width.alias("d")))
    zero, none = F.array_repeat(F.lit(0.0), F.col("d") + 1), F.lit(None)
    fresh = groups.join(fold_table.select("cluster_id", "hold"), "cluster_id").select(
        *FOLD, F.monotonically_increasing_id().alias("dir_id"), zero.alias("w"), zero.alias("best"), none.cast("double").alias("loss"),
        none.cast("array<double>").alias("slope"), F.array().cast("array<array<double>>").alias("steps"),
        F.array().cast("array<array<double>>").alias("turns"), F.lit(1.0).alias("size"), F.lit(0).cast("long").alias("n_fit"),
        F.lit(0).alias("passes"), none.cast("double").alias("gap"), F.lit(False).alias("done"))
    state = materialize(fresh)
    layers = layer_groups(state, limit)
    while True:
        open_ = ((some, _shared(state.filter(of).filter("NOT done"))) for some, of in layers)
        parts = [_loss_sums(blocks.filter(some), shared, c) for some, shared in open_ if shared.value]
        if not parts:
            break
        state = materialize(_advanced(state, unite(iter(parts), blocks, SUMS), c, tol, max_iter))
    fitted = state.filter(F.col("gap").isNotNull())
    weights = F.slice("best", F.lit(1), F.size("best") - 1)
    return fitted.select(*FOLD, weights.alias("v"), F.element_at("best", -1).alias("intercept"), "n_fit", "gap", "passes")


# -- checks over all rows -----------------------------------------------------------------------

CHECK = "tag string, layer int, cluster_id string, hold string, n long, turned array<double>, total array<double>"


def axis_residuals(blocks: DataFrame, directions: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(fold, n_rows, residual): how far each fold's v is from an eigenvector of the covariance of
    all its training rows, relative to its eigenvalue; a scan of its own, without any matrix."""

    def summed(blocks: DataFrame, directions: DataFrame) -> DataFrame:
        shared = _shared(directions)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, list] = {}
            for b in _blocks(batches):
                holds, _, weights = shared.value.get(b.layer, {}).get(b.cluster, ((), None, None))
                for hold, w in zip(holds, weights if len(holds) else (), strict=True):
                    z = b.z[(b.role == TRAIN) | ((b.role == POSITIVE) & ~b.held(hold))]
                    have = sums.setdefault((*b.layer, b.cluster, hold), [0, np.zeros(len(w)), np.zeros(len(w))])
                    have[0] += len(z)
                    have[1] += z.T @ (z @ w)
                    have[2] += z.sum(axis=0)
            for key, (n, turned, total) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32() if i == 1 else pa.string()) for i, k in enumerate(key)]
                    + [pa.array([n], pa.int64()), pa.array([turned], pa.list_(pa.float64())), pa.array([total], pa.list_(pa.float64()))],
                    [*FOLD, "n", "turned", "total"])

        return blocks.mapInArrow(run, CHECK)

    named = materialize(directions.select(*FOLD, F.col("v").alias("w"), F.monotonically_increasing_id().alias("dir_id")))
    sums = unite((summed(*b) for b in layer_blocks(blocks, named, limit)), blocks, CHECK).groupBy(*FOLD).agg(
        F.sum("n").alias("n_rows"), V.vector_sum(F.col("turned")).alias("turned"), V.vector_sum(F.col("total")).alias("total"))
    shift = V.dot(F.col("total"), F.col("w")) / F.col("n_rows")
    image = V.subtract(F.col("turned"), V.scale(F.col("total"), shift))
    off = F.array_max(F.zip_with("image", "w", lambda a, b: F.abs(a - F.col("size") * b)))
    return (
        sums.join(named, FOLD).withColumn("image", image).withColumn("size", V.dot(F.col("image"), F.col("w")))
        .select(*FOLD, "n_rows", (off / F.col("size")).alias("residual"))
    )


def logistic_gradients(blocks: DataFrame, fitted: DataFrame, c: float = LR_C, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(fold, n_rows, gap): the largest entry of the gradient of each fit over all its training rows."""
    state = materialize(fitted.select(
        *FOLD, F.concat("v", F.array("intercept")).alias("w"), F.monotonically_increasing_id().alias("dir_id")))
    parts = (_loss_sums(blocks.filter(some), _shared(state.filter(of)), c) for some, of in layer_groups(state, limit))
    sums = unite(parts, blocks, SUMS).groupBy(*FOLD).agg(
        F.sum(F.col("n_pos") + F.col("n_neg")).alias("n_rows"), V.vector_sum(F.col("slope")).alias("slope"))
    ridge = F.transform("w", lambda x, i: F.when(i < F.size("w") - 1, x).otherwise(0.0))
    return sums.join(state, FOLD).select(
        *FOLD, "n_rows", F.array_max(F.transform(V.add(F.col("slope"), ridge), lambda x: F.abs(x))).alias("gap"))


# -- the protocol -------------------------------------------------------------------------------


def lobo_methods(
    protocol: L.Protocol, scaling: DataFrame, methods: tuple[str, ...] = METHODS, rows: DataFrame | None = None,
) -> DataFrame:
    """F19 per fold: (tag, layer, cluster_id, hold, method, auc), same rows for all methods.

    `rows` narrows the protocol's rows, to one layer of each model say.
    """
    rows = protocol.rows if rows is None else rows
    out = []
    if {"pca", "lr"} & set(methods):
        blocks = protocol_blocks(rows, scaling, protocol.limit)
    if "pca" in methods:
        axes = pca_directions(blocks, protocol.folds, limit=protocol.limit)
        out.append(axes.select(*FOLD, F.lit("pca").alias("method"), "auc"))
    if "lr" in methods:
        fitted = materialize(logistic_directions(blocks, protocol.folds, limit=protocol.limit).select(
            *FOLD, F.col("v").alias("w"), F.monotonically_increasing_id().alias("dir_id")))
        auc = rank_sum_auc(score_blocks(blocks, fitted, limit=protocol.limit), ["dir_id"], "score", "positive")
        out.append(auc.join(fitted.drop("w"), "dir_id").select(*FOLD, F.lit("lr").alias("method"), "auc"))
    if "diffmean" in methods:
        layers = rows.select(*LAYER).distinct()
        out.append(L.lobo_folds(protocol).join(layers, LAYER, "left_semi").select(
            *FOLD, F.lit("diffmean").alias("method"), "auc"))
    return unite(iter(out), rows, "tag string, layer int, cluster_id string, hold string, method string, auc double").filter(
        F.col("auc").isNotNull())


def method_comparison(cells: DataFrame, texts_per_capability: DataFrame) -> DataFrame:
    """one row per (model, layer, capability): median fold AUC of every method, and its datasets.

    `texts_per_capability` is (cluster_id, n_datasets). Filter `cells` for a fixed layer.
    """
    from capsonde.operators.reports import wide_methods

    medians = L.fold_summary(cells, [*LAYER, "cluster_id", "method"]).withColumn("auc", F.col("lobo_med"))
    wide = wide_methods(medians, list(METHODS))
    return wide.join(texts_per_capability.select("cluster_id", "n_datasets"), "cluster_id", "left")
