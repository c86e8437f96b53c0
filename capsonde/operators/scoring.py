"""Project hidden states on many directions.

Directions are model parameters: folds x width doubles. Their size is known once they are
written; they are shipped to the workers by whole (model, layer)s, as many at a time as fit a
limit, and each Arrow batch is one matrix product, so a hidden row crosses to Python once however
many folds need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsonde.functions.arrow import layer_slices, list_rows, matrix_of
from capsonde.operators.directions import LAYER
from capsonde.session import BROADCAST_LIMIT, materialize

SCORES = "dir_id bigint, uid string, positive boolean, score double"
PROJECTION_SUMS = "dir_id bigint, cluster_id string, n bigint, total double, squares double"


def number_directions(directions: DataFrame) -> DataFrame:
    """Write the directions once and give each a stable id."""
    return materialize(directions.withColumn("dir_id", F.monotonically_increasing_id()))


def fold_key(kind: str, cluster: Column, hold: Column | None = None) -> Column:
    """One number for (kind, capability, held-out dataset), the same on rows and directions."""
    parts = [F.lit(kind), cluster] + ([hold] if hold is not None else [])
    return F.xxhash64(*parts)


def _positive_keys() -> Column:
    """What a text is a test positive for: its own dataset's folds, and its second halves."""
    held_out = F.transform("clusters", lambda c: fold_key("lobo", c, F.col("dataset_id")))
    second = F.transform(
        F.filter("clusters", lambda c: ~F.array_contains("half", c)),
        lambda c: fold_key("within", c),
    )
    return F.concat(held_out, second)


class LayerDirections:
    """The directions of one (model, layer), found by fold key or by capability."""

    def __init__(self, ids, weights, shift, keys, clusters):
        self.ids, self.weights, self.shift = ids, weights, shift
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.of_cluster: dict[str, list[int]] = {}
        for i, cluster in enumerate(clusters):
            self.of_cluster.setdefault(cluster, []).append(i)

    def score_keys(self, h: np.ndarray, column: pa.Array):
        """(row, direction, score) where a row's key names a direction here."""
        row, flat = list_rows(column)
        key = flat.to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        row, direction = row[hit], self.order[place[hit]]
        by_direction = np.argsort(direction, kind="stable")
        row, direction = row[by_direction], direction[by_direction]
        score = np.empty(len(row))
        used, start = np.unique(direction, return_index=True)
        for d, lo, hi in zip(used, start, [*start[1:], len(row)]):
            score[lo:hi] = h[row[lo:hi]] @ self.weights[d] - self.shift[d]
        return row, direction, score

    def score_clusters(self, h: np.ndarray, column: pa.Array):
        """(row, direction, score) for every direction of a row's capabilities."""
        lengths = np.diff(column.offsets.to_numpy())
        sampled = np.flatnonzero(lengths)
        lists = column.take(pa.array(sampled)).to_pylist()
        wanted = [[i for c in clusters for i in self.of_cluster.get(c, ())] for clusters in lists]
        line = np.repeat(np.arange(len(sampled)), [len(w) for w in wanted])
        direction = np.array([i for w in wanted for i in w], dtype=np.int64)
        products = h[sampled] @ self.weights.T - self.shift
        return sampled[line], direction, products[line, direction]


def _share(directions: DataFrame):
    """Broadcast of the directions of each (tag, layer) as plain arrays; size checked above."""
    key = (
        F.when(F.col("kind") == "lobo", fold_key("lobo", F.col("cluster_id"), F.col("hold")))
        .when(F.col("kind") == "within", fold_key("within", F.col("cluster_id")))
        .otherwise(F.xxhash64("kind", "cluster_id"))
    )
    table = directions.select(
        *LAYER, "cluster_id", "dir_id", "w", "shift", key.alias("key")
    ).toArrow()
    layers = list(zip(table["tag"].to_pylist(), table["layer"].to_pylist()))
    arrays = {}
    for layer in set(layers):
        t = table.filter(pa.array([k == layer for k in layers]))
        arrays[layer] = (
            t["dir_id"].to_numpy(), matrix_of(t["w"]), t["shift"].to_numpy(),
            t["key"].to_numpy(), t["cluster_id"].to_pylist(),
        )
    return directions.sparkSession.sparkContext.broadcast(arrays)


def _score_in_workers(rows: DataFrame, directions: DataFrame) -> DataFrame:
    shared = _share(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {key: LayerDirections(*arrays) for key, arrays in shared.value.items()}
        for batch in batches:
            for key, part in layer_slices(batch):
                if key not in models:
                    continue
                model, h = models[key], matrix_of(part["h"])
                for positive, (row, direction, score) in (
                    (True, model.score_keys(h, part["positive_keys"])),
                    (False, model.score_clusters(h, part["neg_test"])),
                ):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(model.ids[direction], pa.int64()),
                            part["uid"].take(pa.array(row, pa.int64())),
                            pa.array(np.full(len(row), positive)),
                            pa.array(score, pa.float64()),
                        ],
                        names=["dir_id", "uid", "positive", "score"],
                    )

    needed = rows.select(
        *LAYER, "uid", _positive_keys().alias("positive_keys"), "neg_test", "h"
    )
    return needed.mapInArrow(run, SCORES)


def layer_blocks(
    rows: DataFrame, directions: DataFrame, limit: int
) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Rows and directions of some whole (tag, layer)s at a time, directions under the limit.

    The rows' filter names its layers, so over a table stored by (tag, layer) all blocks together
    are one scan. Only a layer whose own directions exceed the limit is read more than once.
    """
    sizes = directions.groupBy(*LAYER).agg(F.sum(F.size("w")).alias("n")).orderBy(*LAYER).collect()
    held, total = [], 0

    def block(keys, number=0, of=1):
        def chosen():
            one = F.lit(False)
            for tag, layer in keys:
                one |= (F.col("tag") == tag) & (F.col("layer") == layer)
            return one

        part = directions.filter(chosen())
        if of > 1:
            part = part.filter(F.pmod(F.xxhash64("dir_id"), F.lit(of)) == number)
        return rows.filter(chosen()), part

    for r in sizes:
        size = (r["n"] or 0) * 8
        if held and total + size > limit:
            yield block(held)
            held, total = [], 0
        if size > limit:
            parts = -(-size // max(limit, 1))
            yield from (block([(r["tag"], r["layer"])], i, parts) for i in range(parts))
        else:
            held.append((r["tag"], r["layer"]))
            total += size
    if held:
        yield block(held)


def unite(parts: Iterator[DataFrame], empty: DataFrame, schema: str) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return empty.sparkSession.createDataFrame([], schema) if out is None else out


def score_rows(
    rows: DataFrame, directions: DataFrame, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Test scores of every direction: held-out or second-half positives, test negatives.

    `rows` comes from `with_roles`, `directions` from `number_directions`; its `spec` kind has
    no test of its own.
    """
    blocks = layer_blocks(rows, directions.filter(F.col("kind") != "spec"), limit)
    return unite((_score_in_workers(*b) for b in blocks), rows, SCORES)


def projection_sums(
    rows: DataFrame, directions: DataFrame, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Sums of every text's projection on every direction, in all and per capability.

    Rows (dir_id, cluster_id or null for all texts, n, total, squares). A task keeps one
    running sum per (direction, capability) and emits it at its end.
    """
    blocks = layer_blocks(rows, directions, limit)
    out = unite((_sums_in_workers(*b) for b in blocks), rows, PROJECTION_SUMS)
    return out.groupBy("dir_id", "cluster_id").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")
    )


def _sums_in_workers(rows: DataFrame, directions: DataFrame) -> DataFrame:
    shared = _share(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def add(key, cluster, products):
            n, total, squares = sums.get((key, cluster), (0, 0.0, 0.0))
            sums[key, cluster] = (
                n + len(products),
                total + products.sum(axis=0),
                squares + (products * products).sum(axis=0),
            )

        for batch in batches:
            for key, part in layer_slices(batch):
                if key not in shared.value:
                    continue
                _, weights, shift, *_ = shared.value[key]
                products = matrix_of(part["h"]) @ weights.T - shift
                add(key, None, products)
                row, tags = list_rows(part["clusters"])
                tags = tags.dictionary_encode()
                code = tags.indices.to_numpy()
                for c in np.unique(code):
                    add(key, tags.dictionary[int(c)].as_py(), products[row[code == c]])
        for (key, cluster), (n, total, squares) in sums.items():
            ids = shared.value[key][0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([cluster] * len(ids), pa.string()),
                    pa.array(np.full(len(ids), n), pa.int64()),
                    pa.array(total, pa.float64()),
                    pa.array(squares, pa.float64()),
                ],
                names=["dir_id", "cluster_id", "n", "total", "squares"],
            )

    return rows.select(*LAYER, "clusters", "h").mapInArrow(run, PROJECTION_SUMS)
