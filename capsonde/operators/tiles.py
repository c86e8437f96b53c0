"""Model weights of any size for tasks: broadcast in tiles, of which a task holds one at a time.

The weights are parameters that the caller holds. A tile is under the limit; the executors keep
tiles on disk, and a batch of rows goes through all of them, so the rows are scanned once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import SparkSession


def row_tiles(rows: int, bytes_of_row: int, limit: int) -> list[slice]:
    """Consecutive slices of `rows` rows, each within the limit, one row at least."""
    step = max(limit // max(bytes_of_row, 1), 1)
    return [slice(a, min(a + step, rows)) for a in range(0, rows, step)]


def share(spark: SparkSession, tiles: Iterator) -> list[Broadcast]:
    return [spark.sparkContext.broadcast(t) for t in tiles]


def each(shared: list[Broadcast]) -> Iterator:
    """The tiles in order. Where there are several, a task lets go of one before it loads the next."""
    for tile in shared:
        yield tile.value
        if len(shared) > 1:
            tile.__dict__.pop("_value", None)


def top_per_row(values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest values of each row and their ids, highest first, ties to the smaller id."""
    order = np.lexsort((ids, -values), axis=-1)[:, :k]
    return np.take_along_axis(values, order, 1), np.take_along_axis(ids, order, 1)
