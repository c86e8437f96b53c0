"""Top-k inner products against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from capsonde.llm import topk
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, bucket string"


def vectors(n, dim, seed, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0.01, 1, 1, 30]) if spread else 1
        rows.append((i, [float(f"{rng.gauss(0, size):.3f}") for _ in range(dim)], 1, 2, "b"))
    return rows


def results(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("spread", [False, True])
def test_scores(spark, spread):
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v], *m) for i, v, *m in vectors(600, 12, 1, spread)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vid") % 20 == 0)
    assert results(got) == brute.top_scores([r[:2] for r in rows])


def test_awkward_vectors(spark):
    rows = [(i, [0.5, 0.25], 1, 2, "b") for i in range(50)]  # ties
    rows += [(0, [0.5, 0.25], 1, 2, "b"), (60, None, 1, 2, "b"), (61, [], 1, 2, "b"), (62, [1.0, None], 1, 2, "b"), (63, [float("nan"), 1.0], 1, 2, "b"),
             (64, [float("inf"), 1.0], 1, 2, "b"), (None, [1.0, 1.0], 1, 2, "b"), (80, [1.0, 2.0, 3.0], 1, 2, "b"), (81, [1.0, 0.0, 0.0], None, 2, None),
             (100, [0.0, 0.0], 1, 2, "b"), (120, [-1.0, -1.0], 1, 2, "b"), (200, [9.0], 1, 2, "b"), (300, [20000.0, 3.5], 1, 2, "b")]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vid") % 20 == 0)
    assert results(got) == brute.top_scores([r[:2] for r in rows])
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vid") % 20 == 0).count() == 0


def test_coordinate_bound_never_loses_a_vector():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        v = rng.integers(-50, 50, (40, 16)).astype(float)
        q = rng.integers(-50, 50, 16).astype(float)
        theta = float(np.sort(v @ q)[-5])
        left = topk.Running.by_coordinates(q, np.linalg.norm(q), v, np.linalg.norm(v, axis=1), theta)
        assert set(np.flatnonzero(v @ q >= theta)) <= set(left.tolist())
