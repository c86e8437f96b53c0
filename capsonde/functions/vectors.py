"""Element-wise expressions on ARRAY<DOUBLE>, for tables with one row per direction."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector over its length; the small term keeps a zero vector finite."""
    length = norm(a) + F.lit(1e-8)
    return F.transform(a, lambda x: x / length)


def vector_sum(a: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(a)))


def vector_mean(a: Column, weight: Column | None = None) -> Column:
    if weight is None:
        return vector_to_array(Summarizer.mean(array_to_vector(a)))
    return vector_to_array(Summarizer.mean(array_to_vector(a), weight.cast("double")))


def stream_mean(streams: Column) -> Column:
    """Element-wise mean over parallel residual streams (ARRAY<ARRAY<FLOAT>>)."""
    first = F.transform(F.element_at(streams, 1), lambda x: x.cast("double"))
    total = F.aggregate(
        F.slice(streams, F.lit(2), F.size(streams)), first, lambda s, h: add(s, h)
    )
    return F.transform(total, lambda x: x / F.size(streams))
