"""Numeric and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier limits, and the depths at which a model is read.
STRONG, MODERATE = 0.8, 0.65
DEPTH_FRACTIONS = [0.25, 0.5, 0.75, 1.0]


def round_binary(x: Column, places: int = 3) -> Column:
    """Round the exact binary value, ties to even (H7), as the published tables were.

    The scaled product is inexact, so at an apparent tie its error term, which float
    splitting gives exactly, says on which side of the tie the value lies.
    """
    scale = F.lit(float(10**places))
    t = x * scale
    high = x.cast("float").cast("double")
    error = (high * scale - t) + (x - high) * scale
    low = F.floor(t)
    tied = (t - low) == F.lit(0.5)
    units = (
        F.when(tied & (error > 0), (low + 1).cast("double"))
        .when(tied & (error < 0), low.cast("double"))
        .otherwise(F.rint(t))
    )
    return units / scale


def tier(score: Column) -> Column:
    """Strength label of a capability score."""
    return (
        F.when(score.isNull(), "no-lobo")
        .when(score >= F.lit(STRONG), "strong")
        .when(score >= F.lit(MODERATE), "moderate")
        .otherwise("weak")
    )


def depth_layers(n_layers: Column) -> Column:
    """Distinct layers at the fixed fractions of a model's depth, shallow first."""
    picks = [
        F.greatest(F.lit(1), F.rint(n_layers * F.lit(f)).cast("int")) for f in DEPTH_FRACTIONS
    ]
    return F.array_sort(F.array_distinct(F.array(*picks)))


def top_list(items: Column, n: int) -> Column:
    """B2: the first n entries of a (name, count) list; null counts as empty."""
    return F.coalesce(F.slice(items, 1, n), F.expr("array()").cast("array<struct<name:string,count:bigint>>"))


def draw_key(seed: int, *parts: Column) -> Column:
    """Deterministic stand-in for a random draw: order rows by this hash."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
