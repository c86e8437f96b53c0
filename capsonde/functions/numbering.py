"""Row numbers and ranks which never sort a whole group in one task.

A group may hold a third of all rows, so each group is cut into order-preserving buckets.
Rows are counted per bucket, the counts are summed up in order, and only the rows inside
one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 1 << 14


def hash_bucket(hash_hex: Column, digits: int = 3) -> Column:
    """Leading hex digits of an md5: uniform, and ordered like the hash itself."""
    return F.substring(hash_hex, 1, digits)


def value_bucket(x: Column) -> Column:
    """Order-preserving bucket of a double: 16,384 steps per power of two, on either side of 0.

    Scores within one part in a thousand of each other fall into some twenty buckets, and a group
    never has more buckets than one task sorts easily. Infinities have the outermost buckets; NaN and null have none.
    """
    octave = F.floor(F.log2(F.abs(x)) * STEPS_PER_OCTAVE)
    step = octave + F.lit(1100 * STEPS_PER_OCTAVE)
    far = F.lit(2200 * STEPS_PER_OCTAVE)
    return (
        F.when(F.isnan(x), None).when(x == 0, F.lit(0)).when(x == float("inf"), far)
        .when(x == float("-inf"), -far).when(x > 0, step).otherwise(-step).cast("int")
    )


HEAVY_SHARE = 4096  # a bucket above one in so many of all rows is cut further, so at most as many are
CUTS = 64


def cut_heavy_buckets(
    df: DataFrame, keys: list[str], value: str, weight: Column, name: str = "_c",
    heavy_rows: int = 20_000,
) -> DataFrame:
    """Adds the place of a row's value among the borders of its own (keys, _b) bucket, 0 if it is light.

    For values that lie closer together than the fixed steps: a bucket that holds more than a
    4096th of all rows gets borders from a mergeable quantile sketch of its own values. There are
    at most 4096 such buckets by that definition, each with CUTS borders, which bounds what is
    broadcast at any size. `weight` is a row's count; it must name every other column, so that all
    uses share one exchange.
    """
    bucket = [*keys, "_b"]
    sizes = df.groupBy(*bucket).agg(F.sum(weight).alias("_rows"))
    least = F.greatest(F.lit(heavy_rows), sizes.agg(F.sum("_rows")).scalar() / F.lit(HEAVY_SHARE))
    named = [F.col(k).alias(f"{k}__") for k in bucket]
    heavy = sizes.filter(F.col("_rows") > least).select(*named)
    same = None
    for k in bucket:
        one = F.col(k).eqNullSafe(F.col(f"{k}__"))
        same = one if same is None else same & one
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    borders = (
        df.filter(weight > 0).join(F.broadcast(heavy), same, "left_semi")
        .groupBy(*bucket).agg(F.percentile_approx(value, shares, 10 * CUTS).alias("_borders"))
        .select(*named, "_borders")
    )
    place = F.size(F.filter("_borders", lambda x: x < F.col(value)))
    return (
        df.join(F.broadcast(borders), same, "left")
        .withColumn(name, F.when(F.col("_borders").isNull(), 0).otherwise(place))
        .drop("_borders", *[f"{k}__" for k in bucket])
    )


def position_bucket(pos: Column, width: int = 1 << 18) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


def row_number_by(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rn"
) -> DataFrame:
    """One-based position of each row inside its group under `order`, bucket by bucket.

    `bucket` must be monotone in `order` and depend on stored values only.
    """
    cut = df.withColumn("_b", bucket)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(base, [*keys, "_b"])
        .withColumn(name, F.col("_base") + F.col("_rn"))
        .drop("_b", "_rn", "_base")
    )


def shard_of(df: DataFrame, pos: str, n_shards: int, name: str = "shard") -> DataFrame:
    """Shard number by row position modulo n, over the order of an integer position."""
    keyed = df.withColumn("_all", F.lit(0))
    numbered = row_number_by(
        keyed, ["_all"], [F.col(pos)], position_bucket(F.col(pos)), "_row"
    )
    return numbered.withColumn(name, F.pmod(F.col("_row") - 1, F.lit(n_shards)).cast("int")).drop(
        "_row", "_all"
    )


def ranked(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value has a place in the order: neither NaN nor null."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def positions(df: DataFrame, order: list[Column], bucket: Column, name: str = "position") -> DataFrame:
    """Every row's one-based place in the whole table's order."""
    return row_number_by(df.withColumn("_all", F.lit(0)), ["_all"], order, bucket, name).drop("_all")


def average_rank(
    df: DataFrame, keys: list[str], value: str, name: str = "avg_rank", heavy_rows: int | None = None
) -> DataFrame:
    """One row per distinct value of a group with its tie count and mean rank.

    Ties collapse in the map-side aggregate first, so a value held by a third of all rows
    is one row by the time it is sorted. `value` must be stored, not recomputed: the bucket
    totals are joined back on it. Infinities rank outermost; NaN and null are left out. With
    `heavy_rows` buckets above it are cut at borders of their own (`cut_heavy_buckets`).
    """
    ties = (
        ranked(df, value).withColumn("_b", value_bucket(F.col(value).cast("double")))
        .groupBy(*keys, "_b", value)
        .agg(F.count(F.lit(1)).alias("n_ties"))
    )
    cut = ["_b"]
    if heavy_rows is not None:
        ties, cut = cut_heavy_buckets(ties, keys, value, F.col("n_ties"), heavy_rows=heavy_rows), ["_b", "_c"]
    in_bucket = (
        Window.partitionBy(*keys, *cut).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    lower = ties.withColumn("_below", F.coalesce(F.sum("n_ties").over(in_bucket), F.lit(0)))
    sizes = ties.groupBy(*keys, *cut).agg(F.sum("n_ties").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, *cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.col("_base") + F.col("_below") + (F.col("n_ties") + F.lit(1)) / F.lit(2.0).cast("double")
    return lower.join(base, [*keys, *cut]).select(*keys, value, "n_ties", rank.alias(name))
