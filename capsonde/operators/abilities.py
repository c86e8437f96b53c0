"""Merging raw abilities by name into candidate abilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsonde.functions.numbering import positions
from capsonde.functions.text import norm_name, or_else, title_of

# How many of the commonest values each field keeps; None keeps them all.
KEPT = {
    "display_name": 1,
    "representation_family": 1,
    "definition": 3,
    "positive_state": 3,
    "negative_state": 3,
    "probe_hypothesis": 3,
    "steering_hypothesis": 3,
    "source_benchmark_examples": 12,
    "source_task_examples": 12,
    "generality": None,
    "contrast_pair_feasibility": None,
    "behavioral_scorer_feasibility": None,
}
TEXT_FIELDS = [f for f, k in KEPT.items() if k == 3]
LIST_FIELDS = [f for f, k in KEPT.items() if k == 12]
COUNT_FIELDS = [f for f, k in KEPT.items() if k is None]


def counted_values(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Distinct values of each group with their count and first place, combined map-side."""
    return df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("_first")
    )


def ranked_values(counted: DataFrame, keys: list[str], k: int | None) -> DataFrame:
    """The k first values of each group by count, first seen winning a tie.

    With a literal k every task cuts its groups to k rows before they are shuffled.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("_first"))
    ranked = counted.withColumn("rank", F.row_number().over(order))
    return (ranked if k is None else ranked.filter(F.col("rank") <= k)).drop("_first")


def most_common(df: DataFrame, keys: list[str], value: str, order: Column, k: int | None) -> DataFrame:
    """The k commonest values of each group with count and rank; first seen wins a tie."""
    return ranked_values(counted_values(df, keys, value, order), keys, k)


def usable(raw: DataFrame, keep_no_contrast: bool = False, keep_narrow: bool = False) -> DataFrame:
    """Drop abilities without a contrast pair, and narrow ones; an unknown value passes."""
    out = raw
    if not keep_no_contrast:
        out = out.filter(F.coalesce("contrast_pair_feasibility", F.lit("")) != "no")
    if not keep_narrow:
        out = out.filter(F.coalesce("generality", F.lit("")) != "narrow")
    return out


def field_values(raw: DataFrame) -> DataFrame:
    """Long form (name, field, value, k, order) of everything which is counted per ability."""
    raw = raw.withColumn("ability_name", norm_name(F.col("ability_name")))

    def single(field: str, value: Column, keep_empty: bool) -> Column:
        row = F.array(F.struct(
            F.lit(field).alias("field"), value.alias("value"),
            F.lit(KEPT[field]).cast("int").alias("k"), F.lit(0).alias("item"),
        ))
        if keep_empty:
            return row
        filled = value.isNotNull() & (value != "")
        return F.when(filled, row).otherwise(F.slice(row, 1, 0))

    def items(field: str) -> Column:
        listed = F.coalesce(F.col(field), F.array().cast("array<string>"))
        return F.transform(listed, lambda v, i: F.struct(
            F.lit(field).alias("field"), v.alias("value"),
            F.lit(KEPT[field]).cast("int").alias("k"), i.alias("item"),
        ))

    display = or_else(F.col("display_name"), title_of(F.col("ability_name")))
    family = F.coalesce(F.nullif(F.col("representation_family"), F.lit("")), F.col("source_family"))
    rows = F.concat(
        single("display_name", display, True),
        single("representation_family", family, True),
        *[single(f, F.col(f), False) for f in TEXT_FIELDS],
        *[items(f) for f in LIST_FIELDS],
        *[single(f, F.col(f), True) for f in COUNT_FIELDS],
    )
    return raw.select("ability_name", "pos", "ability_index", F.inline(rows))


def ability_values(raw: DataFrame) -> DataFrame:
    """D3 in long form: the kept values of every field of every ability, with their counts.

    The limit of a field is no grouping key, so both branches read one shuffled aggregate.
    Fields without a limit hold the few words which the reply shape allows.
    """
    keys = ["ability_name", "field"]
    counted = field_values(raw).groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct("pos", "ability_index", "item")).alias("_first"),
        F.max("k").alias("k"),
    )
    most = max(k for k in KEPT.values() if k)
    limited = ranked_values(counted.filter(F.col("k").isNotNull()), keys, most)
    whole = ranked_values(counted.filter(F.col("k").isNull()), keys, None)
    return limited.filter(F.col("rank") <= F.col("k")).unionByName(whole).drop("k")


def ability_sources(raw: DataFrame) -> DataFrame:
    """D3: distinct (ability, source cluster) pairs with their members, in long form.

    A common ability may come from any number of clusters, so they are not one row's list.
    """
    return raw.groupBy(
        norm_name(F.col("ability_name")).alias("ability_name"), "source_cluster_id"
    ).agg(F.count(F.lit(1)).alias("mention_count"))


def source_counts(raw: DataFrame) -> DataFrame:
    """Members and source clusters; the count takes a missing cluster as one value."""
    return ability_sources(raw).groupBy("ability_name").agg(
        F.count(F.lit(1)).alias("source_cluster_count"),
        F.sum("mention_count").alias("mention_count"),
    )


def build_final(
    raw: DataFrame, keep_no_contrast: bool = False, keep_narrow: bool = False
) -> DataFrame:
    """One row per merged ability, sorted by family, source clusters and name (G1).

    `ability_sources` lists the clusters behind each row.
    """
    members = usable(raw, keep_no_contrast, keep_narrow)
    values = ability_values(members)

    def listed(field: str, alias: str) -> Column:
        hit = F.when(F.col("field") == field, F.struct("rank", "value", "count"))
        entries = F.transform(
            F.array_sort(F.collect_list(hit)),
            lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")),
        )
        return entries.alias(alias)

    def top(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("value"))).alias(field)

    merged = values.groupBy("ability_name").agg(
        top("display_name"),
        top("representation_family"),
        *[listed(f, f"{f}_candidates") for f in TEXT_FIELDS],
        listed("source_benchmark_examples", "top_benchmark_examples"),
        listed("source_task_examples", "top_task_examples"),
        listed("generality", "generalities"),
        listed("contrast_pair_feasibility", "contrast_pair_feasibility"),
        listed("behavioral_scorer_feasibility", "behavioral_scorer_feasibility"),
    )
    return merged.join(source_counts(members), "ability_name").orderBy(*final_order())


def final_order() -> list[Column]:
    """G1: family, then the most source clusters, then name."""
    return [F.col("representation_family"), F.col("source_cluster_count").desc(), F.col("display_name")]


def numbered_final(final: DataFrame) -> DataFrame:
    """Final abilities with their `position` in that order; names settle ties."""
    family = F.coalesce("representation_family", F.lit(""))
    return positions(final, [*final_order(), F.col("ability_name")], family)
