"""Benchmarks, dataset candidates, splits and the manifest of crawled datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsonde.functions.numbering import positions
from capsonde.functions.text import file_name, query_variants
from capsonde.session import broadcast_if_small, materialize

# Fixed values.
TOP_PER_CLUSTER = 6
TITLES, TITLE_CHARS = 3, 120
SHOWN_CANDIDATES = 10
GENERAL_CONFIGS = ["all", "default", "main"]
SPLIT_ORDER = ["test", "testing", "validation", "valid", "val", "dev", "eval", "train"]


def benchmark_targets(selection: DataFrame, mentions: DataFrame) -> DataFrame:
    """Benchmarks of the kept clusters, most mentioned first."""
    kept = selection.filter(~F.col("excluded"))
    top = kept.select(
        "pos", "cluster_id", "cluster_name",
        F.posexplode(F.slice("top_scorer_benchmarks", 1, TOP_PER_CLUSTER)).alias("rank", "_b"),
    )
    label = F.concat("cluster_name", F.lit(" ("), "cluster_id", F.lit(")"))
    rolled = top.groupBy(F.col("_b.name").alias("benchmark")).agg(
        F.sum("_b.n").alias("mentions"),
        F.array_sort(F.collect_list(F.struct("pos", "rank", label.alias("label")))).alias("_c"),
    )
    return (
        rolled.join(benchmark_titles(kept, mentions), "benchmark", "left")
        .select(
            "benchmark", "mentions",
            F.transform("_c", lambda c: c["label"]).alias("clusters"),
            F.coalesce("paper_titles", F.array().cast("array<string>")).alias("paper_titles"),
            F.get("_c", F.lit(0))["pos"].alias("first_pos"),
            F.get("_c", F.lit(0))["rank"].alias("first_rank"),
        )
        .orderBy(*target_order())
    )


def target_order() -> list[Column]:
    """Most mentions first, then the order of clusters and of benchmarks in them."""
    return [F.col("mentions").desc(), F.col("first_pos"), F.col("first_rank")]


def numbered_targets(targets: DataFrame) -> DataFrame:
    """Targets with their `position` in that order."""
    return positions(targets, target_order(), -F.col("mentions"))


def benchmark_titles(kept: DataFrame, mentions: DataFrame) -> DataFrame:
    """The first few distinct paper titles per benchmark, sorted."""
    title = F.substring(F.coalesce("paper_title", F.lit("")), 1, TITLE_CHARS)
    seen = (
        mentions.join(
            kept.select(F.col("cluster_id").alias("final_cluster_id")), "final_cluster_id", "left_semi"
        )
        .groupBy(F.col("benchmark_name").alias("benchmark"), title.alias("title"))
        .agg(F.min("pos").alias("pos"))
    )
    order = Window.partitionBy("benchmark").orderBy("pos")
    return (
        seen.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= TITLES)
        .groupBy("benchmark")
        .agg(F.array_sort(F.collect_list("title")).alias("paper_titles"))
    )


def search_queries(targets: DataFrame) -> DataFrame:
    """One row per search spelling of a benchmark."""
    return targets.select(
        "benchmark", F.posexplode(query_variants(F.col("benchmark"))).alias("query_no", "query")
    )


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """Distinct candidates per benchmark as first seen, numbered; the first ten are shown."""
    first = candidates.groupBy("benchmark", "id").agg(
        F.min(F.struct("query_no", "pos", "downloads", "likes", "desc")).alias("_f")
    )
    order = Window.partitionBy("benchmark").orderBy("_f.query_no", "_f.pos")
    number = F.row_number().over(order)
    return first.select(
        "benchmark", "id", "_f.downloads", "_f.likes", "_f.desc", number.alias("candidate_no"),
        (number <= SHOWN_CANDIDATES).alias("shown"),
    )


def accepted_matches(proposals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keep a proposed id which is not "none" and is among all of the candidates."""
    named = F.col("proposed").isNotNull() & ~F.lower("proposed").isin("none", "")
    known = candidates.select("benchmark", F.col("id").alias("proposed")).distinct().withColumn(
        "_known", F.lit(True)
    )
    accepted = named & F.coalesce("_known", F.lit(False))
    return (
        proposals.join(known, ["benchmark", "proposed"], "left")
        .withColumn("match", F.when(accepted, F.col("proposed")))
        .withColumn("confidence", F.when(accepted, F.col("confidence")))
        .select("benchmark", "match", "confidence")
    )


def pick_split(splits: DataFrame) -> DataFrame:
    """A general config if the catalogue has one, else its first; then the preferred split."""
    general = F.lower("config").isin(GENERAL_CONFIGS)
    choice = F.min(F.struct(F.when(general, 0).otherwise(1).alias("rank"), "pos", "config"))
    config = splits.groupBy("dataset_id").agg(choice["config"].alias("config"))
    place = F.array_position(F.array(*[F.lit(s) for s in SPLIT_ORDER]), F.lower("split"))
    rank = F.when(place > 0, place).otherwise(F.lit(len(SPLIT_ORDER) + 1))
    return (
        splits.join(config, ["dataset_id", "config"])
        .groupBy("dataset_id", "config")
        .agg(F.min(F.struct(rank.alias("rank"), "pos", "split"))["split"].alias("split"))
    )


def matched_benchmarks(matches: DataFrame) -> DataFrame:
    """Benchmarks of each matched dataset, in record order, in long form."""
    return matches.filter(F.col("match").isNotNull() & (F.col("match") != "")).select(
        F.col("match").alias("dataset_id"), "pos", "benchmark", "clusters"
    )


def manifest(matches: DataFrame, chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """Per matched dataset its capabilities, split, row count and columns.

    A dataset without a split reports an error; one with a split and no rows has no columns.
    Benchmarks are counted here and listed by `matched_benchmarks`.
    """
    matched = matched_benchmarks(matches)
    tags = (
        matched.select("dataset_id", F.explode("clusters").alias("c")).distinct()
        .groupBy("dataset_id").agg(F.array_sort(F.collect_list("c")).alias("clusters"))
    )
    counted = matched.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_benchmarks"))
    sizes = materialize(
        rows.groupBy("dataset_id").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("row_idx")
        )
    )
    first = broadcast_if_small(sizes.drop("n_rows"), 128)
    heads = rows.join(first, ["dataset_id", "row_idx"]).select(
        "dataset_id", F.array_sort(F.json_object_keys("row_json")).alias("columns")
    )
    found = F.col("split").isNotNull()
    none = F.array().cast("array<string>")
    return (
        counted.join(tags, "dataset_id", "left")
        .join(chosen, "dataset_id", "left")
        .join(sizes.drop("row_idx"), "dataset_id", "left")
        .join(heads, "dataset_id", "left")
        .select(
            "dataset_id", "n_benchmarks",
            F.coalesce("clusters", none).alias("clusters"),
            F.when(found, "ok").otherwise("error").alias("status"),
            "config", "split",
            F.when(found, F.coalesce("n_rows", F.lit(0))).alias("n_rows"),
            F.when(found, F.concat(file_name(F.col("dataset_id")), F.lit(".jsonl"))).alias("file"),
            F.when(found, F.coalesce("columns", none)).alias("columns"),
            F.when(~found, F.lit("no splits")).alias("error"),
        )
    )
