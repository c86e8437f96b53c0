"""Judged records: evidence prompts, tolerant parsing of replies, exploding, summary counts.

Replies are held as VARIANT, so a field of an unexpected type costs that field only. All
functions but `summary_counts` are row-wise and take a streaming frame as well.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsonde.functions.numbering import position_bucket, row_number_by
from capsonde.functions.scalars import top_list
from capsonde.functions.text import compact, once, parse_json_text
from capsonde.session import broadcast_if_small, materialize

# List lengths and text limits of the evidence shown to the judge.
TOP_LISTS = {
    "top_capability_names": 12,
    "top_operation_terms": 16,
    "top_agentic_dimensions": 10,
    "top_domains": 10,
    "top_target_model_types": 10,
    "top_benchmarks": 12,
    "top_tasks": 12,
}
TEXT_LIMITS = {
    "definition": 450,
    "cognitive_operation": 350,
    "surface_task": 300,
    "evaluated_behavior": 300,
}
SHOWN = [
    "paper_title", "benchmark_name", "task_name", "canonical_name", *TEXT_LIMITS,
    "agentic_dimensions", "domain_metadata", "confidence",
]
MAX_MENTIONS = 10
REJECT_CHARS = 2000
PARTS = 8  # of a group, for each row that is looked for
SEED = 24
BOUND_BYTES = 128  # of a group's bound in a broadcast

GUIDANCE = (
    "Decide whether this cluster of benchmark tasks names a latent ability which can be read "
    "from, or steered in, a language model's hidden states. Drop pure domains and artifacts, "
    "split compound workflows, merge duplicates, keep atomic operations. "
    "Return strict JSON only."
)
REPLY_SHAPE = (
    '{"cluster_id": "", "family": "", "representation_fit": "keep | split | merge | drop", '
    '"fit_score": "1-5", "fit_rationale": "", "drop_reason": null, '
    '"latent_abilities": [{"ability_name": "", "display_name": "", "definition": ""}]}'
)

JUDGMENT_STRINGS = [
    "task_facing_cluster_summary", "representation_fit", "fit_rationale", "drop_reason",
]
ABILITY_STRINGS = [
    "ability_name", "display_name", "representation_family", "status", "definition",
    "positive_state", "negative_state", "probe_hypothesis", "steering_hypothesis",
    "contrast_pair_feasibility", "behavioral_scorer_feasibility", "generality", "notes",
]
ABILITY_LISTS = ["source_benchmark_examples", "source_task_examples"]


def numbered_mentions(mentions: DataFrame) -> DataFrame:
    """A4: mentions with their place in their cluster, in file order."""
    return row_number_by(
        mentions, ["cluster_id"], [F.col("pos")], position_bucket(F.col("pos")), "mention_no"
    )


def least_bounds(rows: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """(keys, _bound): at least `most` rows of the group have a value up to its bound, and few more than that.

    However a group is split, the `most`-th of its parts' least values is such a bound, so nothing is
    sorted but one value a part. Nulls come first: `_nulls` says that they alone are enough. Groups
    of fewer rows have no bound, and are left out.
    """
    part = F.floor(F.rand(SEED) * (PARTS * most)).cast("int")
    parts = rows.select(*keys, value, part.alias("_part")).groupBy(*keys, "_part").agg(
        F.min(value).alias("_least"), F.bool_or(F.col(value).isNull()).alias("_null")
    )
    return (
        parts.groupBy(*keys)
        .agg(
            F.get(F.sort_array(F.collect_list("_least")), F.lit(most - 1)).alias("_bound"),
            (F.count_if("_null") >= most).alias("_nulls"),
        )
        .filter(F.col("_bound").isNotNull() | F.col("_nulls"))
    )


def within_bounds(rows: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """Rows up to their group's bound, ties included; those of groups without one all stay."""
    bounds = materialize(least_bounds(rows, keys, value, most)).withColumnsRenamed({k: f"{k}__" for k in keys})
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys])
    low = F.col(value).isNull() | (~F.col("_nulls") & (F.col(value) <= F.col("_bound")))
    joined = rows.join(broadcast_if_small(bounds, BOUND_BYTES), same, "left")
    return joined.filter(F.col("_nulls").isNull() | low).select(*rows.columns)


def early_mentions(mentions: DataFrame, most: int) -> DataFrame:
    """The first `most` mentions of each cluster and few others, with `_hash`, which orders ties.

    First only clusters and places are read, then the texts of the rows up to their cluster's bound.
    Of the mentions which share a place those of the least hashes stay; copies are counted, and as
    many as can be shown are written out again.
    """
    hashed = within_bounds(mentions, ["cluster_id"], "pos", most).withColumn("_hash", F.xxhash64(*mentions.columns))
    near = within_bounds(hashed, ["cluster_id", "pos"], "_hash", most)
    copies = near.groupBy(*near.columns).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("_copies"))
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copy", "_copies")


def representative_mentions(mentions: DataFrame, most: int = MAX_MENTIONS) -> DataFrame:
    """The first `most` mentions of each cluster, texts shortened for the prompt.

    Null places come first; mentions which share a place are taken by a hash of their fields.
    """
    order = Window.partitionBy("cluster_id").orderBy("pos", "_hash")
    read = mentions.select("cluster_id", "pos", *SHOWN)
    return (
        early_mentions(read, most).withColumn("mention_no", F.row_number().over(order))
        .filter(F.col("mention_no") <= most)
        .select(
            "cluster_id", "mention_no", "paper_title", "benchmark_name", "task_name",
            F.col("canonical_name").alias("capability_name"),
            *[compact(F.col(c), limit).alias(c) for c, limit in TEXT_LIMITS.items()],
            F.coalesce("agentic_dimensions", F.array().cast("array<string>")).alias("agentic_dimensions"),
            F.coalesce("domain_metadata", F.array().cast("array<string>")).alias("domain_metadata"),
            "confidence",
        )
    )


def cluster_payloads(
    clusters: DataFrame, mentions: DataFrame, most: int = MAX_MENTIONS
) -> DataFrame:
    """Each cluster with its shortened lists and up to `most` mentions as one struct."""
    shown = representative_mentions(mentions, most)
    entry = F.struct("mention_no", *[c for c in shown.columns if c not in ("cluster_id", "mention_no")])
    grouped = shown.groupBy("cluster_id").agg(F.array_sort(F.collect_list(entry)).alias("_reps"))
    reps = F.transform(
        F.coalesce("_reps", F.array().cast(grouped.schema["_reps"].dataType)),
        lambda m: m.dropFields("mention_no"),
    )
    payload = F.struct(
        "cluster_id", "family", "size",
        *[top_list(F.col(c), n).alias(c) for c, n in TOP_LISTS.items()],
        reps.alias("representative_mentions"),
    )
    return clusters.join(grouped, "cluster_id", "left").select(
        "cluster_id", "family", "size", payload.alias("cluster_payload")
    )


def prepare_prompts(
    clusters: DataFrame,
    mentions: DataFrame,
    most: int = MAX_MENTIONS,
    guidance: str = GUIDANCE,
    reply_shape: str = REPLY_SHAPE,
) -> DataFrame:
    """One prompt per cluster: guidance, reply shape and the evidence as JSON."""
    evidence = F.to_json(
        "cluster_payload", {"ignoreNullFields": "false", "pretty": "true"}
    )
    prompt = F.concat_ws(
        "\n\n",
        F.lit(guidance),
        F.lit("Output JSON schema:"),
        F.lit(reply_shape),
        F.lit("Now judge this cluster:"),
        evidence,
    )
    return cluster_payloads(clusters, mentions, most).withColumn("prompt", prompt)


def _text(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def parse_replies(results: DataFrame) -> DataFrame:
    """Every result with its outcome and, where it parsed to an object, its reply.

    A reply which is valid JSON but no object is rejected too (H12).
    """
    ok = F.coalesce("status", F.lit("")) == "ok"
    return (
        results.select("*", once(F.when(ok, parse_json_text(F.col("response_text")))).alias("reply"))
        .select("*", once(F.try_variant_get("reply", "$", "map<string,variant>")).alias("fields"))
        .withColumn(
            "outcome",
            F.when(~ok, "request_error").when(F.col("fields").isNull(), "parse_error").otherwise("parsed"),
        )
    )


def _default(name: str, fallback: str) -> Column:
    """The reply's own value when it has the key, null included, else the result's."""
    return F.when(
        F.map_contains_key("fields", F.lit(name)), _text(F.col("reply"), f"$.{name}")
    ).otherwise(F.col(fallback))


def judgments(parsed: DataFrame) -> DataFrame:
    """Typed judgments of the replies which parsed."""
    reply = F.col("reply")
    return parsed.filter(F.col("outcome") == "parsed").select(
        "pos",
        _default("cluster_id", "cluster_id").alias("cluster_id"),
        _default("family", "family").alias("family"),
        *[_text(reply, f"$.{c}").alias(c) for c in JUDGMENT_STRINGS],
        F.try_variant_get(reply, "$.fit_score", "int").alias("fit_score"),
        F.try_variant_get(reply, "$.merge_targets_suggested", "array<string>").alias("merge_targets_suggested"),
        F.try_variant_get(reply, "$.latent_abilities", "array<variant>").alias("latent_abilities"),
        F.col("size").alias("_source_size"),
        F.map_contains_key("fields", F.lit("representation_fit")).alias("_has_fit"),
    )


def rejects(parsed: DataFrame) -> DataFrame:
    """Failed requests with their error, unreadable replies with the start of their text."""
    unread = F.col("outcome") == "parse_error"
    return parsed.filter(F.col("outcome") != "parsed").select(
        "pos", "cluster_id", "outcome",
        F.when(unread, F.lit("not a JSON object")).otherwise(F.col("error")).alias("error"),
        F.when(unread, F.substring(F.coalesce("response_text", F.lit("")), 1, REJECT_CHARS)).alias("text"),
    )


def abilities(judged: DataFrame) -> DataFrame:
    """One row per latent ability with its index and its judgment's fields."""
    each = judged.select(
        "pos",
        F.col("cluster_id").alias("source_cluster_id"),
        F.col("family").alias("source_family"),
        F.col("representation_fit").alias("cluster_fit"),
        F.col("fit_score").alias("cluster_fit_score"),
        F.posexplode("latent_abilities").alias("ability_index", "_a"),
    )
    a = F.col("_a")
    return each.select(
        "pos", "ability_index", "source_cluster_id", "source_family", "cluster_fit",
        "cluster_fit_score",
        *[_text(a, f"$.{c}").alias(c) for c in ABILITY_STRINGS],
        *[F.try_variant_get(a, f"$.{c}", "array<string>").alias(c) for c in ABILITY_LISTS],
    )


def summary_counts(parsed: DataFrame) -> DataFrame:
    """Results, errors, parsed replies, each fit verdict and raw abilities, in one pass."""
    judged = F.col("outcome") == "parsed"
    fit = F.when(
        ~F.map_contains_key("fields", F.lit("representation_fit")), F.lit("missing")
    ).otherwise(F.coalesce(_text(F.col("reply"), "$.representation_fit"), F.lit("None")))
    n_abilities = F.coalesce(
        F.size(F.try_variant_get("reply", "$.latent_abilities", "array<variant>")), F.lit(0)
    )
    def one(metric: Column, n: Column) -> Column:
        return F.struct(metric.alias("metric"), n.cast("bigint").alias("n"))

    metrics = F.array(
        one(F.lit("results"), F.lit(1)),
        one(F.lit("request_errors"), (F.col("outcome") == "request_error").cast("int")),
        one(F.lit("parse_errors"), (F.col("outcome") == "parse_error").cast("int")),
        one(F.lit("parsed"), judged.cast("int")),
        one(F.when(judged, F.concat(F.lit("fit:"), fit)), F.lit(1)),
        one(F.lit("raw_abilities"), F.when(judged, F.greatest(n_abilities, F.lit(0))).otherwise(0)),
    )
    return (
        parsed.select(F.inline(metrics))
        .filter(F.col("metric").isNotNull())
        .groupBy("metric").agg(F.sum("n").alias("n"))
        .filter((F.col("n") > 0) | (F.col("metric") == "raw_abilities"))
    )
