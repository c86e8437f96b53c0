"""Probe texts from heterogeneous dataset rows.

A dataset's field roles come from its first row. Texts are compared by hash: the passes over
all rows shuffle only (dataset, row, hash, length), and the text itself is put together again
for the few rows which are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsonde.functions.flatten import field_text, flatten_row
from capsonde.functions.scalars import draw_key
from capsonde.functions.text import once, strip
from capsonde.session import broadcast_if_small, materialize

# Field names by role, in order of preference.
PRIMARY = [
    "question", "prompt", "instruction", "problem", "query", "src",
    "statement", "user_message", "input", "sentence", "text", "claim",
    "premise", "anchor_post", "post", "original", "code", "story",
    "dialogue", "conversation", "title", "content",
]
CONTEXT = ["context", "paragraph", "passage", "background", "document", "article"]
OPTIONS = ["options", "choices", "answer_candidates", "candidates"]

# Limits of the corpus rules.
CONTEXT_CHARS, OPTIONS_CHARS, SECONDARY_CHARS, MAX_CHARS = 2000, 600, 1500, 4000
MIN_CHARS, MIN_MEDIAN = 30, 40
MAX_PER_DATASET, MIN_PER_DATASET = 150, 20
COMPARED_CHARS, MIN_SECONDARY_MEDIAN = 500, 15
MAX_ROWS, WEAK_TEXTS = 500, 60


def dataset_clusters(experiment: DataFrame) -> DataFrame:
    """Capabilities of each dataset which was read and has a file."""
    d = experiment.select("cluster_id", F.inline("datasets"))
    has_file = F.col("file").isNotNull() & (F.col("file") != "")
    return (
        d.filter((F.col("status") == "ok") & has_file)
        .groupBy(F.col("hf_dataset").alias("dataset_id"))
        .agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters"))
    )


def tagged_rows(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of the datasets that some capability is mapped to."""
    return rows.join(broadcast_if_small(clusters.select("dataset_id"), 256), "dataset_id", "left_semi")


def cap_rows(rows: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """The first rows of each dataset in source order."""
    order = Window.partitionBy("dataset_id").orderBy("row_idx")
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).drop("_rn")


def first_rows(rows: DataFrame) -> DataFrame:
    """The first row of each dataset; datasets without rows vanish.

    Its number is found without reading the row text, and no other row is shuffled.
    """
    first = materialize(rows.groupBy("dataset_id").agg(F.min("row_idx").alias("row_idx")))
    return rows.join(broadcast_if_small(first, 128), ["dataset_id", "row_idx"], "left_semi")


def _named(fields: Column, names: list[str]) -> Column:
    """First of the names which a field bears, in any case; a later spelling replaces an earlier."""
    hits = F.transform(
        F.array(*[F.lit(n) for n in names]),
        lambda n: F.try_element_at(F.filter(fields, lambda f: F.lower(f["key"]) == n), F.lit(-1))["key"],
    )
    return F.get(F.filter(hits, lambda k: k.isNotNull()), F.lit(0))


def _longest(fields: Column) -> Column:
    """Key of the longest text; the earliest wins a tie, and empty texts never do."""
    sized = F.transform(
        fields, lambda f, i: F.struct(F.char_length(f["text"]).alias("n"), (-i).alias("i"), f["key"].alias("key"))
    )
    top = F.array_max(sized)
    return F.when(top["n"] > 0, top["key"])


def field_roles(first: DataFrame) -> DataFrame:
    """Primary, context and options field per dataset, from its first row's fields."""
    fields = F.col("fields")
    return first.select(
        "dataset_id",
        F.coalesce(_named(fields, PRIMARY), _longest(fields)).alias("prim"),
        _named(fields, CONTEXT).alias("ctx"),
        _named(fields, OPTIONS).alias("opt"),
        F.transform("fields", lambda f: f["key"]).alias("first_keys"),
    )


def with_fields(rows: DataFrame) -> DataFrame:
    return rows.select("dataset_id", "row_idx", once(flatten_row("row_json")).alias("fields"))


def assembled(fields: Column, prim: Column, ctx: Column, opt: Column, sec: Column) -> Column:
    """Context, primary and options text joined and cut; then the secondary text."""
    def part(key: Column) -> Column:
        return F.nullif(strip(field_text(fields, key)), F.lit(""))

    options = F.concat(F.lit("Options:\n"), F.substring(part(opt), 1, OPTIONS_CHARS))
    body = F.concat_ws("\n\n", F.substring(part(ctx), 1, CONTEXT_CHARS), part(prim), options)
    more = F.concat(F.lit("\n\n"), F.substring(part(sec), 1, SECONDARY_CHARS))
    return strip(F.concat(strip(F.substring(body, 1, MAX_CHARS)), F.coalesce(more, F.lit(""))))


def assemble_rows(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Text of every row of the datasets in `roles` (prim, ctx, opt, sec)."""
    small = roles.select("dataset_id", "prim", "ctx", "opt", "sec")
    joined = with_fields(rows).join(broadcast_if_small(small, 512), "dataset_id")
    text = assembled(*[F.col(c) for c in ("fields", "prim", "ctx", "opt", "sec")])
    return joined.select("dataset_id", "row_idx", once(text).alias("text"))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """One key per distinct long-enough text of a dataset; the first row keeps it.

    Copies collapse map-side: a text which makes up a third of a dataset is one row per task.
    """
    n = F.char_length("text")
    return (
        texts.filter(n >= MIN_CHARS)
        .select("dataset_id", "row_idx", F.md5("text").alias("text_md5"), n.alias("n_chars"))
        .groupBy("dataset_id", "text_md5", "n_chars")
        .agg(F.min("row_idx").alias("row_idx"))
    )


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The value at place n//2 of a group's sorted values, from their histogram."""
    bins = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*keys)
    running = F.sum("_c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return (
        bins.withColumn("_upto", running)
        .withColumn("n", F.sum("_c").over(group))
        .filter(F.col("_upto") > F.floor(F.col("n") / 2))
        .groupBy(*keys)
        .agg(F.max("n").alias("n"), F.min(value).alias(name))
    )


def secondary_fields(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Per dataset the other field with the most distinct values, if those are long enough.

    Values are compared by their first characters; a row without the field counts as empty.
    """
    used = F.array_compact(F.array("prim", "ctx", "opt"))
    other = roles.select(
        "dataset_id", F.posexplode("first_keys").alias("key_pos", "key"), used.alias("used")
    ).filter(~F.array_contains("used", F.col("key")))
    value = F.substring(field_text(F.col("fields"), F.col("key")), 1, COMPARED_CHARS)
    values = (
        with_fields(rows)
        .join(broadcast_if_small(other.drop("used"), 512), "dataset_id")
        .select("dataset_id", "key_pos", "key", value.alias("value"))
        .distinct()
        .withColumn("n_chars", F.char_length("value"))
    )
    measured = upper_median(values, ["dataset_id", "key_pos", "key"], "n_chars", "med")
    return (
        measured.filter(F.col("med") >= MIN_SECONDARY_MEDIAN)
        .groupBy("dataset_id")
        .agg(F.max_by("key", F.struct(F.col("n"), -F.col("key_pos"))).alias("sec"))
    )


def sample_texts(keys: DataFrame, most: int = MAX_PER_DATASET, seed: int = 0) -> DataFrame:
    """Up to `most` texts per dataset, drawn by hash order."""
    draw = draw_key(seed, F.col("dataset_id"), F.col("row_idx"))
    order = Window.partitionBy("dataset_id").orderBy(draw, "row_idx")
    return keys.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).drop("_rn")


def mapping_log(sampled: DataFrame, roles: DataFrame) -> DataFrame:
    """Per dataset its fields, texts, upper median length, and whether it is kept."""
    measured = upper_median(sampled, ["dataset_id"], "n_chars", "median_chars")
    kept = (F.col("n_texts") >= MIN_PER_DATASET) & (F.col("median_chars") >= MIN_MEDIAN)
    return (
        roles.join(measured, "dataset_id", "left")
        .select(
            "dataset_id",
            F.concat_ws("+", "ctx", "prim", "opt", "sec").alias("fields"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_texts"),
            F.coalesce("median_chars", F.lit(0)).alias("median_chars"),
        )
        .withColumn("status", F.when(kept, "ok").otherwise("dropped"))
    )


@dataclass(frozen=True)
class Corpus:
    texts: DataFrame
    log: DataFrame


def build_probe_texts(
    rows: DataFrame, clusters: DataFrame, most: int = MAX_PER_DATASET, seed: int = 0
) -> Corpus:
    """Rows (dataset_id, row_idx, row_json) and dataset tags to tagged, deduplicated texts."""
    clusters = materialize(clusters)
    rows = tagged_rows(rows, clusters)
    roles = materialize(
        field_roles(with_fields(first_rows(rows))).withColumn("sec", F.lit(None).cast("string"))
    )
    plain = materialize(distinct_texts(assemble_rows(rows, roles)))

    # Datasets whose primary text repeats get their most varied other field appended.
    enough = plain.groupBy("dataset_id").count().filter(F.col("count") >= MIN_PER_DATASET)
    thin = roles.join(enough, "dataset_id", "left_anti")
    thin_rows = rows.join(broadcast_if_small(thin.select("dataset_id"), 256), "dataset_id", "left_semi")
    second = materialize(secondary_fields(thin_rows, thin))
    widened = thin.drop("sec").join(second, "dataset_id")
    again = distinct_texts(assemble_rows(thin_rows, widened.select(*roles.columns)))
    keys = plain.join(second, "dataset_id", "left_anti").unionByName(again)

    sampled = materialize(sample_texts(keys, most, seed))
    roles = roles.drop("sec").join(second, "dataset_id", "left")
    log = materialize(mapping_log(sampled, roles))

    kept = sampled.join(log.filter("status = 'ok'").select("dataset_id"), "dataset_id", "left_semi")
    place = Window.partitionBy("dataset_id").orderBy("row_idx")
    numbered = kept.select(
        "dataset_id", "row_idx",
        F.concat_ws("::", "dataset_id", F.row_number().over(place) - 1).alias("uid"),
    )
    numbered = broadcast_if_small(numbered, 256)
    chosen = rows.join(numbered.select("dataset_id", "row_idx"), ["dataset_id", "row_idx"], "left_semi")
    texts = (
        assemble_rows(chosen, roles)
        .join(numbered, ["dataset_id", "row_idx"])
        .join(clusters, "dataset_id")
        .select("uid", "dataset_id", "clusters", "text")
    )
    return Corpus(texts, log)


def coverage(texts: DataFrame) -> DataFrame:
    """Texts per capability, and whether they are too few."""
    return (
        texts.select(F.explode("clusters").alias("cluster_id"))
        .groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_texts"))
        .withColumn("weak", F.col("n_texts") < WEAK_TEXTS)
    )


def coverage_summary(texts: DataFrame) -> DataFrame:
    return coverage(texts).agg(
        F.count(F.lit(1)).alias("covered"),
        F.min("n_texts").alias("min_texts"),
        F.count_if("weak").alias("n_weak"),
    )
