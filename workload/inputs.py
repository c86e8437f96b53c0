"""Input tables of the registered queries, derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEGATIVES = 5  # per-dataset cap of the registered probe queries


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hidden(spark: SparkSession, sf: str) -> DataFrame:
    """Three layers of one model: the two halves of an embedding, and all of it."""
    e = table(spark, sf, "embeddings")
    views = F.array(
        F.struct(F.lit(1).alias("layer"), F.slice("embedding", 1, 32).alias("h")),
        F.struct(F.lit(2).alias("layer"), F.slice("embedding", 33, 32).alias("h")),
        F.struct(F.lit(3).alias("layer"), F.col("embedding").alias("h")),
    )
    return e.select(
        F.lit("m").alias("tag"), F.col("vec_id").cast("string").alias("uid"), F.inline(views)
    ).select("tag", "layer", "uid", "h")


def probe_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the hidden states: three datasets per label, two capability tags each."""
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents").select("doc_id", "text")
    return e.join(d, e.vec_id == d.doc_id, "left").select(
        F.col("vec_id").cast("string").alias("uid"),
        F.format_string("b%d_%d", "label", F.col("vec_id") % 3).alias("dataset_id"),
        F.array(
            F.format_string("cap%d", "label"), F.format_string("par%d", F.col("label") % 2)
        ).alias("clusters"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"),
    )


def thousandths(total) -> "F.Column":
    """An integer sum as a score in [0, 1) with three exact places."""
    return (total % 1000) / F.lit(1000.0)


def method_results(spark: SparkSession, sf: str) -> DataFrame:
    """Wide method table: seven models, four depths, twenty capabilities, some scores missing."""
    grouped = table(spark, sf, "lineitem").groupBy(
        F.format_string("m%d", "l_linenumber").alias("tag"),
        (8 * (1 + F.col("l_suppkey") % 4)).cast("int").alias("layer"),
        F.format_string("cap%d", F.col("l_partkey") % 20).alias("cluster_id"),
    )
    return grouped.agg(
        thousandths(F.sum("l_orderkey")).alias("diffmean"),
        thousandths(F.sum("l_partkey")).alias("pca"),
        F.when(F.sum("l_orderkey") % 17 != 0, thousandths(F.sum("l_suppkey"))).alias("lr"),
    )


def fold_results(spark: SparkSession, sf: str) -> DataFrame:
    """Best-layer fold scores of ten models; one mapping in nine scores low everywhere."""
    line = table(spark, sf, "lineitem")
    cap, ds = F.col("l_partkey") % 20, F.col("l_suppkey") % 25
    total = F.sum("l_orderkey")
    return (
        line.groupBy((F.col("l_orderkey") % 10).alias("m"), cap.alias("c"), ds.alias("d"))
        .agg(total.alias("s"))
        .select(
            F.format_string("m%d", "m").alias("tag"),
            F.format_string("cap%d", "c").alias("cluster_id"),
            F.format_string("d%d", "d").alias("dataset_id"),
            (
                F.when((F.col("c") + F.col("d")) % 9 == 0, 300 + F.col("s") % 301)
                .otherwise(400 + F.col("s") % 601) / F.lit(1000.0)
            ).alias("auc"),
        )
    )


def manual_removals(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-listed mappings: the large parts' (capability, dataset) pairs of one brand."""
    return (
        table(spark, sf, "part")
        .filter((F.col("p_brand") == "Brand#2") & (F.col("p_size") >= 45))
        .select(
            F.format_string("cap%d", F.col("p_partkey") % 20).alias("cluster_id"),
            F.format_string("d%d", F.col("p_size") % 25).alias("dataset_id"),
        )
        .distinct()
    )


def dataset_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark records matched to datasets, each naming one or two capabilities."""
    c = table(spark, sf, "customer")
    one = F.format_string("First skill (cap%d)", F.col("c_custkey") % 20)
    two = F.format_string("Second skill (cap%d)", (F.col("c_custkey") * 7 + 3) % 20)
    return c.select(
        F.col("c_name").alias("benchmark"),
        F.col("c_custkey").alias("pos"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("clusters"),
        F.when(F.col("c_custkey") % 13 != 0, F.format_string("d%d", F.col("c_custkey") % 25)).alias("match"),
        F.lit(None).cast("string").alias("note"),
    )


def tagged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as texts: each source is a dataset with two capability tags."""
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return table(spark, sf, "documents").select(
        F.concat_ws("::", "source", "doc_id").alias("uid"),
        F.format_string("d%d", n).alias("dataset_id"),
        F.array(
            F.format_string("cap%d", n % 9), F.format_string("cap%d", 9 + (n * 7) % 11)
        ).alias("clusters"),
        "text",
    )


def judge_results(spark: SparkSession, sf: str) -> DataFrame:
    """One judged reply per document, in eight shapes: plain, fenced, embedded, broken, ..."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    shape = k % 8
    own = F.when(shape != 6, F.concat(F.lit("j"), k.cast("string")))
    none = F.lit(None).cast("string")
    first = F.struct(
        F.concat("source", F.when(k % 3 == 0, " Skill").when(k % 3 == 1, "-skill").otherwise("_SKILL!")).alias("ability_name"),
        F.when(k % 4 != 1, F.upper("source")).alias("display_name"),
        F.when(k % 2 == 0, F.col("lang")).alias("representation_family"),
        F.col("text").alias("definition"),
        F.concat(F.lit("state "), F.col("lang")).alias("positive_state"),
        F.when(k % 5 == 0, "narrow").when(k % 5 <= 2, "cross_benchmark").alias("generality"),
        F.when(k % 7 == 0, "no").otherwise("yes").alias("contrast_pair_feasibility"),
        F.array(F.col("lang"), F.concat(F.lit("b"), (k % 10).cast("string"))).alias("source_benchmark_examples"),
    )
    second = F.struct(
        F.concat("lang", F.lit(" fluency")).alias("ability_name"),
        none.alias("display_name"),
        none.alias("representation_family"),
        F.concat(F.lit("fluency in "), F.col("lang")).alias("definition"),
        none.alias("positive_state"),
        F.lit("family_specific").alias("generality"),
        none.alias("contrast_pair_feasibility"),
        F.array(F.col("source")).alias("source_benchmark_examples"),
    )
    found = F.when(shape != 5, F.when(k % 3 == 0, F.array(first, second)).otherwise(F.array(first)))
    fits = F.array(*[F.lit(x) for x in ("keep", "split", "merge", "drop")])
    reply = F.to_json(F.struct(
        own.alias("cluster_id"),
        F.when(shape != 6, F.col("lang")).alias("family"),
        F.when(shape != 6, F.get(fits, (k % 4).cast("int"))).alias("representation_fit"),
        (k % 5 + 1).alias("fit_score"),
        found.alias("latent_abilities"),
    ))
    text = (
        F.when(shape == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here is my judgment: "), reply, F.lit(" That is all.")))
        .when(shape == 3, F.lit('{"representation_fit": "keep", "fit_score":'))
        .when(shape == 4, F.concat(F.lit("["), reply, F.lit("]")))
        .when(shape == 7, F.concat(F.lit("\n```\n"), reply, F.lit("\n```\n")))
        .otherwise(reply)
    )
    failed = k % 11 == 5
    return d.select(
        k.alias("pos"),
        F.concat(F.lit("r"), k.cast("string")).alias("cluster_id"),
        F.col("source").alias("family"),
        F.col("n_chars").alias("size"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(~failed, text).alias("response_text"),
        F.when(failed, "timed out").alias("error"),
    )


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as capability mentions: the brand is the cluster, the key the file order."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("pos"),
        F.col("p_brand").alias("cluster_id"),
        F.concat(F.lit("Paper "), F.col("p_size").cast("string")).alias("paper_title"),
        F.col("p_name").alias("benchmark_name"),
        F.col("p_type").alias("task_name"),
        F.col("p_name").alias("canonical_name"),
        F.repeat(F.concat("p_name", F.lit("  of\t"), "p_type", F.lit("\n")), 40).alias("definition"),
        F.col("p_type").alias("cognitive_operation"),
        F.lit(None).cast("string").alias("surface_task"),
        F.col("p_name").alias("evaluated_behavior"),
        F.array("p_type").alias("agentic_dimensions"),
        F.lit(None).cast("array<string>").alias("domain_metadata"),
        F.when(F.col("p_size") > 25, "high").otherwise("low").alias("confidence"),
    )


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as clusters with their part types by count; every brand of the nations' range."""
    p = table(spark, sf, "part")
    types = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    lists = types.groupBy("p_brand").agg(
        F.sum("n").alias("size"),
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p_type"))),
            lambda e: F.struct(e["p_type"].alias("name"), (-e["m"]).alias("count")),
        ).alias("pairs"),
    )
    brands = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("pos"),
        F.format_string("Brand#%d", F.col("n_nationkey") + 5).alias("p_brand"),
        F.format_string("family_%d", F.col("n_regionkey")).alias("family"),
    )
    return brands.join(lists, "p_brand", "left").select(
        "pos", F.col("p_brand").alias("cluster_id"), "family", F.coalesce("size", F.lit(0)).alias("size"),
        *[F.col("pairs").alias(c) for c in (
            "top_capability_names", "top_operation_terms", "top_agentic_dimensions", "top_domains",
            "top_target_model_types", "top_benchmarks", "top_tasks",
        )],
    )


def dataset_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw dataset rows: four shapes by source, and two kinds of repeating ones."""
    d = table(spark, sf, "documents")
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 4
    shaped = (
        F.when(n == 0, F.to_json(F.struct("doc_id", F.col("text").alias("Question"), "lang")))
        .when(n == 1, F.to_json(F.struct(
            F.col("text").alias("Text"), F.concat(F.lit("About "), "lang", F.lit(" in "), "source").alias("context"))))
        .when(n == 2, F.to_json(F.struct(
            F.col("text").alias("prompt"),
            F.expr("parse_json(concat('[\"', lang, '\", 7, \"', source, '\"]'))").alias("options"))))
        .otherwise(F.to_json(F.struct("doc_id", F.col("text").alias("body"), F.col("lang").alias("note"))))
    )
    premise = F.concat(F.lit("One premise for every row of "), "source", F.lit(" to be judged"))
    nli = F.to_json(F.struct(
        premise.alias("premise"), F.col("text").alias("hypothesis"), F.col("lang").alias("label")))
    thin = F.to_json(F.struct(
        F.concat(F.lit("Which language is this: "), "lang", F.lit("? Answer in full.")).alias("question")))
    each = F.array(
        F.struct(F.col("source").alias("dataset_id"), shaped.alias("row_json")),
        F.struct(F.concat(F.lit("nli/"), "source").alias("dataset_id"), nli.alias("row_json")),
        F.struct(F.concat(F.lit("thin/"), "lang").alias("dataset_id"), thin.alias("row_json")),
    )
    return d.select(F.col("doc_id").alias("row_idx"), F.inline(each)).select(
        "dataset_id", "row_idx", "row_json"
    )


def experiment_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Capabilities with their datasets; one source failed, one has no file."""
    sources = table(spark, sf, "documents").select("source").distinct()
    langs = table(spark, sf, "documents").select("lang").distinct()
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    dataset = F.struct(
        F.col("dataset").alias("hf_dataset"),
        F.when(F.col("dataset") == "src19", "error").otherwise("ok").alias("status"),
        F.when(F.col("dataset") != "src18", F.concat("dataset", F.lit(".jsonl"))).otherwise("").alias("file"),
    )
    named = sources.select(
        F.explode(F.array("source", F.concat(F.lit("nli/"), "source"))).alias("dataset"),
        F.array(F.format_string("cap%d", n % 9), F.format_string("cap%d", 9 + (n * 7) % 11)).alias("c"),
    ).unionByName(
        langs.select(F.concat(F.lit("thin/"), "lang").alias("dataset"), F.array(F.lit("cap0")).alias("c"))
    )
    return (
        named.select("dataset", F.explode("c").alias("cluster_id"))
        .groupBy("cluster_id").agg(F.collect_list(dataset).alias("datasets"))
        .withColumn("cluster_name", F.concat(F.lit("skill "), "cluster_id"))
    )


def chat_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as one row holding its list of turns and two nested values."""
    c = table(spark, sf, "conversations")
    turns = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
        lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")),
    )
    return (
        c.groupBy("conv_id").agg(turns.alias("messages"))
        .select(
            F.col("conv_id").alias("row_idx"),
            F.lit("chat").alias("dataset_id"),
            F.to_json(F.struct(
                "conv_id", "messages",
                F.struct(F.struct(F.lit("x").alias("b"), F.struct(F.lit("lost").alias("c")).alias("d")).alias("a"),
                         F.lit(3).alias("n"), F.lit("y").alias("e")).alias("meta"),
            )).alias("row_json"),
        )
    )


def _vectors(spark: SparkSession, sf: str, start: int, stop: int):
    """Rows of the embedding table used as model weights: a fixed-size parameter."""
    import numpy as np

    e = table(spark, sf, "embeddings").filter(F.col("vec_id").between(start, stop - 1))
    return np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], dtype=np.float64)


SAE_FEATURES, LENS_TOKENS = 16, 8


def sae_encoders(spark: SparkSession, sf: str):
    """Layer 3: sixteen features, thresholds rising from 0; bias .01."""
    return {("m", 3): _encoder(_vectors(spark, sf, 0, SAE_FEATURES))}


def _encoder(vectors):
    import numpy as np

    from capsonde.operators.sparse import Encoder

    return Encoder(vectors.T, np.full(SAE_FEATURES, 0.01), 0.02 * np.arange(SAE_FEATURES))


def layered_encoders(spark: SparkSession, sf: str):
    """As `sae_encoders`, and layer 1 with the first half of the same weights."""
    w = _vectors(spark, sf, 0, SAE_FEATURES)
    return {("m", 3): _encoder(w), ("m", 1): _encoder(w[:, :32])}


def two_models(spark: SparkSession, sf: str) -> DataFrame:
    """Layer 3 of model m, and the same states as layer 3 of model n."""
    own = hidden(spark, sf).filter("layer = 3")
    return own.unionByName(own.withColumn("tag", F.lit("n")))


def short_model(spark: SparkSession, sf: str) -> DataFrame:
    """All layers of model m, and a model n whose layers 1 and 2 are the first halves of them."""
    own = hidden(spark, sf)
    short = own.filter("layer < 3").select(F.lit("n").alias("tag"), "layer", "uid", F.slice("h", 1, 16).alias("h"))
    return own.unionByName(short)


def two_encoders(spark: SparkSession, sf: str):
    """Different weights for the same layer of two models."""
    return {
        ("m", 3): _encoder(_vectors(spark, sf, 0, SAE_FEATURES)),
        ("n", 3): _encoder(_vectors(spark, sf, SAE_FEATURES, 2 * SAE_FEATURES)),
    }


def lens(spark: SparkSession, sf: str):
    """Layer 3 of model m: a 64 x 64 transport, eight tokens, a zero-centred norm and a soft cap."""
    import numpy as np

    from capsonde.operators.lens import Lens

    v = _vectors(spark, sf, 0, 64 + LENS_TOKENS + 1)
    return {"m": Lens(
        jacobians={3: v[:64]}, unembed=v[64:72], token_ids=[100 + i for i in range(LENS_TOKENS)],
        norm_weight=np.abs(v[72]), eps=1e-6, softcap=30.0, zero_centered=True,
    )}


def layered_lens(spark: SparkSession, sf: str):
    """As `lens`, and layer 1 through the first 32 columns of the same transport."""
    from dataclasses import replace

    one = lens(spark, sf)["m"]
    return {"m": replace(one, jacobians={3: one.jacobians[3], 1: one.jacobians[3][:, :32]})}


def two_lenses(spark: SparkSession, sf: str):
    """The lens of `lens`, and one with other matrices, norm and no soft cap for model n."""
    import numpy as np

    from capsonde.operators.lens import Lens

    v = _vectors(spark, sf, 0, 64 + LENS_TOKENS + 1)
    other = Lens(
        jacobians={3: v[:64].T.copy()}, unembed=v[64:72], token_ids=[100 + i for i in range(LENS_TOKENS)],
        norm_weight=np.ones(64), eps=1e-6,
    )
    return lens(spark, sf) | {"n": other}


def lens_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Two or three tokens per capability, in a stated order."""
    label = table(spark, sf, "embeddings").select("label").distinct()
    caps = label.select(
        F.format_string("cap%d", "label").alias("cluster_id"),
        F.array(*[(F.col("label") + k) % LENS_TOKENS + 100 for k in (0, 3, 5)]).alias("t"),
    )
    pars = label.select(
        F.format_string("par%d", F.col("label") % 2).alias("cluster_id"),
        F.array(*[F.col("label") % 2 + 100 + k for k in (0, 2)]).alias("t"),
    ).distinct()
    return caps.unionByName(pars).select(
        "cluster_id", F.posexplode("t").alias("order", "token_id")
    )


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Words of part names as tokens: even lengths after a blank, others only in pieces."""
    p = table(spark, sf, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    whole = words.filter(F.length("w") % 2 == 0).select(F.concat(F.lit(" "), "w").alias("text"))
    pieces = words.select(
        F.explode(F.array(F.substring("w", 1, 2), F.expr("substring(w, 3)"))).alias("text")
    )
    tokens = whole.unionByName(pieces).distinct()
    return tokens.select(
        F.pmod(F.crc32("text"), F.lit(1000003)).cast("int").alias("token_id"), "text",
        (F.length("text") == 1).alias("is_special"),
    )


def word_pieces(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    each = words.select("word", F.explode(F.array(F.substring("word", 1, 2), F.expr("substring(word, 3)"))).alias("text"))
    return each.join(vocabulary(spark, sf).select("text", "token_id"), "text").select("word", "token_id")
