"""Queries which run whole flows: the probe sweep, the cleaning loop, the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from capsonde.operators import cleaning as C
from capsonde.operators.lobo import Protocol
from capsonde.plans import cleaning_loop, probing
from capsonde.session import materialize, scratch_path
from capsonde.sources import hidden as H
from capsonde.sources import jsonl
from capsonde.streaming import judgments as ST
from workload import inputs as I
from workload import sql_probe as Q
from workload.judge_queries import JUDGED, RAW
from workload.probe_queries import protocol, rounded
from workload.registry import query, with_ctes

CELLS = with_ctes(
    *Q.LOBO, Q.HALVES, Q.WITHIN, Q.pairwise_auc("within_auc", "within_score", "layer, cluster_id"),
    Q.FULL_DIR, Q.FULL_SCORE, """
len_r AS (
  SELECT layer, cluster_id, abs(corr(a, b)) AS len_r FROM (
    SELECT layer, cluster_id,
           rank() OVER (PARTITION BY layer, cluster_id ORDER BY s)
             + (count(*) OVER (PARTITION BY layer, cluster_id, s) - 1) / CAST(2 AS DOUBLE) AS a,
           rank() OVER (PARTITION BY layer, cluster_id ORDER BY n_chars)
             + (count(*) OVER (PARTITION BY layer, cluster_id, n_chars) - 1) / CAST(2 AS DOUBLE) AS b
    FROM full_score JOIN texts USING (uid)) GROUP BY ALL)""", body="""
SELECT w.layer, w.cluster_id, CAST(round_even(w.auc, 3) AS DOUBLE) AS within,
       CAST(round_even(avg(l.auc), 3) AS DOUBLE) AS lobo, CAST(round_even(median(l.auc), 3) AS DOUBLE) AS lobo_med,
       count(*) AS n_folds, CAST(round_even(any_value(r.len_r), 3) AS DOUBLE) AS len_r,
       (SELECT count(*) FROM members m WHERE m.cluster_id = w.cluster_id) AS n_pos,
       (SELECT count(DISTINCT dataset_id) FROM members m WHERE m.cluster_id = w.cluster_id) AS n_datasets
FROM within_auc w JOIN lobo_auc l ON l.layer = w.layer AND l.cluster_id = w.cluster_id
JOIN len_r r ON r.layer = w.layer AND r.cluster_id = w.cluster_id
GROUP BY w.layer, w.cluster_id, w.auc""")


@query("f6_probe_cells", CELLS)
def probe_cells(spark, sf):
    _, cells = probing.layer_sweep(protocol(spark, sf, "lobo", "within", "full"))
    return cells.drop("tag")


@query("f6_probe_sweep")
def probe_sweep(spark, sf):
    out = probing.sweep(I.hidden(spark, sf), I.probe_texts(spark, sf), I.NEGATIVES)
    return out.results.drop("tag")


MANUAL = [("cap0", "b0_0"), ("par1", "b1_2")]


@query("loop_second_sweep", with_ctes(Q.TEXTS, Q.MEMBERS, Q.HIDDEN, body="""
SELECT layer, cluster_id, count(*) AS n_pos, count(DISTINCT dataset_id) AS n_datasets
FROM (SELECT * FROM members WHERE (cluster_id, dataset_id) NOT IN (('cap0', 'b0_0'), ('par1', 'b1_2')))
CROSS JOIN (SELECT DISTINCT layer FROM hidden) GROUP BY ALL"""))
def loop_second_sweep(spark, sf):
    """Sweep, votes and hand-picked removals, patched texts, and the sweep over those.

    One model is too few for a vote, so only the mappings picked by hand go."""
    hidden, texts = I.hidden(spark, sf), I.probe_texts(spark, sf)
    first = probing.sweep(hidden, texts, I.NEGATIVES)
    matches = spark.createDataFrame([], "benchmark string, match string, clusters array<string>, note string")
    manual = spark.createDataFrame(MANUAL, "cluster_id string, dataset_id string")
    patched = cleaning_loop.clean(first, texts, matches, manual).texts.drop("patched")
    again = Protocol(hidden, materialize(patched), ("lobo", "within", "full"), per_dataset=I.NEGATIVES)
    _, cells = probing.layer_sweep(again)
    return cells.select("layer", "cluster_id", "n_pos", "n_datasets")


@query("a12_patched_table", """
SELECT l_returnflag AS dataset_id, count(*) AS n, count(*) FILTER (WHERE bad) AS patched
FROM (SELECT l_returnflag, (l_returnflag, l_linenumber) IN
        (SELECT (l_returnflag, l_linenumber) FROM lineitem WHERE l_extendedprice > 104500) AS bad FROM lineitem)
GROUP BY ALL""")
def a12(spark, sf):
    """The patched table is written beside the old one and read back whole."""
    path = scratch_path(spark, "patched")
    line = I.table(spark, sf, "lineitem")
    texts = line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", F.monotonically_increasing_id()).alias("uid"),
        F.col("l_returnflag").alias("dataset_id"),
        F.array(F.format_string("cap%d", "l_linenumber")).alias("clusters"),
    )
    removed = line.filter("l_extendedprice > 104500").select(
        F.format_string("cap%d", "l_linenumber").alias("cluster_id"), F.col("l_returnflag").alias("dataset_id")
    ).distinct()
    C.patch_texts(texts, removed).write.parquet(path)
    return spark.read.parquet(path).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("patched").alias("patched")
    )


@query("a14_vector_sink", with_ctes(Q.HIDDEN, Q.LONG, body="""
SELECT layer, uid, CAST(i - 1 AS INTEGER) AS dim, round(x, 6) + 0 AS value FROM long"""))
def a14(spark, sf):
    path = scratch_path(spark, "vectors")
    H.write_vectors(I.hidden(spark, sf), "h", path)
    read = spark.read.parquet(path).drop("tag").withColumn("value", F.col("value").cast("double"))
    return rounded(read, "value")


@query("a5_stored_by_layer", with_ctes(Q.HIDDEN, body="""
SELECT layer, count(*) AS n, CAST(sum(len(h)) AS BIGINT) AS width FROM hidden WHERE layer IN (1, 3) GROUP BY ALL"""))
def a5_stored(spark, sf):
    path = scratch_path(spark, "hidden")
    H.write_hidden(I.hidden(spark, sf), path)
    read = H.read_hidden(spark, path, tags=["m"], layers=[1, 3])
    return read.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("h")).alias("width"))


def streamed(spark, sf, name):
    source, out, state = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    results = I.judge_results(spark, sf).withColumn("elapsed_sec", F.lit(0.5))
    jsonl.write_jsonl(results.repartition(4, "pos"), source)
    ST.refine_stream(ST.read_results(spark, source, per_trigger=2), out, state).awaitTermination()
    return ST.read_output(spark, out, name).drop("batch")


@query("j1_streamed_judgments", with_ctes(JUDGED, body="""
SELECT pos, cluster_id, family, fit AS representation_fit, CAST(pos % 5 + 1 AS INTEGER) AS fit_score
FROM judged WHERE outcome = 'parsed'"""))
def j1_streamed(spark, sf):
    return streamed(spark, sf, "judgments").select(
        "pos", "cluster_id", "family", "representation_fit", "fit_score"
    )


@query("j2_streamed_abilities", with_ctes(JUDGED, RAW, body="""
SELECT pos, ability_index, source_cluster_id, ability_name, md5(definition) AS definition_md5 FROM raw"""))
def j2_streamed(spark, sf):
    return streamed(spark, sf, "abilities").select(
        "pos", "ability_index", "source_cluster_id", "ability_name", F.md5("definition").alias("definition_md5")
    )


@query("j1_streamed_rejects", with_ctes(JUDGED, body="""
SELECT pos, 'r' || pos AS cluster_id, outcome,
       CASE WHEN failed THEN 'timed out' ELSE 'not a JSON object' END AS error
FROM judged WHERE outcome <> 'parsed'"""))
def j1_streamed_rejects(spark, sf):
    return streamed(spark, sf, "rejects").drop("text")
