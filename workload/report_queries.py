"""Queries on result tables: method comparison, best depth, voting and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from capsonde.operators import cleaning as C
from capsonde.operators import lobo as L
from capsonde.operators import reports as R
from workload import inputs as I
from workload.probe_queries import rounded
from workload.registry import query, with_ctes

RESULTS = """
results AS (
  SELECT 'm' || l_linenumber AS tag, CAST(8 * (1 + l_suppkey % 4) AS INTEGER) AS layer,
         'cap' || (l_partkey % 20) AS cluster_id,
         CAST(sum(l_orderkey) % 1000 AS DOUBLE) / 1000 AS diffmean,
         CAST(sum(l_partkey) % 1000 AS DOUBLE) / 1000 AS pca,
         CASE WHEN sum(l_orderkey) % 17 <> 0 THEN CAST(sum(l_suppkey) % 1000 AS DOUBLE) / 1000 END AS lr
  FROM lineitem GROUP BY l_linenumber, l_suppkey % 4, l_partkey % 20)
"""
CELLS = """
cells AS (
  SELECT tag, layer, cluster_id, 'diffmean' AS method, 0 AS method_no, diffmean AS auc FROM results
  UNION ALL SELECT tag, layer, cluster_id, 'pca', 1, pca FROM results
  UNION ALL SELECT tag, layer, cluster_id, 'lr', 2, lr FROM results)
"""
MEANS = """
means AS (
  SELECT tag, layer, method, count(*) AS n, avg(auc) AS mean, median(auc) AS median,
         count(*) FILTER (WHERE auc >= 0.8) AS strong
  FROM cells WHERE auc IS NOT NULL GROUP BY tag, layer, method)
"""
BEST = """
best AS (
  SELECT tag, method, mean AS auc, layer FROM means
  QUALIFY row_number() OVER (PARTITION BY tag, method ORDER BY mean DESC, layer) = 1)
"""
FOLD_AUCS = """
fold_aucs AS (
  SELECT 'm' || m AS tag, 'cap' || c AS cluster_id, 'd' || d AS dataset_id,
         CAST(CASE WHEN (c + d) % 9 = 0 THEN 300 + s % 301 ELSE 400 + s % 601 END AS DOUBLE) / 1000 AS auc
  FROM (SELECT l_orderkey % 10 AS m, l_partkey % 20 AS c, l_suppkey % 25 AS d, sum(l_orderkey) AS s
        FROM lineitem GROUP BY ALL))
"""
VOTES = """
able AS (SELECT tag, cluster_id FROM fold_aucs GROUP BY ALL
         HAVING round_even(median(auc), 3) >= 0.65),
votes AS (
  SELECT cluster_id, dataset_id, count(*) FILTER (WHERE auc < 0.5) AS suspect, count(*) AS eligible
  FROM fold_aucs JOIN able USING (tag, cluster_id) GROUP BY ALL)
"""
MANUAL = """
manual AS (
  SELECT DISTINCT 'cap' || (p_partkey % 20) AS cluster_id, 'd' || (p_size % 25) AS dataset_id
  FROM part WHERE p_brand = 'Brand#2' AND p_size >= 45)
"""
REMOVED = """
removed AS (
  SELECT cluster_id, dataset_id FROM votes
  WHERE eligible >= 3 AND suspect / CAST(eligible AS DOUBLE) >= 0.6
  UNION SELECT cluster_id, dataset_id FROM manual)
"""
DOCS = """
docs AS (
  SELECT source || '::' || doc_id AS uid, 'd' || n AS dataset_id,
         ['cap' || (n % 9), 'cap' || (9 + (n * 7) % 11)] AS clusters, text
  FROM (SELECT *, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS n FROM documents))
"""
MATCHES = """
matches AS (
  SELECT c_name AS benchmark,
         CASE WHEN c_nationkey % 2 = 0
              THEN ['First skill (cap' || (c_custkey % 20) || ')',
                    'Second skill (cap' || ((c_custkey * 7 + 3) % 20) || ')']
              ELSE ['First skill (cap' || (c_custkey % 20) || ')'] END AS clusters,
         CASE WHEN c_custkey % 13 <> 0 THEN 'd' || (c_custkey % 25) END AS match
  FROM customer)
"""


def cells(spark, sf):
    return R.long_methods(I.method_results(spark, sf))


@query("c9_methods_side_by_side", with_ctes(RESULTS, body="""
SELECT tag, layer, cluster_id, diffmean, pca, lr FROM results"""))
def c9(spark, sf):
    return R.wide_methods(cells(spark, sf))


@query("d14_method_means", with_ctes(RESULTS, CELLS, MEANS, body="""
SELECT tag, layer, method, n, round(mean, 6) AS mean, round(median, 6) AS median, strong FROM means"""))
def d14(spark, sf):
    return rounded(R.method_means(cells(spark, sf)), "mean", "median")


@query("e12_best_depth", with_ctes(RESULTS, CELLS, MEANS, BEST, body="""
SELECT tag, method, round(auc, 6) AS auc, layer FROM best"""))
def e12(spark, sf):
    best = R.best_depth(R.method_means(cells(spark, sf)))
    return rounded(best.drop("all_layers"), "auc")


@query("f20_best_depth_table", with_ctes(RESULTS, CELLS, MEANS, BEST, body="""
SELECT tag,
       round(max(auc) FILTER (WHERE method = 'diffmean'), 6) AS diffmean_auc,
       max(layer) FILTER (WHERE method = 'diffmean') AS diffmean_layer,
       round(max(auc) FILTER (WHERE method = 'pca'), 6) AS pca_auc,
       max(layer) FILTER (WHERE method = 'pca') AS pca_layer,
       round(max(auc) FILTER (WHERE method = 'lr'), 6) AS lr_auc,
       max(layer) FILTER (WHERE method = 'lr') AS lr_layer
FROM best GROUP BY tag"""))
def f20(spark, sf):
    best = R.best_depth(R.method_means(cells(spark, sf)))
    return rounded(R.best_depth_table(best, R.METHODS), "diffmean_auc", "pca_auc", "lr_auc")


@query("f20_every_depth", with_ctes(RESULTS, CELLS, MEANS, body="""
SELECT tag, method, layer AS depth, round(mean, 6) AS mean FROM means"""))
def f20_depths(spark, sf):
    best = R.best_depth(R.method_means(cells(spark, sf)))
    return rounded(best.select("tag", "method", F.explode("all_layers").alias("depth", "mean")), "mean")


@query("i4_method_wins", with_ctes(RESULTS, CELLS, MEANS, BEST, body="""
SELECT method, count(*) AS wins, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM (SELECT c.method FROM cells c JOIN best b USING (tag, method, layer) WHERE c.auc IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY c.tag, c.cluster_id ORDER BY c.auc DESC, method_no) = 1)
GROUP BY method"""))
def i4(spark, sf):
    all_cells = cells(spark, sf)
    best = R.best_depth(R.method_means(all_cells))
    return rounded(R.method_wins(R.cells_at_best_depth(all_cells, best)), "share")


@query("i6_score_summary", with_ctes(RESULTS, body="""
SELECT tag, count(lr) AS concepts, round(avg(lr), 6) AS mean_acc,
       count(*) FILTER (WHERE lr >= 0.8) AS ge_0_8, count(*) FILTER (WHERE lr < 0.7) AS lt_0_7
FROM results GROUP BY tag"""))
def i6_scores(spark, sf):
    return rounded(R.score_summary(I.method_results(spark, sf), "tag", "lr"), "mean_acc")


@query("i6_delta_summary", with_ctes(RESULTS, body="""
SELECT tag, count(d) AS concepts, round(avg(d), 6) AS mean_delta,
       count(*) FILTER (WHERE d > 0.05) AS positive, count(*) FILTER (WHERE d < -0.05) AS negative,
       count(*) FILTER (WHERE abs(d) <= 0.05) AS neutral
FROM (SELECT tag, lr - pca AS d FROM results) GROUP BY tag"""))
def i6_deltas(spark, sf):
    r = I.method_results(spark, sf).withColumn("d", F.col("lr") - F.col("pca"))
    return rounded(R.delta_summary(r, "tag", "d", band=0.05), "mean_delta")


@query("i6_transfer_summary", with_ctes(FOLD_AUCS, body="""
SELECT tag, count(auc) AS pairs, count(*) FILTER (WHERE auc > 0.5) AS positive_pairs,
       count(*) FILTER (WHERE auc > 0.55) AS success, round(avg(auc), 6) AS avg_acc
FROM fold_aucs GROUP BY tag"""))
def i6_transfer(spark, sf):
    return rounded(R.transfer_summary(I.fold_results(spark, sf), "tag", "auc"), "avg_acc")


@query("i7_ablation_deltas", """
SELECT l_linenumber AS model, round(b, 6) AS base, round(a - b, 6) + 0 AS "delta_A", round(r - b, 6) + 0 AS "delta_R"
FROM (SELECT l_linenumber, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS b,
             avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a,
             avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r
      FROM lineitem GROUP BY l_linenumber)""")
def i7(spark, sf):
    runs = I.table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "model")
    out = R.ablation_deltas(runs, "model", "l_returnflag", "l_quantity", "N", ["A", "R"])
    return rounded(out, "base", "delta_A", "delta_R")


@query("g3_report_order", with_ctes(RESULTS, body="""
SELECT cluster_id, tag, layer, lr,
       row_number() OVER (ORDER BY coalesce(lr, 0) DESC, cluster_id, tag, layer) AS position FROM results"""))
def g3(spark, sf):
    r = I.method_results(spark, sf).select("cluster_id", "tag", "layer", "lr")
    return R.numbered_by_score(r, "lr", "cluster_id", "tag", "layer")


@query("c5_results_with_taxonomy", with_ctes(RESULTS, body="""
SELECT r.cluster_id, tag, layer, diffmean, n_name AS cluster_name
FROM results r JOIN nation ON r.cluster_id = 'cap' || n_nationkey"""))
def c5(spark, sf):
    taxonomy = I.table(spark, sf, "nation").select(
        F.format_string("cap%d", "n_nationkey").alias("cluster_id"), F.col("n_name").alias("cluster_name")
    )
    results = I.method_results(spark, sf).select("tag", "layer", "cluster_id", "diffmean")
    return R.report_rows(results, taxonomy, "diffmean")


def voted(spark, sf):
    folds = I.fold_results(spark, sf)
    return C.votes(folds, L.fold_summary(folds, ["tag", "cluster_id"]))


@query("d12_mapping_votes", with_ctes(FOLD_AUCS, VOTES, body="""
SELECT cluster_id, dataset_id, suspect, eligible FROM votes"""))
def d12(spark, sf):
    return voted(spark, sf)


@query("d13_removed_mappings", with_ctes(FOLD_AUCS, VOTES, MANUAL, REMOVED, body="""
SELECT cluster_id, dataset_id FROM removed"""))
def d13(spark, sf):
    return C.removals(voted(spark, sf), I.manual_removals(spark, sf))


@query("d13_cleaning_log", with_ctes(FOLD_AUCS, VOTES, MANUAL, body="""
SELECT cluster_id, dataset_id, suspect, eligible,
       CASE WHEN eligible >= 3 AND suspect / CAST(eligible AS DOUBLE) >= 0.6 THEN 'removed' ELSE 'kept' END AS verdict
FROM votes WHERE suspect > 0
UNION ALL SELECT cluster_id, dataset_id, NULL, NULL, 'manual' FROM manual"""))
def d13_log(spark, sf):
    return C.cleaning_log(voted(spark, sf), I.manual_removals(spark, sf))


@query("g9_removal_union", with_ctes(FOLD_AUCS, VOTES, MANUAL, REMOVED, body="""
SELECT cluster_id, count(*) AS n_removed FROM removed GROUP BY cluster_id"""))
def g9(spark, sf):
    return d13(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_removed"))


@query("c6_patched_texts", with_ctes(FOLD_AUCS, VOTES, MANUAL, REMOVED, DOCS, body="""
SELECT uid, dataset_id, array_to_string(kept, ',') AS clusters, len(kept) < len(clusters) AS patched, md5(text) AS text_md5
FROM (SELECT *, list_filter(clusters, lambda c: NOT list_contains(coalesce(bad, []), c)) AS kept
      FROM docs LEFT JOIN (SELECT dataset_id, list(cluster_id) AS bad FROM removed GROUP BY ALL)
      USING (dataset_id))"""))
def c6(spark, sf):
    patched = C.patch_texts(I.tagged_documents(spark, sf), d13(spark, sf))
    return patched.select(
        "uid", "dataset_id", F.array_join("clusters", ",").alias("clusters"), "patched",
        F.md5("text").alias("text_md5"),
    )


@query("g8_untagged_after_cleaning", with_ctes(FOLD_AUCS, VOTES, MANUAL, REMOVED, DOCS, body="""
SELECT dataset_id, count(*) AS texts, count(*) FILTER (WHERE left_over = 0) AS untagged
FROM (SELECT d.uid, d.dataset_id, count(c.c) - count(r.cluster_id) AS left_over
      FROM docs d, unnest(d.clusters) c(c)
      LEFT JOIN removed r ON r.dataset_id = d.dataset_id AND r.cluster_id = c.c GROUP BY ALL)
GROUP BY dataset_id"""))
def g8(spark, sf):
    patched = C.patch_texts(I.tagged_documents(spark, sf), d13(spark, sf))
    return patched.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.size("clusters") == 0).alias("untagged")
    )


@query("b26_patched_matches", with_ctes(FOLD_AUCS, VOTES, MANUAL, REMOVED, MATCHES, body="""
SELECT benchmark, array_to_string(kept, ';') AS clusters, len(kept) < len(clusters) AS edited,
       CASE WHEN len(kept) < len(clusters) AND len(kept) = 0 THEN NULL ELSE match END AS match,
       CASE WHEN len(kept) < len(clusters) AND len(kept) = 0 THEN 'removed_by_probe_cleaning' END AS note
FROM (SELECT *, list_filter(clusters, lambda x: len(list_filter(coalesce(bad, []), lambda c: contains(x, '(' || c || ')'))) = 0) AS kept
      FROM matches LEFT JOIN (SELECT dataset_id AS match, list(cluster_id) AS bad FROM removed GROUP BY ALL)
      USING (match))"""))
def b26(spark, sf):
    patched = C.patch_matches(I.dataset_matches(spark, sf), d13(spark, sf))
    return patched.select(
        "benchmark", F.array_join("clusters", ";").alias("clusters"), "edited", "match", "note"
    )
