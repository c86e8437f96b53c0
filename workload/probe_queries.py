"""Queries on hidden states: sampling, folds, directions and probe protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsonde.functions.numbering import average_rank
from capsonde.functions.scalars import tier
from capsonde.operators import directions as D
from capsonde.operators import lobo as L
from capsonde.operators import reports as R
from capsonde.operators import sampling as S
from capsonde.session import materialize, scratch_path
from capsonde.sources.shards import read_shards, write_shards
from workload import inputs as I
from workload import sql_probe as Q
from workload.registry import query, with_ctes


def protocol(spark: SparkSession, sf: str, *kinds: str) -> L.Protocol:
    return L.Protocol(
        I.hidden(spark, sf), I.probe_texts(spark, sf), kinds, per_dataset=I.NEGATIVES
    )


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, places) + F.lit(0.0))
    return df


@query("c1_hidden_text_join", with_ctes(Q.TEXTS, Q.HIDDEN, body="""
SELECT layer, dataset_id, count(*) AS n, round(sum(ln(1 + n_chars)), 6) AS log_len
FROM hidden JOIN texts USING (uid) GROUP BY ALL"""))
def c1(spark, sf):
    hidden, texts = I.hidden(spark, sf), I.probe_texts(spark, sf)
    joined = hidden.join(texts.select("uid", "dataset_id", "n_chars"), "uid")
    return rounded(
        joined.groupBy("layer", "dataset_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.log1p("n_chars")).alias("log_len")
        ),
        "log_len",
    )


@query("a5_numpy_shards", with_ctes(Q.HIDDEN, body="""
SELECT layer, uid, CAST(len(h) AS INTEGER) AS width, round(list_sum(CAST(h AS DOUBLE[])), 6) + 0 AS total
FROM hidden WHERE layer IN (1, 3)"""))
def a5_shards(spark, sf):
    """Two layers out of NumPy shards, to which all layers have been written."""
    path = scratch_path(spark, "shards")
    write_shards(I.hidden(spark, sf), path, 4)
    chosen = read_shards(spark, path).filter("tag = 'm' AND layer IN (1, 3)")
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(chosen.select("layer", "uid", F.size("h").alias("width"), total.alias("total")), "total")


@query("a5_hidden_load", with_ctes(Q.HIDDEN, body="""
SELECT layer, uid, CAST(len(h) AS INTEGER) AS width, d.source AS dataset_id,
       round(ln(1 + length(d.text)), 6) AS log_len
FROM hidden JOIN documents d ON uid = CAST(d.doc_id AS VARCHAR)"""))
def a5(spark, sf):
    from capsonde.sources.hidden import load_hidden

    texts = I.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("uid"),
        F.col("source").alias("dataset_id"),
        F.array("lang").alias("clusters"),
        "text",
    )
    loaded = load_hidden(I.hidden(spark, sf), texts)
    return rounded(
        loaded.select("layer", "uid", F.size("h").alias("width"), "dataset_id", "log_len"), "log_len"
    )


@query("c1_hidden_without_text", with_ctes(Q.HIDDEN, body="""
SELECT layer, count(*) AS dropped FROM hidden
WHERE uid NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) GROUP BY ALL"""))
def c1_dropped(spark, sf):
    from capsonde.sources.hidden import dropped_hidden

    texts = I.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("uid"))
    return dropped_hidden(I.hidden(spark, sf), texts).drop("tag")


@query("c7_negative_candidates", with_ctes(Q.TEXTS, Q.MEMBERS, Q.CANDIDATES, body="""
SELECT cluster_id, dataset_id, uid FROM cand"""))
def c7(spark, sf):
    return S.negative_candidates(I.probe_texts(spark, sf), I.NEGATIVES)


@query("e6_stratified_negatives", with_ctes(
    Q.TEXTS, Q.MEMBERS, Q.CANDIDATES, Q.SPLIT, body="""
SELECT cluster_id, dataset_id, uid, CAST(neg_rank AS INTEGER) AS neg_rank FROM split"""))
def e6(spark, sf):
    return S.negative_split(I.probe_texts(spark, sf), I.NEGATIVES).drop("part")


@query("e7_negative_halves", with_ctes(
    Q.TEXTS, Q.MEMBERS, Q.CANDIDATES, Q.SPLIT, body="""
SELECT cluster_id, part, count(*) AS n, min(uid) AS first_uid, max(uid) AS last_uid
FROM split GROUP BY ALL"""))
def e7(spark, sf):
    split = S.negative_split(I.probe_texts(spark, sf), I.NEGATIVES)
    return split.groupBy("cluster_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("uid").alias("first_uid"), F.max("uid").alias("last_uid")
    )


@query("e8_positive_halves", with_ctes(Q.TEXTS, Q.MEMBERS, Q.HALVES, body="""
SELECT cluster_id, uid, first_half FROM halves"""))
def e8(spark, sf):
    from capsonde.functions.scalars import draw_key

    texts = I.probe_texts(spark, sf)
    return S.members(texts).join(S.half_cuts(texts), "cluster_id").select(
        "cluster_id", "uid",
        (draw_key(0, F.col("cluster_id"), F.col("uid")) <= F.col("half_cut")).alias("first_half"),
    )


@query("e9_lobo_folds", with_ctes(Q.TEXTS, Q.MEMBERS, Q.FOLDS, body="""
SELECT cluster_id, hold, n_train, n_test, n_datasets FROM folds"""))
def e9(spark, sf):
    return S.folds(I.probe_texts(spark, sf))


@query("e9_fold_members", with_ctes(Q.TEXTS, Q.MEMBERS, Q.FOLDS, body="""
SELECT m.cluster_id, f.hold, m.uid, m.dataset_id,
       CASE WHEN m.dataset_id = f.hold THEN 'test' ELSE 'train' END AS part
FROM members m JOIN folds f USING (cluster_id)"""))
def e9_members(spark, sf):
    return S.fold_members(I.probe_texts(spark, sf))


@query("d18_dataset_counts", with_ctes(Q.TEXTS, Q.MEMBERS, body="""
SELECT cluster_id, count(*) AS n_pos, count(DISTINCT dataset_id) AS n_datasets
FROM members GROUP BY ALL"""))
def d18(spark, sf):
    return S.dataset_counts(I.probe_texts(spark, sf))


@query("d9_group_mean", with_ctes(Q.TEXTS, Q.MEMBERS, Q.HIDDEN, Q.LONG, body="""
SELECT layer, cluster_id, CAST(i - 1 AS INTEGER) AS dim, round(avg(x), 6) AS mean
FROM members JOIN long USING (uid) GROUP BY layer, cluster_id, i"""))
def d9(spark, sf):
    from capsonde.operators.pooled import member_means

    means = member_means(protocol(spark, sf, "lobo").moments)
    return rounded(
        means.select("layer", "cluster_id", F.posexplode("mean").alias("dim", "mean")), "mean"
    )


STATS_SQL = with_ctes(Q.HIDDEN, Q.LONG, Q.STATS, body="""
SELECT layer, CAST(i - 1 AS INTEGER) AS dim, round(mu, 6) AS mu, round(sd, 6) AS sd FROM stats""")


@query("d10_column_moments", STATS_SQL)
def d10(spark, sf):
    h = I.hidden(spark, sf).withColumn("clusters", F.array().cast("array<string>"))
    h = h.withColumn("dataset_id", F.lit("all"))
    for c in ("neg_train", "neg_test", "half"):
        h = h.withColumn(c, F.array().cast("array<string>"))
    scaling = D.standardiser(D.group_moments(h))
    return rounded(
        scaling.select("layer", F.posexplode(F.arrays_zip("mu", "sd")).alias("dim", "s")).select(
            "layer", "dim", "s.mu", "s.sd"
        ),
        "mu", "sd",
    )


@query("f1_standardise", with_ctes(Q.HIDDEN, Q.LONG, Q.STATS, Q.Z, body="""
SELECT layer, uid, CAST(i - 1 AS INTEGER) AS dim, round(z, 6) + 0 AS z FROM z"""))
def f1(spark, sf):
    from capsonde.operators.directions import standardise

    texts = I.probe_texts(spark, sf)
    z = standardise(I.hidden(spark, sf), texts)
    return rounded(z.select("layer", "uid", F.posexplode("z").alias("dim", "z")), "z")


@query("f2_diff_mean_directions", with_ctes(
    *Q.BASE, Q.FOLDS, Q.NEG_MEAN, Q.LOBO_DIR, body="""
SELECT layer, cluster_id, hold, CAST(i - 1 AS INTEGER) AS dim, round(v, 6) + 0 AS v FROM lobo_dir"""))
def f2(spark, sf):
    d = protocol(spark, sf, "lobo").of_kind("lobo")
    return rounded(
        d.select("layer", "cluster_id", "hold", F.posexplode("v").alias("dim", "v")), "v"
    )


@query("f3_projection", with_ctes(
    *Q.BASE, Q.FOLDS, Q.NEG_MEAN, Q.LOBO_DIR, Q.LOBO_SCORE, body="""
SELECT layer, cluster_id, hold, uid, y AS positive, round(s, 6) + 0 AS score FROM lobo_score"""))
def f3(spark, sf):
    p = protocol(spark, sf, "lobo")
    keys = p.directions.select("dir_id", "layer", "cluster_id", "hold")
    return rounded(p.scores("lobo").join(keys, "dir_id").drop("dir_id"), "score")


@query("f4_rank_sum_auc", """
SELECT l_returnflag, l_linenumber,
       round((sum(CASE WHEN y THEN r ELSE 0 END) - n_pos * (n_pos + 1) / CAST(2 AS DOUBLE))
             / (n_pos * n_neg), 6) AS auc,
       n_pos, n_neg
FROM (SELECT l_returnflag, l_linenumber, y,
             rank() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_extendedprice)
               + (count(*) OVER (PARTITION BY l_returnflag, l_linenumber, l_extendedprice) - 1)
                 / CAST(2 AS DOUBLE) AS r,
             count(*) FILTER (WHERE y) OVER (PARTITION BY l_returnflag, l_linenumber) AS n_pos,
             count(*) FILTER (WHERE NOT y) OVER (PARTITION BY l_returnflag, l_linenumber) AS n_neg
      FROM (SELECT *, l_linestatus = 'F' AS y FROM lineitem))
GROUP BY l_returnflag, l_linenumber, n_pos, n_neg""")
def f4(spark, sf):
    from capsonde.operators.auc import rank_sum_auc

    scored = I.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linenumber", "l_extendedprice",
        (F.col("l_linestatus") == "F").alias("y"),
    )
    return rounded(rank_sum_auc(scored, ["l_returnflag", "l_linenumber"], "l_extendedprice", "y"), "auc")


@query("e10_average_ranks", """
SELECT DISTINCT l_returnflag, l_quantity,
       count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS n_ties,
       rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
         + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / CAST(2 AS DOUBLE) AS avg_rank
FROM lineitem""")
def e10(spark, sf):
    return average_rank(I.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")


@query("f5_within_auc", with_ctes(
    *Q.BASE, Q.NEG_MEAN, Q.HALVES, Q.WITHIN,
    Q.pairwise_auc("within_auc", "within_score", "layer, cluster_id"), body="""
SELECT layer, cluster_id, round(auc, 6) AS auc, n_pos, n_neg FROM within_auc"""))
def f5(spark, sf):
    return rounded(L.within_auc(protocol(spark, sf, "within")).drop("tag"), "auc")


@query("f6_lobo_diff_mean", with_ctes(*Q.LOBO, body="""
SELECT layer, cluster_id, hold, round(auc, 6) AS auc, n_pos, n_neg FROM lobo_auc"""))
def f6(spark, sf):
    return rounded(L.lobo_folds(protocol(spark, sf, "lobo")).drop("tag"), "auc")


@query("d11_fold_mean_median", with_ctes(*Q.LOBO, body="""
SELECT layer, cluster_id, CAST(round_even(avg(auc), 3) AS DOUBLE) AS lobo,
       CAST(round_even(median(auc), 3) AS DOUBLE) AS lobo_med, count(*) AS n_folds
FROM lobo_auc GROUP BY ALL"""))
def d11(spark, sf):
    return L.fold_summary(L.lobo_folds(protocol(spark, sf, "lobo"))).drop("tag")


@query("f9_transfer_matrix", with_ctes(*Q.BASE, Q.SPEC, body="""
SELECT layer, cluster_id, direction, round(z_mean, 6) + 0 AS z_mean FROM matrix"""))
def f9(spark, sf):
    return rounded(L.transfer_matrix(protocol(spark, sf, "spec")).drop("tag"), "z_mean")


@query("e13_spec_rank", with_ctes(*Q.BASE, Q.SPEC, body="""
SELECT o.layer, o.cluster_id, count(*) AS spec_rank
FROM matrix o JOIN matrix m ON m.layer = o.layer AND m.direction = o.direction
  AND m.z_mean >= o.z_mean
WHERE o.cluster_id = o.direction GROUP BY ALL"""))
def e13(spark, sf):
    matrix = materialize(L.transfer_matrix(protocol(spark, sf, "spec")))
    return L.spec_rank(matrix).drop("tag")


@query("d15_spec_first", with_ctes(*Q.LOBO, Q.SPEC, body="""
SELECT layer, count(*) AS n_lobo, count(*) FILTER (WHERE spec_rank = 1) AS spec_first
FROM (SELECT o.layer, o.cluster_id, count(*) AS spec_rank
      FROM matrix o JOIN matrix m ON m.layer = o.layer AND m.direction = o.direction AND m.z_mean >= o.z_mean
      WHERE o.cluster_id = o.direction GROUP BY ALL)
JOIN (SELECT DISTINCT layer, cluster_id FROM lobo_auc WHERE auc IS NOT NULL) USING (layer, cluster_id) GROUP BY layer"""))
def d15_spec(spark, sf):
    p = protocol(spark, sf, "lobo", "spec")
    ranks = L.spec_rank(materialize(L.transfer_matrix(p)))
    summary = L.fold_summary(L.lobo_folds(p)).join(ranks, ["tag", "layer", "cluster_id"], "left")
    return R.tier_counts(summary).select("layer", "n_lobo", "spec_first")


@query("f10_length_confound", with_ctes(*Q.BASE, Q.NEG_MEAN, Q.FULL_DIR, Q.FULL_SCORE, body="""
SELECT layer, cluster_id, round(abs(corr(a, b)), 6) AS len_r, count(*) AS n_neg FROM (
  SELECT layer, cluster_id,
         rank() OVER (PARTITION BY layer, cluster_id ORDER BY s)
           + (count(*) OVER (PARTITION BY layer, cluster_id, s) - 1) / CAST(2 AS DOUBLE) AS a,
         rank() OVER (PARTITION BY layer, cluster_id ORDER BY n_chars)
           + (count(*) OVER (PARTITION BY layer, cluster_id, n_chars) - 1) / CAST(2 AS DOUBLE) AS b
  FROM full_score JOIN texts USING (uid)) GROUP BY ALL"""))
def f10(spark, sf):
    return rounded(L.length_confound(protocol(spark, sf, "full")).drop("tag"), "len_r")


# Chance level and the generalisation bar are parameters of the suspect rule; the fixture's
# capabilities generalise less than real ones, so the query states lower ones.
@query("f11_suspect_mappings", with_ctes(*Q.LOBO, body="""
SELECT layer, cluster_id, a.hold AS dataset_id, CAST(round_even(auc, 3) AS DOUBLE) AS auc, lobo_med
FROM lobo_auc a JOIN (SELECT layer, cluster_id, CAST(round_even(median(auc), 3) AS DOUBLE) AS lobo_med
                      FROM lobo_auc GROUP BY ALL) USING (layer, cluster_id)
WHERE lobo_med >= 0.5 AND round_even(auc, 3) < 0.5"""))
def f11(spark, sf):
    folds = materialize(L.lobo_folds(protocol(spark, sf, "lobo")))
    return L.suspects(folds, L.fold_summary(folds), bar=0.5).drop("tag")


@query("e11_best_layer", with_ctes(*Q.LOBO, body="""
SELECT layer AS best_layer, round(score, 6) AS score FROM (
  SELECT layer, avg(m) AS score FROM (
    SELECT layer, cluster_id, CAST(round_even(median(auc), 3) AS DOUBLE) AS m
    FROM lobo_auc GROUP BY ALL) GROUP BY ALL)
ORDER BY score DESC, layer LIMIT 1"""))
def e11(spark, sf):
    p = protocol(spark, sf, "lobo", "within")
    cells = R.layer_cells(L.fold_summary(L.lobo_folds(p)), L.within_auc(p))
    return rounded(R.best_layer(cells).drop("tag"), "score")


@query("d15_tier_counts", with_ctes(*Q.LOBO, body="""
SELECT layer, count(*) AS n_lobo, count(*) FILTER (WHERE m >= 0.8) AS strong,
       count(*) FILTER (WHERE m >= 0.65 AND m < 0.8) AS moderate, count(*) FILTER (WHERE m < 0.65) AS weak,
       round(avg(m), 6) AS mean_median
FROM (SELECT layer, cluster_id, CAST(round_even(median(auc), 3) AS DOUBLE) AS m
      FROM lobo_auc GROUP BY ALL) GROUP BY ALL"""))
def d15(spark, sf):
    summary = L.fold_summary(L.lobo_folds(protocol(spark, sf, "lobo")))
    return rounded(R.tier_counts(summary).drop("tag"), "mean_median")


@query("b21_tier_label", with_ctes(*Q.LOBO, body="""
SELECT c.cluster_id, l.layer, m AS lobo_med,
       CASE WHEN m IS NULL THEN 'no-lobo' WHEN m >= 0.8 THEN 'strong'
            WHEN m >= 0.65 THEN 'moderate' ELSE 'weak' END AS tier
FROM (SELECT DISTINCT cluster_id FROM members) c CROSS JOIN (SELECT DISTINCT layer FROM hidden) l
LEFT JOIN (SELECT layer, cluster_id, CAST(round_even(median(auc), 3) AS DOUBLE) AS m
           FROM lobo_auc GROUP BY ALL) s ON s.cluster_id = c.cluster_id AND s.layer = l.layer"""))
def b21(spark, sf):
    p = protocol(spark, sf, "lobo", "within")
    cells = R.layer_cells(L.fold_summary(L.lobo_folds(p)), L.within_auc(p))
    return cells.select("cluster_id", "layer", "lobo_med", tier(F.col("lobo_med")).alias("tier"))
