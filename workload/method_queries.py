"""Queries on sparse, lens, linear and pooled probes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from capsonde.operators import directions as D
from capsonde.operators import lens as N
from capsonde.operators import linear_probes as M
from capsonde.operators import lobo as L
from capsonde.operators import pooled as O
from capsonde.operators import reports as R
from capsonde.operators import sampling as S
from capsonde.operators import selection as X
from capsonde.operators import sparse as Z
from workload import inputs as I
from workload import sql_probe as Q
from workload.probe_queries import protocol, rounded
from workload.registry import query, with_ctes

ENCODED = """
enc AS (
  SELECT uid, w.j AS feature, CASE WHEN pre > 0.02 * w.j THEN greatest(pre, 0) ELSE 0 END AS s
  FROM (SELECT CAST(e.vec_id AS VARCHAR) AS uid, CAST(w.vec_id AS INTEGER) AS j,
               list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])) + 0.01 AS pre
        FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 16) w) w)
"""
LENS = """
moved AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS uid, j.vec_id + 1 AS i,
         list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(j.embedding AS DOUBLE[])) AS m
  FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 64) j),
normed AS (
  SELECT uid, i, m / sqrt(avg(m * m) OVER (PARTITION BY uid) + 1e-6)
           * (1 + abs(CAST((SELECT embedding FROM embeddings WHERE vec_id = 72)[i] AS DOUBLE))) AS m
  FROM moved),
enc AS (
  SELECT uid, CAST(t.vec_id - 64 + 100 AS INTEGER) AS feature,
         30 * tanh(sum(m * CAST(t.embedding[i] AS DOUBLE)) / 30) AS s
  FROM normed CROSS JOIN (SELECT * FROM embeddings WHERE vec_id BETWEEN 64 AND 71) t GROUP BY uid, t.vec_id),
wanted AS (
  SELECT DISTINCT 'cap' || label AS cluster_id, k.o AS "order", (label + k.d) % 8 + 100 AS feature
  FROM embeddings CROSS JOIN (VALUES (0, 0), (1, 3), (2, 5)) k(o, d)
  UNION SELECT DISTINCT 'par' || (label % 2), k.o, label % 2 + 100 + k.d
  FROM embeddings CROSS JOIN (VALUES (0, 0), (1, 2)) k(o, d))
"""


def sql_train(restrict: str = "") -> str:
    return f"""
train_pairs AS (
  SELECT f.cluster_id, f.hold, p.feature,
         avg(CASE WHEN p.s > n.s THEN 1 WHEN p.s = n.s THEN 0.5 ELSE 0 END) AS train_auc,
         max(p.s) + max(n.s) AS present
  FROM folds f
  JOIN members m ON m.cluster_id = f.cluster_id AND m.dataset_id <> f.hold
  JOIN enc p ON p.uid = m.uid
  JOIN split s ON s.cluster_id = f.cluster_id AND s.part = 'train'
  JOIN enc n ON n.uid = s.uid AND n.feature = p.feature
  {restrict}
  GROUP BY ALL)"""


SAE_BEST = """
best AS (
  SELECT cluster_id, hold, feature, CASE WHEN train_auc >= 0.5 THEN 1 ELSE -1 END AS sign,
         greatest(train_auc, 1 - train_auc) AS train_auc
  FROM train_pairs
  QUALIFY row_number() OVER (PARTITION BY cluster_id, hold ORDER BY greatest(train_auc, 1 - train_auc) DESC, feature) = 1)
"""
LENS_BEST = """
best AS (
  SELECT cluster_id, hold, feature, 1 AS sign, train_auc
  FROM train_pairs JOIN wanted USING (cluster_id, feature)
  QUALIFY row_number() OVER (PARTITION BY cluster_id, hold ORDER BY train_auc DESC, "order") = 1)
"""
HELD_OUT = """
held_out AS (
  SELECT b.cluster_id, b.hold, b.feature, b.sign, b.train_auc,
         avg(CASE WHEN b.sign * p.s > b.sign * n.s THEN 1 WHEN p.s = n.s THEN 0.5 ELSE 0 END) AS auc
  FROM best b
  JOIN members m ON m.cluster_id = b.cluster_id AND m.dataset_id = b.hold
  JOIN enc p ON p.uid = m.uid AND p.feature = b.feature
  JOIN split s ON s.cluster_id = b.cluster_id AND s.part = 'test'
  JOIN enc n ON n.uid = s.uid AND n.feature = b.feature
  GROUP BY ALL)
"""
SAMPLED = (Q.TEXTS, Q.MEMBERS, Q.CANDIDATES, Q.SPLIT, Q.FOLDS)
SAE = (*SAMPLED, ENCODED, sql_train())
LENS_ALL = (
    *SAMPLED, LENS,
    sql_train("JOIN wanted w ON w.cluster_id = f.cluster_id AND w.feature = p.feature"),
)


def roles(spark, sf):
    p = protocol(spark, sf, "lobo")
    return p, p.rows.select("tag", "layer", "uid", *Z.CARRIED, "h")


@query("f12_jump_relu_encode", with_ctes(ENCODED, body="""
SELECT uid, feature, round(s, 6) AS z FROM enc WHERE s > 0"""))
def f12(spark, sf):
    encoded = Z.encode(I.hidden(spark, sf), I.sae_encoders(spark, sf))
    flat = encoded.select("uid", F.inline(F.arrays_zip("features", "values")))
    return rounded(flat.select("uid", F.col("features").alias("feature"), F.col("values").alias("z")), "z")


@query("d16_mean_l0", with_ctes(ENCODED, body="""
SELECT CAST(3 AS INTEGER) AS layer, round(count(*) FILTER (WHERE s > 0) / CAST(count(DISTINCT uid) AS DOUBLE), 6) AS mean_l0 FROM enc"""))
def d16(spark, sf):
    encoded = Z.encode(I.hidden(spark, sf), I.sae_encoders(spark, sf))
    return rounded(Z.mean_l0(encoded).drop("tag"), "mean_l0")


@query("f13_feature_train_aucs", with_ctes(*SAE, body="""
SELECT cluster_id, hold, feature, round(train_auc, 6) AS train_auc FROM train_pairs WHERE present > 0"""))
def f13(spark, sf):
    p, rows = roles(spark, sf)
    scores = X.role_scores(Z.encode(rows, I.sae_encoders(spark, sf)))
    aucs = X.train_aucs(scores, p.folds, p.split)
    return rounded(aucs.drop("tag", "layer"), "train_auc")


@query("f14_best_feature", with_ctes(*SAE, SAE_BEST, HELD_OUT, body="""
SELECT cluster_id, hold, feature, sign, round(train_auc, 6) AS train_auc, round(auc, 6) AS auc FROM held_out"""))
def f14(spark, sf):
    p, rows = roles(spark, sf)
    out = Z.sparse_lobo(rows, I.sae_encoders(spark, sf), p.folds, p.split)
    return rounded(out.drop("tag", "layer"), "train_auc", "auc")


@query("f15_sparse_summary", with_ctes(*SAE, SAE_BEST, HELD_OUT, body="""
SELECT cluster_id, CAST(round_even(avg(auc), 3) AS DOUBLE) AS lobo,
       CAST(round_even(median(auc), 3) AS DOUBLE) AS lobo_med, count(*) AS n_folds
FROM held_out GROUP BY cluster_id"""))
def f15(spark, sf):
    p, rows = roles(spark, sf)
    out = Z.sparse_lobo(rows, I.sae_encoders(spark, sf), p.folds, p.split)
    return L.fold_summary(out).drop("tag", "layer")


@query("f16_lens_scores", with_ctes(LENS, body="""
SELECT uid, feature AS token_id, round(s, 6) + 0 AS score FROM enc"""))
def f16(spark, sf):
    scored = N.token_scores(I.hidden(spark, sf), I.lens(spark, sf))
    flat = scored.select("uid", F.inline(F.arrays_zip("features", "values")))
    return rounded(flat.select("uid", F.col("features").alias("token_id"), F.col("values").alias("score")), "score")


@query("f17_best_token", with_ctes(*LENS_ALL, LENS_BEST, HELD_OUT, body="""
SELECT cluster_id, hold, feature, round(train_auc, 6) AS train_auc, round(auc, 6) AS auc FROM held_out"""))
def f17(spark, sf):
    p, rows = roles(spark, sf)
    out = N.lens_lobo(rows, I.lens(spark, sf), I.lens_candidates(spark, sf), p.folds, p.split)
    return rounded(out.drop("tag", "layer", "sign"), "train_auc", "auc")


@query("f18_lens_summary", with_ctes(*LENS_ALL, LENS_BEST, HELD_OUT, body="""
SELECT cluster_id, CAST(round_even(avg(auc), 3) AS DOUBLE) AS lobo,
       CAST(round_even(median(auc), 3) AS DOUBLE) AS lobo_med, count(*) AS n_folds
FROM held_out GROUP BY cluster_id"""))
def f18(spark, sf):
    p, rows = roles(spark, sf)
    out = N.lens_lobo(rows, I.lens(spark, sf), I.lens_candidates(spark, sf), p.folds, p.split)
    return L.fold_summary(out).drop("tag", "layer")


@query("f12_two_models", """
SELECT tag, uid, feature, round(CASE WHEN pre > 0.02 * feature THEN pre ELSE 0 END, 6) AS z
FROM (SELECT tag, CAST(e.vec_id AS VARCHAR) AS uid, CAST(w.vec_id - base AS INTEGER) AS feature,
             list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])) + 0.01 AS pre
      FROM embeddings e CROSS JOIN (VALUES ('m', 0), ('n', 16)) t(tag, base)
      JOIN embeddings w ON w.vec_id >= base AND w.vec_id < base + 16)
WHERE pre > 0.02 * feature AND pre > 0""")
def f12_two_models(spark, sf):
    encoded = Z.encode(I.two_models(spark, sf), I.two_encoders(spark, sf))
    flat = encoded.select("tag", "uid", F.inline(F.arrays_zip("features", "values")))
    return rounded(flat.select("tag", "uid", F.col("features").alias("feature"), F.col("values").alias("z")), "z")


@query("f16_two_models", with_ctes(LENS, """
turned AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS uid, i,
         sum(CAST(e.embedding[j.vec_id + 1] AS DOUBLE) * CAST(j.embedding[i] AS DOUBLE)) AS m
  FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 64) j CROSS JOIN range(1, 65) r(i)
  GROUP BY ALL),
plain AS (SELECT uid, i, m / sqrt(avg(m * m) OVER (PARTITION BY uid) + 1e-6) AS m FROM turned)""", body="""
SELECT 'm' AS tag, uid, feature AS token_id, round(s, 6) + 0 AS score FROM enc
UNION ALL
SELECT 'n', uid, CAST(t.vec_id - 64 + 100 AS INTEGER), round(sum(m * CAST(t.embedding[i] AS DOUBLE)), 6) + 0
FROM plain CROSS JOIN (SELECT * FROM embeddings WHERE vec_id BETWEEN 64 AND 71) t GROUP BY uid, t.vec_id"""))
def f16_two_models(spark, sf):
    scored = N.token_scores(I.two_models(spark, sf), I.two_lenses(spark, sf))
    flat = scored.select("tag", "uid", F.inline(F.arrays_zip("features", "values")))
    return rounded(flat.select("tag", "uid", F.col("features").alias("token_id"), F.col("values").alias("score")), "score")


def at_layer(sql: str, layer: int) -> str:
    """The same tables for another layer, under names of their own."""
    return re.sub(r"\b(enc|train_pairs|best|held_out)\b", rf"\1_{layer}", sql)


FIRST_HALF = ENCODED.replace("e.embedding AS", "e.embedding[1:32] AS").replace("w.embedding AS", "w.embedding[1:32] AS")
LAYERED = (
    *SAMPLED,
    *[at_layer(c, 1) for c in (FIRST_HALF, sql_train(), SAE_BEST, HELD_OUT)],
    *[at_layer(c, 3) for c in (ENCODED, sql_train(), SAE_BEST, HELD_OUT)],
    """
chosen AS (SELECT CAST(1 AS INTEGER) AS layer, * FROM held_out_1 UNION ALL SELECT 3, * FROM held_out_3),
cells AS (
  SELECT layer, cluster_id, CAST(round_even(median(auc), 3) AS DOUBLE) AS auc FROM chosen GROUP BY ALL),
layers AS (
  SELECT layer, count(*) AS n, avg(auc) AS mean, median(auc) AS median, count(*) FILTER (WHERE auc >= 0.8) AS strong
  FROM cells GROUP BY layer),
top AS (SELECT layer FROM layers ORDER BY mean DESC, layer LIMIT 1)""",
)


def layered_report(spark, sf):
    p, rows = roles(spark, sf)
    folds = Z.sparse_lobo(rows, I.layered_encoders(spark, sf), p.folds, p.split)
    return X.feature_report(folds, "sae")


@query("f15_layers", with_ctes(*LAYERED, body="""
SELECT layer, 'sae' AS method, n, round(mean, 6) AS mean, round(median, 6) AS median, strong,
       layer = (SELECT layer FROM top) AS best FROM layers"""))
def f15_layers(spark, sf):
    return rounded(layered_report(spark, sf).layers.drop("tag"), "mean", "median")


@query("f15_chosen_features", with_ctes(*LAYERED, body="""
SELECT layer, cluster_id, hold, feature, sign, round(auc, 6) AS auc FROM chosen WHERE layer = (SELECT layer FROM top)"""))
def f15_chosen(spark, sf):
    return rounded(layered_report(spark, sf).chosen.drop("tag", "train_auc"), "auc")


LENS_1 = re.sub(r"\b(moved|normed|wanted)\b", r"\1_1", LENS).replace("e.embedding AS", "e.embedding[1:32] AS").replace("j.embedding AS", "j.embedding[1:32] AS")
LENS_TRAIN = sql_train("JOIN wanted w ON w.cluster_id = f.cluster_id AND w.feature = p.feature")
LENS_LAYERED = (
    *SAMPLED,
    at_layer(LENS_1, 1), at_layer(LENS, 3),
    *[at_layer(c, n) for n in (1, 3) for c in (LENS_TRAIN, LENS_BEST, HELD_OUT)],
    *LAYERED[-1:],
)


def layered_lens_report(spark, sf, others=None, limit=None):
    p, rows = roles(spark, sf)
    more = {} if limit is None else {"limit": limit}
    folds = N.lens_lobo(rows, I.layered_lens(spark, sf), I.lens_candidates(spark, sf), p.folds, p.split, **more)
    return X.feature_report(folds, "lens", others(p) if others else None)


@query("f18_layers", with_ctes(*LENS_LAYERED, body="""
SELECT layer, 'lens' AS method, n, round(mean, 6) AS mean, round(median, 6) AS median, strong,
       layer = (SELECT layer FROM top) AS best FROM layers"""))
def f18_layers(spark, sf):
    return rounded(layered_lens_report(spark, sf).layers.drop("tag"), "mean", "median")


@query("f18_tiled_lens", with_ctes(*LENS_LAYERED, body="""
SELECT layer, cluster_id, hold, feature, round(train_auc, 6) AS train_auc, round(auc, 6) AS auc FROM chosen"""))
def f18_tiled(spark, sf):
    """The folds of both layers with weights several times the limit, in tiles of three rows."""
    p, rows = roles(spark, sf)
    folds = N.lens_lobo(rows, I.layered_lens(spark, sf), I.lens_candidates(spark, sf), p.folds, p.split, limit=3 * 64 * 8)
    return rounded(folds.drop("tag", "sign"), "train_auc", "auc")


OTHER_METHODS = """
SELECT layer, method, count(*) AS n, round(avg(auc), 6) AS mean, round(median(auc), 6) AS median,
       count(*) FILTER (WHERE auc >= 0.8) AS strong
FROM (SELECT layer, 'diffmean' AS method, CAST(round_even(median(auc), 3) AS DOUBLE) AS auc FROM lobo_auc GROUP BY layer, cluster_id)
GROUP BY ALL
"""


def diff_mean_cells(p):
    return L.fold_summary(L.lobo_folds(p)).select(
        "tag", "layer", "cluster_id", F.lit("diffmean").alias("method"), F.col("lobo_med").alias("auc"))


@query("f18_comparison", with_ctes(*Q.LOBO, *[c for c in LENS_LAYERED if c not in Q.LOBO], body=f"""
SELECT layer, 'lens' AS method, n, round(mean, 6) AS mean, round(median, 6) AS median, strong FROM layers
WHERE layer = (SELECT layer FROM top) UNION ALL {OTHER_METHODS}"""))
def f18_comparison(spark, sf):
    """The lens at its best layer beside diff-mean at every layer."""
    return rounded(layered_lens_report(spark, sf, diff_mean_cells).comparison.drop("tag"), "mean", "median")


@query("f15_comparison", with_ctes(*Q.LOBO, *[c for c in LAYERED if c not in Q.LOBO], body=f"""
SELECT layer, 'sae' AS method, n, round(mean, 6) AS mean, round(median, 6) AS median, strong FROM layers
WHERE layer = (SELECT layer FROM top) UNION ALL {OTHER_METHODS}"""))
def f15_comparison(spark, sf):
    """The sparse features at their best layer beside diff-mean at every layer."""
    p, rows = roles(spark, sf)
    folds = Z.sparse_lobo(rows, I.layered_encoders(spark, sf), p.folds, p.split)
    return rounded(X.feature_report(folds, "sae", diff_mean_cells(p)).comparison.drop("tag"), "mean", "median")


@query("f12_tiled_encode", with_ctes(ENCODED, body="""
SELECT uid, feature, round(s, 6) AS z FROM enc WHERE s > 0"""))
def f12_tiled(spark, sf):
    """The encoding with weights several times the limit, in tiles of three features."""
    encoded = Z.encode(I.hidden(spark, sf), I.sae_encoders(spark, sf), limit=3 * 64 * 8)
    flat = encoded.select("uid", F.inline(F.arrays_zip("features", "values")))
    return rounded(flat.select("uid", F.col("features").alias("feature"), F.col("values").alias("z")), "z")


@query("f16_top_tokens", with_ctes(LENS, body="""
SELECT uid, CAST(row_number() OVER w AS INTEGER) AS place, feature AS token_id, round(s, 6) + 0 AS score FROM enc
WINDOW w AS (PARTITION BY uid ORDER BY s DESC, feature) QUALIFY row_number() OVER w <= 3"""))
def f16_top(spark, sf):
    """Each text's three best tokens of all, from tiles of five tokens."""
    scored = N.token_scores(I.hidden(spark, sf), I.lens(spark, sf), limit=5 * 64 * 8, top=3)
    flat = scored.select("uid", F.posexplode(F.arrays_zip("features", "values")).alias("i", "t"))
    return rounded(flat.select(
        "uid", (F.col("i") + 1).alias("place"), F.col("t.features").alias("token_id"), F.col("t.values").alias("score")), "score")


VOCABULARY = """
words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
names AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part),
name_words AS (
  SELECT name, w, min(i) AS i FROM (
    SELECT name, unnest(string_split(name, '_')) AS w, unnest(range(len(string_split(name, '_')))) AS i FROM names)
  GROUP BY ALL)
"""


def names(spark, sf):
    p = I.table(spark, sf, "part")
    return p.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")).distinct()


def token_text(candidates, spark, sf):
    return candidates.join(I.vocabulary(spark, sf).select("token_id", "text"), "token_id")


@query("b16_whole_word_tokens", with_ctes(VOCABULARY, body="""
SELECT name, ' ' || w AS text, CAST(i AS INTEGER) AS "order" FROM name_words WHERE length(w) % 2 = 0"""))
def b16_whole(spark, sf):
    verbalizers = names(spark, sf).select("name", F.split("name", "_").alias("words"))
    c = N.whole_word_candidates(verbalizers, I.vocabulary(spark, sf))
    return token_text(c, spark, sf).select("name", "text", "order")


@query("b16_fragment_tokens", with_ctes(VOCABULARY, body="""
SELECT DISTINCT name, text FROM (
  SELECT name, ' ' || w AS text FROM name_words WHERE length(w) % 2 = 0
  UNION ALL SELECT name, t FROM (SELECT name, unnest([w[1:2], w[3:]]) AS t FROM name_words WHERE length(w) % 2 = 1)
            WHERE length(t) <> 1)"""))
def b16_fragment(spark, sf):
    c = N.fragment_candidates(names(spark, sf), I.vocabulary(spark, sf), I.word_pieces(spark, sf))
    return token_text(c, spark, sf).select("name", "text")


@query("d17_candidate_coverage", with_ctes(VOCABULARY, body="""
SELECT count(*) AS total, count(*) FILTER (WHERE n > 0) AS covered, min(n) AS fewest, round(avg(n), 6) AS mean, max(n) AS most
FROM (SELECT name, count(w) FILTER (WHERE length(w) % 2 = 0) AS n FROM name_words GROUP BY name)"""))
def d17(spark, sf):
    verbalizers = names(spark, sf).select("name", F.split("name", "_").alias("words"))
    c = N.whole_word_candidates(verbalizers, I.vocabulary(spark, sf))
    return rounded(N.candidate_coverage(names(spark, sf), c), "mean")


def cells(spark, sf, *methods):
    p = protocol(spark, sf, "lobo")
    return M.lobo_methods(p, D.standardiser(p.moments), methods or M.METHODS)


def probe_blocks(spark, sf):
    p = protocol(spark, sf, "lobo")
    return p, M.protocol_blocks(p.rows, D.standardiser(p.moments), p.limit)


FITTED = with_ctes(*Q.LOBO, body="""
SELECT layer, f.cluster_id, f.hold, n_train + n_neg AS n_fit, true AS solved
FROM folds f JOIN (SELECT cluster_id, count(*) AS n_neg FROM split WHERE part = 'train' GROUP BY cluster_id) USING (cluster_id)
CROSS JOIN (SELECT DISTINCT layer FROM hidden)""")


@query("f7_pca_solved", FITTED)
def f7_solved(spark, sf):
    """Whether each fold's axis is an eigenvector of its rows' covariance, by a scan of all of them."""
    p, blocks = probe_blocks(spark, sf)
    checked = M.axis_residuals(blocks, M.pca_directions(blocks, p.folds))
    return checked.select("layer", "cluster_id", "hold", F.col("n_rows").alias("n_fit"), (F.col("residual") < 1e-7).alias("solved"))


@query("f8_logistic_solved", FITTED)
def f8_solved(spark, sf):
    """Whether the gradient of each fit, over all its training rows, vanishes."""
    p, blocks = probe_blocks(spark, sf)
    checked = M.logistic_gradients(blocks, M.logistic_directions(blocks, p.folds, tol=1e-6))
    return checked.select("layer", "cluster_id", "hold", F.col("n_rows").alias("n_fit"), (F.col("gap") < 2e-6).alias("solved"))


@query("f7_lobo_pca")
def f7(spark, sf):
    return rounded(cells(spark, sf, "pca").drop("tag", "method"), "auc")


@query("f8_lobo_logistic")
def f8(spark, sf):
    return rounded(cells(spark, sf, "lr").drop("tag", "method"), "auc")


@query("f19_same_split_diff_mean", with_ctes(*Q.LOBO, body="""
SELECT layer, cluster_id, hold, round(auc, 6) AS auc FROM lobo_auc"""))
def f19_diff_mean(spark, sf):
    return rounded(cells(spark, sf, "diffmean").drop("tag", "method"), "auc")


@query("f19_given_folds", with_ctes(*Q.LOBO, body="""
SELECT a.layer, a.cluster_id, CAST(round_even(median(auc), 3) AS DOUBLE) AS diffmean,
       CAST(round_even(median(1 - auc), 3) AS DOUBLE) AS pca, CAST(round_even(median(auc * auc), 3) AS DOUBLE) AS lr,
       any_value(d.n) AS n_datasets
FROM lobo_auc a JOIN (SELECT cluster_id, count(DISTINCT dataset_id) AS n FROM members GROUP BY ALL) d USING (cluster_id)
GROUP BY a.layer, a.cluster_id"""))
def f19_given(spark, sf):
    """The comparison from stated AUCs: those of diff-mean, their mirror and their square."""
    p = protocol(spark, sf, "lobo")
    auc = F.col("auc")
    each = F.array(*[F.struct(F.lit(m).alias("method"), a.alias("auc")) for m, a in (("diffmean", auc), ("pca", 1 - auc), ("lr", auc * auc))])
    folds = L.lobo_folds(p).select("tag", "layer", "cluster_id", "hold", F.inline(each))
    return M.method_comparison(folds, S.dataset_counts(p.texts)).drop("tag")


@query("f19_method_comparison")
def f19(spark, sf):
    p = protocol(spark, sf, "lobo")
    cells_ = M.lobo_methods(p, D.standardiser(p.moments))
    return M.method_comparison(cells_, S.dataset_counts(p.texts)).drop("tag")


@query("i1_pooled_vectors", with_ctes(Q.TEXTS, Q.MEMBERS, Q.HIDDEN, Q.LONG, body="""
SELECT layer, cluster_id, CAST(i - 1 AS INTEGER) AS dim, round(avg(m), 6) + 0 AS pooled FROM (
  SELECT layer, cluster_id, dataset_id, i, avg(x) AS m FROM members JOIN long USING (uid) GROUP BY ALL)
GROUP BY layer, cluster_id, i"""))
def i1(spark, sf):
    pooled = O.pooled_vectors(protocol(spark, sf, "lobo").moments)
    return rounded(
        pooled.select("layer", "cluster_id", F.posexplode("pooled").alias("dim", "pooled")), "pooled"
    )


def sql_k_means(ks: range, steps: int) -> list[str]:
    """Farthest-first starts and the steps of k-means over points (tag, layer, cluster_id, v), a table for each."""
    most = max(ks)
    out = ["gap_0 AS MATERIALIZED (SELECT *, CAST('inf' AS DOUBLE) AS gap FROM points)"]
    for j in range(most):
        out.append(f"""far_{j} AS MATERIALIZED (SELECT tag, layer, {j} AS centre, v AS c FROM gap_{j}
  QUALIFY row_number() OVER (PARTITION BY tag, layer ORDER BY gap DESC, cluster_id) = 1)""")
        out.append(f"""gap_{j + 1} AS MATERIALIZED (
  SELECT tag, layer, cluster_id, v, least(gap, list_distance(v, c)) AS gap FROM gap_{j} JOIN far_{j} USING (tag, layer))""")
    starts = " UNION ALL ".join(f"SELECT * FROM far_{j}" for j in range(most))
    out.append(f"""centres_0 AS MATERIALIZED (
  SELECT tag, layer, k, centre, c FROM ({starts}) CROSS JOIN range({min(ks)}, {most + 1}) r(k)
  JOIN (SELECT tag, layer, count(*) AS n FROM points GROUP BY ALL) USING (tag, layer) WHERE centre < k AND k < n)""")
    for s in range(steps):
        out.append(f"""near_{s} AS MATERIALIZED (
  SELECT tag, layer, k, cluster_id, v, centre FROM points JOIN centres_{s} USING (tag, layer)
  QUALIFY row_number() OVER (PARTITION BY tag, layer, k, cluster_id ORDER BY list_distance(v, c), centre) = 1)""")
        out.append(f"""centres_{s + 1} AS MATERIALIZED (
  SELECT tag, layer, k, centre, coalesce(m, c) AS c FROM centres_{s} LEFT JOIN (
    SELECT tag, layer, k, centre, list(x ORDER BY i) AS m FROM (
      SELECT tag, layer, k, centre, i, avg(x) AS x FROM (
        SELECT tag, layer, k, centre, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM near_{s}) GROUP BY ALL)
    GROUP BY tag, layer, k, centre) USING (tag, layer, k, centre))""")
    return out


SWEEP_STEPS = 12  # more than it takes to come to rest
SWEEP = (
    """long AS (SELECT tag, layer, uid, unnest(range(1, len(h) + 1)) AS i, CAST(unnest(h) AS DOUBLE) AS x FROM (
  SELECT 'm' AS tag, * FROM hidden UNION ALL SELECT 'n', layer, uid, h[1:16] FROM hidden WHERE layer < 3))""",
    """points AS MATERIALIZED (
  SELECT tag, layer, cluster_id, list(p ORDER BY i) AS v FROM (
    SELECT tag, layer, cluster_id, i, avg(m) AS p FROM (
      SELECT tag, layer, cluster_id, dataset_id, i, avg(x) AS m FROM members JOIN long USING (uid) GROUP BY ALL)
    GROUP BY tag, layer, cluster_id, i) GROUP BY tag, layer, cluster_id)""",
    *sql_k_means(range(4, 16), SWEEP_STEPS),
    f"""means AS (
  SELECT a.tag, a.layer, a.k, a.cluster_id, a.centre = b.centre AS own, count(*) AS n,
         sum(list_distance(a.v, b.v) ** 2) / CASE WHEN a.centre = b.centre THEN greatest(count(*) - 1, 1) ELSE count(*) END AS m
  FROM near_{SWEEP_STEPS - 1} a JOIN near_{SWEEP_STEPS - 1} b USING (tag, layer, k)
  GROUP BY a.tag, a.layer, a.k, a.cluster_id, a.centre, b.centre)""",
    """scores AS (
  SELECT tag, layer, k, max(n) FILTER (WHERE own) AS n, max(m) FILTER (WHERE own) AS own, min(m) FILTER (WHERE NOT own) AS near
  FROM means GROUP BY tag, layer, k, cluster_id)""",
)


@query("i2_silhouette_sweep", with_ctes(Q.TEXTS, Q.MEMBERS, Q.HIDDEN, *SWEEP, body="""
SELECT tag, layer, CAST(k AS INTEGER) AS k,
       round(avg(CASE WHEN n > 1 AND greatest(near, own) > 0 THEN (near - own) / greatest(near, own) ELSE 0 END), 6) + 0 AS silhouette
FROM scores GROUP BY tag, layer, k"""))
def i2(spark, sf):
    moments = L.Protocol(I.short_model(spark, sf), I.probe_texts(spark, sf), ("lobo",), per_dataset=I.NEGATIVES).moments
    return rounded(O.silhouette_sweep(O.pooled_vectors(moments)), "silhouette")


SILHOUETTE = """
pooled AS (
  SELECT layer, cluster_id, ascii(cluster_id[-1:]) % 3 AS lab, i, avg(m) AS p FROM (
    SELECT layer, cluster_id, dataset_id, i, avg(x) AS m FROM members JOIN long USING (uid) GROUP BY ALL)
  GROUP BY layer, cluster_id, i),
gaps AS (
  SELECT a.layer, a.cluster_id, a.lab, b.lab AS other, b.cluster_id AS b, sum((a.p - b.p) * (a.p - b.p)) AS d
  FROM pooled a JOIN pooled b USING (layer, i) GROUP BY a.layer, a.cluster_id, a.lab, b.lab, b.cluster_id),
means AS (
  SELECT layer, cluster_id, lab, other, count(*) AS n,
         sum(d) / CASE WHEN lab = other THEN greatest(count(*) - 1, 1) ELSE count(*) END AS m
  FROM gaps GROUP BY layer, cluster_id, lab, other),
points AS (
  SELECT layer, cluster_id, max(n) FILTER (WHERE lab = other) AS n, max(m) FILTER (WHERE lab = other) AS own,
         min(m) FILTER (WHERE lab <> other) AS near
  FROM means GROUP BY layer, cluster_id)
"""


@query("i2_silhouette", with_ctes(Q.TEXTS, Q.MEMBERS, Q.HIDDEN, Q.LONG, SILHOUETTE, body="""
SELECT layer, round(avg(CASE WHEN n > 1 THEN (near - own) / greatest(near, own) ELSE 0 END), 6) AS silhouette
FROM points GROUP BY layer"""))
def i2_silhouette(spark, sf):
    pooled = O.pooled_vectors(protocol(spark, sf, "lobo").moments)
    labelled = pooled.withColumn("lab", F.ascii(F.right("cluster_id", F.lit(1))) % 3)
    return rounded(O.silhouette(labelled, "lab"), "silhouette").drop("tag")


@query("i3_adjusted_rand", """
SELECT round((s.idx - a.v * b.v / t.v) / ((a.v + b.v) / 2 - a.v * b.v / t.v), 6) AS ari
FROM (SELECT sum(n * (n - 1) / CAST(2 AS DOUBLE)) AS idx FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)) s,
     (SELECT sum(n * (n - 1) / CAST(2 AS DOUBLE)) AS v FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) a,
     (SELECT sum(n * (n - 1) / CAST(2 AS DOUBLE)) AS v FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)) b,
     (SELECT count(*) * (count(*) - 1) / CAST(2 AS DOUBLE) AS v FROM orders) t""")
def i3(spark, sf):
    return rounded(O.adjusted_rand(I.table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), "ari")


@query("i5_landscape", """
SELECT family, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS clusters, count(*) FILTER (WHERE b >= 2) AS covered,
       (SELECT count(DISTINCT p_name || p_size) FROM part p WHERE p.p_type = family) AS concepts,
       count(*) FILTER (WHERE b < 2) AS uncovered
FROM (SELECT p_type AS family, p_brand || p_size AS cluster_id, count(*) AS n, count(DISTINCT p_name) AS b FROM part GROUP BY ALL)
GROUP BY family""")
def i5(spark, sf):
    p = I.table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    mentions = p.select(
        F.col("p_type").alias("family"), F.concat("p_brand", size).alias("cluster_id"),
        F.concat("p_name", size).alias("concept"), F.col("p_name").alias("benchmark"),
    )
    return O.landscape(mentions)
