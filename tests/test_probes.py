"""Probe operators against numpy on a small fixture."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from capsonde.functions.vectors import vector_mean
from capsonde.operators import directions as D
from capsonde.operators import linear_probes as M
from capsonde.operators import lobo as L
from capsonde.operators import pooled as O
from capsonde.operators import reports as R
from capsonde.operators import sampling as S
from capsonde.operators import selection as X
from capsonde.operators import sparse as Z
from capsonde.session import materialize
from capsonde.operators.lens import Lens, fragment_candidates, lens_lobo, require_coverage, token_scores, whole_word_candidates

DIM, CAP = 6, 4


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def build():
    rng = np.random.default_rng(5)
    rows = []
    for c, sizes in {"x": (14, 11, 30), "y": (12, 16), "z": (25, 4), "w": (40,)}.items():
        for d, size in enumerate(sizes):
            for i in range(size):
                tags = [c] + (["all"] if c in "xy" else [])
                mean = {"x": 1.0, "y": -1.0, "z": 0.3, "w": 0.0}[c] * np.arange(1, DIM + 1) / 4
                rows.append((f"{c}{d}::{i}", f"{c}{d}", tags, int(rng.integers(5, 400)),
                             [float(np.float32(a)) for a in rng.normal(mean, 1.0)]))
    return rows


ROWS = build()
H = {r[0]: np.array(r[4]) for r in ROWS}
DATASET = {r[0]: r[1] for r in ROWS}
TAGS = {r[0]: r[2] for r in ROWS}
CLUSTERS = sorted({t for r in ROWS for t in r[2]})


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame(
        [(u, d, t, n, "t" * n) for u, d, t, n, _ in ROWS],
        "uid string, dataset_id string, clusters array<string>, n_chars int, text string",
    )
    hidden = spark.createDataFrame(
        [("m", layer, u, h if layer == 1 else h[:3]) for u, _, _, _, h in ROWS for layer in (1, 2)]
        + [("m", 1, "stray", [0.0] * DIM)],
        "tag string, layer int, uid string, h array<float>",
    )
    return hidden, texts


@pytest.fixture(scope="module")
def protocol(tables):
    return L.Protocol(*tables, ("lobo", "within", "full", "spec"), per_dataset=CAP)


def brute_split():
    out = {}
    for c in CLUSTERS:
        by_dataset = {}
        for u in H:
            if c not in TAGS[u]:
                by_dataset.setdefault(DATASET[u], []).append(u)
        picked = [u for us in by_dataset.values() for u in sorted(us, key=lambda u: (md5(0, u), u))[:CAP]]
        picked.sort(key=lambda u: (md5(0, c, u), u))
        n = min(len(picked), 6 * sum(c in t for t in TAGS.values()))
        out[c] = picked[: n // 2], picked[n // 2 : n]
    return out


SPLIT = brute_split()


def brute_folds():
    for c in CLUSTERS:
        pos = [u for u in H if c in TAGS[u]]
        datasets = sorted({DATASET[u] for u in pos})
        for hold in datasets:
            train = [u for u in pos if DATASET[u] != hold]
            test = [u for u in pos if DATASET[u] == hold]
            if len(datasets) >= 2 and len(train) >= 10 and len(test) >= 10:
                yield c, hold, train, test


def standard(layer):
    x = np.array([h if layer == 1 else h[:3] for h in H.values()])
    return dict(zip(H, (x - x.mean(0)) / (x.std(0) + 1e-6)))


def auc(pos, neg):
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def direction(z, pos, neg):
    v = np.mean([z[u] for u in pos], 0) - np.mean([z[u] for u in neg], 0)
    return v / (np.linalg.norm(v) + 1e-8)


def test_split_matches_the_rule(protocol):
    got = {}
    for r in protocol.split.collect():
        got.setdefault((r["cluster_id"], r["part"]), []).append((r["neg_rank"], r["uid"]))
    for c in CLUSTERS:
        assert [u for _, u in sorted(got[c, "train"])] == SPLIT[c][0]
        assert [u for _, u in sorted(got[c, "test"])] == SPLIT[c][1]


def test_negative_caps_and_disjointness(protocol):
    per = protocol.split.groupBy("cluster_id", "dataset_id").count().agg(F.max("count")).first()[0]
    assert per <= CAP
    for c in CLUSTERS:
        assert not {u for part in SPLIT[c] for u in part} & {u for u in H if c in TAGS[u]}


def test_little_more_than_the_kept_negatives_is_paired(spark):
    n = 6000
    texts = spark.range(n).select(
        F.concat(F.lit("u"), "id").alias("uid"), F.format_string("d%d", F.col("id") % 300).alias("dataset_id"),
        F.when(F.col("id") % 300 < 2, F.array(F.lit("rare"))).when(F.col("id") % 300 < 150, F.array(F.lit("often"), F.lit("both")))
        .otherwise(F.array(F.lit("often"))).alias("clusters"))
    want = {r["cluster_id"]: (r["n"], r["k"]) for r in S.negative_candidates(texts).groupBy("cluster_id").agg(F.count("*").alias("n")).join(
        S.members(texts).groupBy("cluster_id").agg((6 * F.count("*")).alias("k")), "cluster_id").collect()}
    paired = {r["cluster_id"]: r["count"] for r in S.sampled_candidates(texts).groupBy("cluster_id").count().collect()}
    kept = {r["cluster_id"]: r["count"] for r in S.negative_split(texts).groupBy("cluster_id").count().collect()}
    for c, (n_all, wanted) in want.items():
        assert kept[c] == min(n_all, wanted) <= paired[c] <= min(n_all, wanted) + max(20, n_all // 100)
    assert paired["rare"] < want["rare"][0] / 4


def test_a_capability_without_non_members_has_no_split(spark):
    texts = spark.createDataFrame([("a", "d", ["c"]), ("b", "e", ["c"])], "uid string, dataset_id string, clusters array<string>")
    assert S.negative_split(texts).count() == 0


def test_untagged_texts_serve_as_negatives(spark):
    texts = spark.createDataFrame(
        [("a", "d", ["c"]), ("b", "e", [])], "uid string, dataset_id string, clusters array<string>"
    )
    assert [r["uid"] for r in S.negative_split(texts).collect()] == ["b"]


def test_half_cuts(tables):
    _, texts = tables
    cuts = {r["cluster_id"]: r["half_cut"] for r in S.half_cuts(texts).collect()}
    for c in CLUSTERS:
        keys = sorted(md5(0, c, u) for u in H if c in TAGS[u])
        assert cuts[c] == keys[len(keys) // 2 - 1]


@pytest.mark.parametrize("stored", [False, True])
def test_half_flags_on_the_joined_rows(tables, protocol, stored):
    hidden, texts = tables
    cuts = S.half_cuts(texts)
    rows = D.with_roles(hidden, texts, protocol.split, materialize(cuts) if stored else cuts)
    got = {r["uid"]: sorted(r["half"]) for r in rows.filter("layer = 1").collect()}
    for c in CLUSTERS:
        keys = sorted((md5(0, c, u), u) for u in H if c in TAGS[u])
        first = {u for _, u in keys[: len(keys) // 2]}
        assert {u for u, half in got.items() if c in half} == first


def test_folds(protocol):
    got = {(r["cluster_id"], r["hold"]): (r["n_train"], r["n_test"]) for r in protocol.folds.collect()}
    assert got == {(c, h): (len(a), len(b)) for c, h, a, b in brute_folds()}
    assert ("z", "z1") not in got and not any(c == "w" for c, _ in got)


def test_lobo_aucs(protocol):
    got = {(r["layer"], r["cluster_id"], r["hold"]): r["auc"] for r in L.lobo_folds(protocol).collect()}
    for layer in (1, 2):
        z = standard(layer)
        for c, hold, train, test in brute_folds():
            v = direction(z, train, SPLIT[c][0])
            want = auc([z[u] @ v for u in test], [z[u] @ v for u in SPLIT[c][1]])
            assert got.pop((layer, c, hold)) == pytest.approx(want, abs=1e-12)
    assert not got


def test_scoring_in_blocks_gives_the_same_aucs(tables, protocol):
    """Blocks of whole layers, and layers cut further, against one block for all."""
    want = {(r["layer"], r["cluster_id"], r["hold"], r["kind"]): r["auc"] for r in protocol.aucs("lobo", "within").collect()}
    for limit in (900, 300):
        cut = L.Protocol(*tables, ("lobo", "within", "full", "spec"), per_dataset=CAP, limit=limit)
        got = {(r["layer"], r["cluster_id"], r["hold"], r["kind"]): r["auc"] for r in cut.aucs("lobo", "within").collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    matrix = [{(r["layer"], r["cluster_id"], r["direction"]): r["z_mean"] for r in L.transfer_matrix(x).collect()} for x in (protocol, cut)]
    assert matrix[0].keys() == matrix[1].keys()
    assert all(matrix[1][k] == pytest.approx(v, abs=1e-9) for k, v in matrix[0].items())


def test_within_auc(protocol):
    got = {(r["layer"], r["cluster_id"]): r["auc"] for r in L.within_auc(protocol).collect()}
    z = standard(1)
    for c in CLUSTERS:
        pos = sorted((u for u in H if c in TAGS[u]), key=lambda u: md5(0, c, u))
        half = len(pos) // 2
        v = direction(z, pos[:half], SPLIT[c][0])
        want = auc([z[u] @ v for u in pos[half:]], [z[u] @ v for u in SPLIT[c][1]])
        assert got[1, c] == pytest.approx(want, abs=1e-12)


def ranks(values):
    order = sorted(values)
    return np.array([np.mean([i + 1 for i, o in enumerate(order) if o == v]) for v in values])


def test_length_confound(protocol):
    lengths = {r[0]: math.log1p(r[3]) for r in ROWS}
    got = {(r["layer"], r["cluster_id"]): r["len_r"] for r in L.length_confound(protocol).collect()}
    z = standard(1)
    for c in CLUSTERS:
        v = direction(z, [u for u in H if c in TAGS[u]], SPLIT[c][0])
        a = ranks([z[u] @ v for u in SPLIT[c][1]])
        b = ranks([lengths[u] for u in SPLIT[c][1]])
        assert got[1, c] == pytest.approx(abs(np.corrcoef(a, b)[0, 1]), abs=1e-9)


def test_length_confound_of_equal_lengths_is_null(tables):
    hidden, texts = tables
    p = L.Protocol(hidden, texts.withColumn("n_chars", F.lit(7)), ("full",), per_dataset=CAP)
    assert all(r["len_r"] is None for r in L.length_confound(p).collect())


def test_transfer_matrix_and_spec_rank(protocol):
    z = standard(1)
    v = {c: direction(z, [u for u in H if c in TAGS[u]], SPLIT[c][0] + SPLIT[c][1]) for c in CLUSTERS}
    p = np.array([[z[u] @ v[c] for c in CLUSTERS] for u in H])
    p = (p - p.mean(0)) / (p.std(0) + 1e-8)
    m = np.array([p[[c in TAGS[u] for u in H]].mean(0) for c in CLUSTERS])
    matrix = L.transfer_matrix(protocol)
    got = {(r["cluster_id"], r["direction"]): r["z_mean"] for r in matrix.filter("layer = 1").collect()}
    for i, a in enumerate(CLUSTERS):
        for j, b in enumerate(CLUSTERS):
            assert got[a, b] == pytest.approx(m[i, j], abs=1e-9)
    rank = {r["cluster_id"]: r["spec_rank"] for r in L.spec_rank(matrix).filter("layer = 1").collect()}
    assert rank == {c: int((m[:, j] >= m[j, j]).sum()) for j, c in enumerate(CLUSTERS)}


def test_projection_in_blocks_is_the_same(protocol, monkeypatch):
    whole = {(r["cluster_id"], r["direction"], r["layer"]): r["z_mean"] for r in L.transfer_matrix(protocol).collect()}
    monkeypatch.setattr(protocol, "limit", 100)
    blocks = {(r["cluster_id"], r["direction"], r["layer"]): r["z_mean"] for r in L.transfer_matrix(protocol).collect()}
    assert blocks.keys() == whole.keys()
    assert all(blocks[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


def test_standardiser_is_population(protocol):
    x = np.array(list(H.values()))
    row = D.standardiser(protocol.moments).filter("layer = 1").first()
    assert row["n_rows"] == len(x)
    assert np.allclose(row["mu"], x.mean(0), atol=1e-12)
    assert np.allclose(row["sd"], x.std(0) + 1e-6, atol=1e-12)


def test_fold_summary_and_best_layer(spark):
    folds = spark.createDataFrame(
        [("m", layer, "c", h, a) for layer, aucs in ((7, (0.5, 0.9, 0.8)), (14, (0.8, 0.2, 0.9))) for h, a in zip("abc", aucs)],
        "tag string, layer int, cluster_id string, hold string, auc double",
    )
    summary = L.fold_summary(folds)
    assert {r["layer"]: (r["lobo"], r["lobo_med"]) for r in summary.collect()} == {7: (0.733, 0.8), 14: (0.633, 0.8)}
    within = spark.createDataFrame(
        [("m", 7, "c", 0.9), ("m", 14, "c", 0.9), ("m", 7, "solo", 0.7), ("m", 14, "solo", 0.7)],
        "tag string, layer int, cluster_id string, auc double",
    )
    best = R.best_layer(R.layer_cells(summary, within)).first()
    assert (best["best_layer"], best["score"]) == (7, 0.75)


def best_axis(x, y, k):
    """The method again on dense rows: singular vectors, the one that separates best, and its sign."""
    k = min(k, len(x) - 1, x.shape[1])
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:k]
    aucs = [auc(x[y] @ v, x[~y] @ v) for v in axes]
    best = int(np.argmax([round(max(a, 1 - a), 12) for a in aucs]))
    return axes[best] if aucs[best] >= 0.5 else -axes[best]


def newton_fit(x, y, c=M.LR_C):
    z, ridge, w = np.column_stack([x, np.ones(len(x))]), np.append(np.ones(x.shape[1]), 0.0), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ w)))
        step = np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + np.diag(ridge), ridge * w + c * z.T @ (p - y))
        w -= step
    return w


@pytest.fixture(scope="module")
def blocks(protocol):
    return M.protocol_blocks(protocol.rows, D.standardiser(protocol.moments))


def training(layer, c, train):
    z = standard(layer)
    x = np.array([z[u] for u in [*train, *SPLIT[c][0]]])
    return x, np.arange(len(x)) < len(train), z


@pytest.mark.parametrize("tile", [2, 3, M.TILE])
def test_pca_of_every_fold(protocol, blocks, tile):
    axes = M.principal_axes(M.fold_tiles(M.product_tiles(blocks, tile, open_bytes=1000), protocol.folds))
    found = {}
    for r in axes.collect():
        found.setdefault((r["layer"], r["cluster_id"], r["hold"]), {})[r["axis"]] = r
    for layer in (1, 2):
        for c, hold, train, _ in brute_folds():
            x, _, _ = training(layer, c, train)
            size, want = np.linalg.svd(x - x.mean(0), full_matrices=False)[1:]
            for k, r in found[layer, c, hold].items():
                assert r["size"] == pytest.approx(size[k] ** 2) and r["n_fit"] == len(x) and r["residual"] < 1e-12
                assert abs(np.dot(r["v"], want[k])) == pytest.approx(1.0, abs=1e-9)
            assert len(found[layer, c, hold]) == min(M.PCA_K, len(x) - 1, x.shape[1])


def test_pca_takes_the_best_axis(protocol, blocks):
    found = {(r["layer"], r["cluster_id"], r["hold"]): r for r in M.pca_directions(blocks, protocol.folds).collect()}
    for layer in (1, 2):
        for c, hold, train, test in brute_folds():
            x, y, z = training(layer, c, train)
            v = best_axis(x, y, M.PCA_K)
            r = found[layer, c, hold]
            assert np.dot(r["v"], v) == pytest.approx(1.0, abs=1e-9)
            assert r["auc"] == pytest.approx(auc([z[u] @ v for u in test], [z[u] @ v for u in SPLIT[c][1]]), abs=1e-12)


@pytest.mark.parametrize("limit", [1 << 28, 300])
def test_logistic_is_at_its_optimum(protocol, blocks, limit):
    fits = M.logistic_directions(blocks, protocol.folds, tol=1e-8, limit=limit).collect()
    found = {(r["layer"], r["cluster_id"], r["hold"]): r for r in fits}
    assert len(found) == len(fits) == 2 * len(list(brute_folds()))
    for layer in (1, 2):
        for c, hold, train, _ in brute_folds():
            x, y, _ = training(layer, c, train)
            r = found[layer, c, hold]
            assert np.allclose([*r["v"], r["intercept"]], newton_fit(x, y), atol=1e-6)
            assert r["n_fit"] == len(x) and r["gap"] < 1e-8 and r["passes"] < 40


def test_a_fold_with_one_label_has_no_direction(spark, protocol):
    rows = protocol.rows.withColumn("neg_train", F.array().cast("array<string>"))
    blocks = M.protocol_blocks(rows, D.standardiser(protocol.moments))
    assert M.logistic_directions(blocks, protocol.folds).count() == 0
    assert M.pca_directions(blocks, protocol.folds).count() == 0
    none = M.protocol_blocks(rows.limit(0), D.standardiser(protocol.moments))
    assert M.logistic_directions(none, protocol.folds).count() == 0


def test_methods_of_every_fold(protocol):
    rows = protocol.rows.filter("layer = 1")
    cells = M.lobo_methods(protocol, D.standardiser(protocol.moments), rows=rows)
    found = {(r["cluster_id"], r["hold"], r["method"]): r["auc"] for r in cells.collect()}
    lobo = L.lobo_folds(protocol).filter("layer = 1").collect()
    assert len(found) == 3 * len(lobo)
    for r in lobo:
        assert found[r["cluster_id"], r["hold"], "diffmean"] == pytest.approx(r["auc"], abs=1e-12)
    for c, hold, train, test in brute_folds():
        x, y, z = training(1, c, train)
        w = newton_fit(x, y)[:-1]
        want = auc([z[u] @ w for u in test], [z[u] @ w for u in SPLIT[c][1]])
        assert found[c, hold, "lr"] == pytest.approx(want, abs=1e-9)


def role_rows(protocol, layer):
    return protocol.rows.filter(F.col("layer") == layer).select("tag", "layer", "uid", *Z.CARRIED, "h")


def brute_single(values, sign_free, order=None):
    """Best feature per fold from dense values, as the protocol states it."""
    for c, hold, train, test in brute_folds():
        columns = order[c] if order else range(len(next(iter(values.values()))))
        best = None
        for f in columns:
            a = auc([values[u][f] for u in train], [values[u][f] for u in SPLIT[c][0]])
            s = max(a, 1 - a) if sign_free else a
            if best is None or s > best[0]:
                best = (s, f, 1 if a >= 0.5 or not sign_free else -1)
        s, f, sign = best
        held = auc([sign * values[u][f] for u in test], [sign * values[u][f] for u in SPLIT[c][1]])
        yield c, hold, f, sign, s, held


def test_sparse_lobo(protocol):
    rng = np.random.default_rng(2)
    encoder = Z.Encoder(rng.normal(size=(DIM, 9)), rng.normal(size=9) - 0.5, rng.random(9))
    encoder.b_enc[0] = -1e3  # a feature which never fires
    rows = role_rows(protocol, 1)
    got = {
        (r["cluster_id"], r["hold"]): r
        for r in Z.sparse_lobo(rows, {("m", 1): encoder}, protocol.folds, protocol.split).collect()
    }
    values = {}
    for u, h in H.items():
        pre = h @ encoder.w_enc + encoder.b_enc
        values[u] = np.where(pre > encoder.threshold, np.maximum(pre, 0), 0)
    for c, hold, f, sign, s, held in brute_single(values, True):
        r = got.pop((c, hold))
        assert (r["feature"], r["sign"]) == (f, sign)
        assert r["train_auc"] == pytest.approx(s, abs=1e-12) and r["auc"] == pytest.approx(held, abs=1e-12)
    assert not got


def test_encoding_in_blocks_and_dimension_check(protocol):
    rng = np.random.default_rng(2)
    encoder = Z.Encoder(rng.normal(size=(DIM, 9)), np.zeros(9), np.zeros(9))

    def flat(limit):
        e = Z.encode(role_rows(protocol, 1), {("m", 1): encoder}, limit)
        return {(r["uid"], f): v for r in e.collect() for f, v in zip(r["features"], r["values"])}

    assert flat(1 << 20) == pytest.approx(flat(200))
    with pytest.raises(Exception, match="weights"):
        Z.encode(role_rows(protocol, 2), {("m", 2): encoder}).collect()


def test_a_silent_encoder_picks_the_first_feature(protocol):
    encoder = Z.Encoder(np.zeros((DIM, 3)), np.full(3, -1.0), np.zeros(3))
    encoder.b_enc[2] = 1.0
    out = Z.sparse_lobo(role_rows(protocol, 1), {("m", 1): encoder}, protocol.folds, protocol.split).collect()
    assert {(r["feature"], r["sign"], r["train_auc"], r["auc"]) for r in out} == {(0, 1, 0.5, 0.5)}


def test_lens_lobo(spark, protocol):
    rng = np.random.default_rng(4)
    lens = Lens({1: rng.normal(size=(DIM, DIM))}, rng.normal(size=(5, DIM)), [50, 51, 52, 53, 54],
                rng.random(DIM), 1e-6, 2.0, True)
    order = {c: [(i + k) % 5 for k in (3, 0, 4)] for i, c in enumerate(CLUSTERS)}
    candidates = spark.createDataFrame(
        [(c, 50 + t, k) for c, ts in order.items() for k, t in enumerate(ts)],
        "cluster_id string, token_id int, order int",
    )
    got = {
        (r["cluster_id"], r["hold"]): r
        for r in lens_lobo(role_rows(protocol, 1), {"m": lens}, candidates, protocol.folds, protocol.split).collect()
    }
    values = {}
    for u, h in H.items():
        t = lens.jacobians[1] @ h
        t = t / np.sqrt((t * t).mean() + 1e-6) * (1 + lens.norm_weight)
        values[u] = 2.0 * np.tanh(lens.unembed @ t / 2.0)
    for c, hold, f, _, s, held in brute_single(values, False, order):
        r = got.pop((c, hold))
        assert r["feature"] == 50 + f
        assert r["train_auc"] == pytest.approx(s, abs=1e-12) and r["auc"] == pytest.approx(held, abs=1e-12)
    assert not got


@pytest.mark.parametrize("asked", [True, False])
def test_a_lens_above_the_limit_gives_the_same_scores(spark, protocol, asked):
    rng = np.random.default_rng(7)
    lens = Lens({1: rng.normal(size=(DIM, DIM)), 2: rng.normal(size=(DIM, 3))}, rng.normal(size=(9, DIM)), list(range(40, 49)), np.ones(DIM), softcap=5.0)
    candidates = spark.createDataFrame([(c, 40 + (i * 2 + j) % 9) for i, c in enumerate(CLUSTERS) for j in range(3)], "cluster_id string, token_id int")
    rows = protocol.rows.select("tag", "layer", "uid", *Z.CARRIED, "h")

    def scores(limit):
        out = token_scores(rows, {"m": lens}, candidates if asked else None, limit)
        return {(r["layer"], r["uid"]): dict(zip(r["features"], r["values"], strict=True)) for r in out.collect()}

    whole, tiled = scores(1 << 28), scores(100)
    assert whole.keys() == tiled.keys() and len(whole) == 2 * len(ROWS)
    assert all(whole[k] == pytest.approx(tiled[k], abs=1e-12) for k in whole)
    want = {c: {40 + (i * 2 + j) % 9 for j in range(3)} for i, c in enumerate(CLUSTERS)}
    for layer, u in whole:
        roles = set(TAGS[u]) | {c for c in CLUSTERS for part in SPLIT[c] if u in part}
        assert set(whole[layer, u]) == (set().union(*(want[c] for c in roles)) if asked else set(range(40, 49)))


def test_top_tokens(protocol):
    rng = np.random.default_rng(8)
    unembed = rng.integers(-2, 3, (9, DIM)).astype(float)  # ties
    lens = Lens({1: np.eye(DIM)}, unembed, list(range(9)), np.ones(DIM))
    for limit in (1 << 28, 200):
        for r in token_scores(protocol.rows.select("tag", "layer", "uid", "h"), {"m": lens}, limit=limit, top=4).collect():
            h = H[r["uid"]]
            logits = unembed @ (h / np.sqrt((h * h).mean() + 1e-6))
            assert r["values"] == pytest.approx(sorted(logits, reverse=True)[:4])
            assert len(set(r["features"])) == 4 and all(logits[f] == pytest.approx(v) for f, v in zip(r["features"], r["values"]))


def test_candidate_tokens(spark):
    vocabulary = spark.createDataFrame(
        [(1, " tool", False), (2, "tool", False), (3, " use", True), (4, "us", False), (5, "e", False), (6, " plan", False)],
        "token_id int, text string, is_special boolean",
    )
    verbalizers = spark.createDataFrame([("a", ["plan", "tool", "use", "plan"]), ("b", ["none"])], "name string, words array<string>")
    whole = whole_word_candidates(verbalizers, vocabulary).orderBy("order").collect()
    assert [(r["name"], r["token_id"]) for r in whole] == [("a", 6), ("a", 1)]
    pieces = spark.createDataFrame([("using", 4), ("using", 5), ("tool", 5)], "word string, token_id int")
    names = spark.createDataFrame([("tool_using",), ("use",)], "name string")
    got = sorted((r["name"], r["token_id"]) for r in fragment_candidates(names, vocabulary, pieces).collect())
    assert got == [("tool_using", 1), ("tool_using", 2), ("tool_using", 4), ("tool_using", 5)]
    with pytest.raises(ValueError, match="use"):
        require_coverage(names, fragment_candidates(names, vocabulary, pieces))


def test_pooled_vectors(protocol):
    got = {r["cluster_id"]: r["pooled"] for r in O.pooled_vectors(protocol.moments).filter("layer = 1").collect()}
    for c in CLUSTERS:
        means = {}
        for u in H:
            if c in TAGS[u]:
                means.setdefault(DATASET[u], []).append(H[u])
        assert np.allclose(got[c], np.mean([np.mean(m, 0) for m in means.values()], 0), atol=1e-9)


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(i % 3, 9 - i % 3) for i in range(12)], "a int, b int")
    assert O.adjusted_rand(same, "a", "b").first()[0] == pytest.approx(1.0)
    # Two labellings of six items with one item moved: (4 - 2.8) / (6.5 - 2.8).
    moved = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1)], "a int, b int")
    assert O.adjusted_rand(moved, "a", "b").first()[0] == pytest.approx((4 - 2.8) / (6.5 - 2.8))
    one = spark.createDataFrame([(0, 0), (0, 0)], "a int, b int")
    assert O.adjusted_rand(one, "a", "b").first()[0] == 1.0


def test_silhouette_prefers_the_true_number(spark):
    rng = np.random.default_rng(1)
    points = [("m", 1 + i % 2, f"c{i}", [float(a) for a in rng.normal(10 * (i // 2 % (3 + i % 2)), 0.3, 4)]) for i in range(60)]
    df = spark.createDataFrame(points, "tag string, layer int, cluster_id string, pooled array<double>")
    scores = {(r["layer"], r["k"]): r["silhouette"] for r in O.silhouette_sweep(df, [2, 3, 4, 5, 29, 30]).collect()}
    assert {k for _, k in scores} == {2, 3, 4, 5, 29}
    assert max((k for l, k in scores if l == 1), key=lambda k: scores[1, k]) == 3
    assert max((k for l, k in scores if l == 2), key=lambda k: scores[2, k]) == 4


def test_silhouette_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x, label = rng.normal(3, 1, (40, 5)), rng.integers(0, 6, 40)
    x[1], label[:2], label[2] = x[0], 5, 6  # two equal points, and one alone
    rows = [("m", 1, f"c{i}", int(label[i]), [float(a) for a in x[i]]) for i in range(40)]
    df = spark.createDataFrame(rows, "tag string, layer int, cluster_id string, lab int, pooled array<double>")
    gaps, scores = ((x[:, None] - x[None]) ** 2).sum(2), []
    for i in range(40):
        mean = {c: gaps[i, label == c].sum() / max((label == c).sum() - (c == label[i]), 1) for c in set(label)}
        own, near = mean.pop(label[i]), min(mean[c] for c in mean if c != label[i])
        scores.append((near - own) / max(near, own) if (label == label[i]).sum() > 1 else 0.0)
    assert O.silhouette(df, "lab").first()["silhouette"] == pytest.approx(np.mean(scores))


@pytest.mark.parametrize("x, label, score", [
    ([[0.0], [0.0], [5.0]], [0, 0, 1], 2 / 3),
    ([[0.0], [0.0], [5.0]], [0, 0, 0], 0.0),
    ([[0.1, 0.7]] * 4, [0, 0, 1, 1], 0.0),
])
def test_silhouette_of_single_and_equal_points(spark, x, label, score):
    rows = [("m", 1, f"c{i}", label[i], v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "tag string, layer int, cluster_id string, lab int, pooled array<double>")
    assert O.silhouette(df, "lab").first()["silhouette"] == pytest.approx(score)


def test_k_means_of_equal_and_no_points(spark):
    schema = "tag string, layer int, cluster_id string, pooled array<double>"
    same = spark.createDataFrame([("m", 1, f"c{i}", [1.0, 2.0]) for i in range(4)], schema)
    assert [(r["k"], r["silhouette"]) for r in O.silhouette_sweep(same, [2, 3, 9]).orderBy("k").collect()] == [(2, 0.0), (3, 0.0)]
    assert O.silhouette_sweep(same.limit(0)).count() == 0


def test_vector_mean_weighted(spark):
    df = spark.createDataFrame([([1.0], 1), ([4.0], 3)], "v array<double>, n int")
    assert df.agg(vector_mean(F.col("v"), F.col("n"))).first()[0] == [3.25]


def test_train_aucs_need_negatives(spark, protocol):
    scores = spark.createDataFrame(
        [], "tag string, layer int, cluster_id string, role string, dataset_id string, feature int, score double"
    )
    assert X.train_aucs(scores, protocol.folds, protocol.split).count() == 0
