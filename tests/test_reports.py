import pytest
from pyspark.sql import functions as F

from capsonde.operators import cleaning as C
from capsonde.operators import lobo as L
from capsonde.operators import reports as R
from capsonde.plans import cleaning_loop, probing

RESULTS = "tag string, layer int, cluster_id string, diffmean double, pca double, lr double"


def results(spark):
    return spark.createDataFrame([
        ("m", 7, "a", 0.9, 0.5, None), ("m", 7, "b", 0.7, 0.7, 0.6),
        ("m", 14, "a", 0.8, 0.6, 0.9), ("m", 14, "b", 0.8, 0.8, 0.8),
        ("n", 9, "a", 0.4, 0.4, 0.4),
    ], RESULTS)


def test_method_means_skip_nulls(spark):
    means = {(r["tag"], r["layer"], r["method"]): r for r in R.method_means(R.long_methods(results(spark))).collect()}
    assert means["m", 7, "lr"]["n"] == 1 and means["m", 7, "lr"]["mean"] == 0.6
    assert means["m", 14, "diffmean"]["strong"] == 2 and means["m", 7, "diffmean"]["median"] == pytest.approx(0.8)


def test_best_depth_ties_go_to_the_shallower(spark):
    best = {(r["tag"], r["method"]): r for r in R.best_depth(R.method_means(R.long_methods(results(spark)))).collect()}
    assert best["m", "diffmean"]["layer"] == 7 and best["m", "pca"]["layer"] == 14
    assert best["m", "lr"]["all_layers"] == {7: 0.6, 14: pytest.approx(0.85)}


# Published mean scores of one model at its four depths, method by method.
PUBLISHED = {
    "diffmean": {7: 0.7461702127659573, 14: 0.7627553191489361, 21: 0.7716063829787234, 28: 0.7750319148936171},
    "pca": {7: 0.685404255319149, 14: 0.6815319148936171, 21: 0.7253297872340424, 28: 0.7097234042553193},
    "lr": {7: 0.7626382978723403, 14: 0.7584042553191489, 21: 0.758936170212766, 28: 0.7459361702127657},
}
GOLDEN = {"diffmean": (28, 0.7750319148936171), "pca": (21, 0.7253297872340424), "lr": (7, 0.7626382978723403)}


@pytest.mark.parametrize("method", sorted(PUBLISHED))
def test_published_best_depth(spark, method):
    means = spark.createDataFrame(
        [("m", layer, method, mean) for layer, mean in PUBLISHED[method].items()],
        "tag string, layer int, method string, mean double",
    )
    row = R.best_depth(means).first()
    assert (row["layer"], row["auc"]) == GOLDEN[method]
    assert row["all_layers"] == PUBLISHED[method]


def test_wide_and_long_are_inverse(spark):
    wide = R.wide_methods(R.long_methods(results(spark)))
    assert sorted(map(str, wide.select(*RESULTS.replace(" string", "").replace(" int", "").replace(" double", "").split(", ")).collect())) == sorted(
        map(str, results(spark).collect()))


def test_wins_break_ties_by_method_order(spark):
    cells = R.long_methods(results(spark)).filter("layer <> 7")
    wins = {r["method"]: (r["wins"], r["share"]) for r in R.method_wins(cells).collect()}
    assert wins == {"lr": (1, pytest.approx(1 / 3)), "diffmean": (2, pytest.approx(2 / 3))}


def test_report_order_takes_null_as_zero(spark):
    df = spark.createDataFrame([("b", None), ("a", 0.0), ("c", 0.2), ("d", -0.1)], "cluster_id string, s double")
    assert [r["cluster_id"] for r in R.by_score(df, "s").collect()] == ["c", "a", "b", "d"]


def test_tier_counts(spark):
    df = spark.createDataFrame([("m", 1, v) for v in (0.8, 0.79, 0.65, 0.649, None)], "tag string, layer int, lobo_med double")
    row = R.tier_counts(df).first()
    assert (row["n_lobo"], row["strong"], row["moderate"], row["weak"]) == (4, 1, 2, 1)


def test_summaries(spark):
    df = spark.createDataFrame([("m", v) for v in (0.8, 0.7, 0.69, 0.55, 0.56, None)], "k string, v double")
    assert tuple(R.score_summary(df, "k", "v").first())[3:] == (1, 3)
    assert tuple(R.transfer_summary(df, "k", "v").first())[1:4] == (5, 5, 4)
    d = spark.createDataFrame([("m", v) for v in (0.05, -0.05, 0.06, -0.2, 0.0, None)], "k string, d double")
    assert tuple(R.delta_summary(d, "k", "d", 0.05).first())[3:] == (1, 1, 3)
    runs = spark.createDataFrame([("m", "base", 0.5), ("m", "A", 0.6), ("m", "A", 0.8)], "k string, v string, x double")
    assert R.ablation_deltas(runs, "k", "v", "x", "base", ["A"]).first()["delta_A"] == pytest.approx(0.2)


FOLDS = "tag string, cluster_id string, dataset_id string, auc double"


def voting(spark):
    """Ten models; shares of suspect votes stated per mapping; one capability is too weak."""
    rows = []
    suspect = {"six": 6, "five": 5, "clean": 0}
    for m in range(10):
        for d, n in suspect.items():
            rows.append((f"m{m}", "cap", d, 0.4 if m < n else 0.9))
        rows.append((f"m{m}", "cap", "edge", 0.5))
        rows.append((f"m{m}", "weak", "six", 0.1))
        rows.append((f"m{m}", "limit", "six", 0.65))
    for m in range(2):
        rows.append((f"m{m}", "rare", "two", 0.1))
        rows.append((f"m{m}", "rare", "ok", 0.9))
        rows.append((f"m{m}", "rare", "fine", 0.9))
    return spark.createDataFrame(rows, FOLDS)


def summary(folds):
    return L.fold_summary(folds, ["tag", "cluster_id"]).withColumn(
        "lobo_med", F.when(F.col("cluster_id") == "cap", 0.9).otherwise(F.col("lobo_med"))
    )


def test_votes_and_removals(spark):
    folds = voting(spark)
    voted = C.votes(folds, summary(folds))
    got = {(r["cluster_id"], r["dataset_id"]): (r["suspect"], r["eligible"]) for r in voted.collect()}
    assert got["cap", "six"] == (6, 10) and got["cap", "edge"] == (0, 10) and got["limit", "six"] == (0, 10)
    assert ("weak", "six") not in got and got["rare", "two"] == (2, 2)
    manual = spark.createDataFrame([("cap", "six"), ("weak", "x")], "cluster_id string, dataset_id string")
    removed = sorted(tuple(r) for r in C.removals(voted, manual).collect())
    assert removed == [("cap", "six"), ("weak", "x")]
    log = sorted((r["dataset_id"], r["verdict"]) for r in C.cleaning_log(voted, manual).collect())
    assert log == [("five", "kept"), ("six", "manual"), ("six", "removed"), ("two", "kept"), ("x", "manual")]


def test_votes_act_on_rounded_values(spark):
    folds = spark.createDataFrame([("m", "c", "d", 0.4996), ("m", "c", "e", 0.9)], FOLDS)
    med = spark.createDataFrame([("m", "c", 0.65)], "tag string, cluster_id string, lobo_med double")
    assert {r["dataset_id"]: r["suspect"] for r in C.votes(folds, med).collect()} == {"d": 0, "e": 0}


def removed_frame(spark):
    return spark.createDataFrame([("c1", "d"), ("c2", "d"), ("c9", "other")], "cluster_id string, dataset_id string")


def test_patched_texts_stay_as_negatives(spark):
    texts = spark.createDataFrame(
        [("u1", "d", ["c2", "c3", "c1"]), ("u2", "d", ["c1"]), ("u3", "e", ["c1"])],
        "uid string, dataset_id string, clusters array<string>",
    )
    patched = C.patch_texts(texts, removed_frame(spark))
    got = {r["uid"]: (r["clusters"], r["patched"]) for r in patched.collect()}
    assert got == {"u1": (["c3"], True), "u2": ([], True), "u3": (["c1"], False)}
    again = {r["uid"]: r["clusters"] for r in C.patch_texts(patched.drop("patched"), removed_frame(spark)).collect()}
    assert again == {u: c for u, (c, _) in got.items()}


def test_patched_matches(spark):
    matches = spark.createDataFrame([
        ("b1", "d", ["x (c1)", "y (c3)"], None), ("b2", "d", ["x (c1)", "z (c2)"], "was here"),
        ("b3", "d", ["x (c10)"], None), ("b4", None, ["x (c1)"], None), ("b5", "d", [], None), ("b6", "e", ["x (c1)"], None),
    ], "benchmark string, match string, clusters array<string>, note string")
    got = {r["benchmark"]: (r["match"], r["clusters"], r["note"]) for r in C.patch_matches(matches, removed_frame(spark)).collect()}
    assert got == {
        "b1": ("d", ["y (c3)"], None), "b2": (None, [], "removed_by_probe_cleaning"), "b3": ("d", ["x (c10)"], None),
        "b4": (None, ["x (c1)"], None), "b5": ("d", [], None), "b6": ("e", ["x (c1)"], None),
    }


def test_suspects_follow_rounded_limits(spark):
    folds = spark.createDataFrame(
        [("m", 1, "c", "a", 0.4994), ("m", 1, "c", "b", 0.4996), ("m", 1, "low", "a", 0.1)],
        "tag string, layer int, cluster_id string, hold string, auc double",
    )
    med = spark.createDataFrame([("m", 1, "c", 0.65), ("m", 1, "low", 0.649)], "tag string, layer int, cluster_id string, lobo_med double")
    assert [(r["dataset_id"], r["auc"]) for r in L.suspects(folds, med).collect()] == [("a", 0.499)]


def test_the_loop_from_sweep_to_patched_corpus(spark):
    from workload import inputs as I

    sf = "/root/testdata/sf0.001"
    texts = I.probe_texts(spark, sf)
    sweep = probing.sweep(I.hidden(spark, sf), texts, per_dataset=I.NEGATIVES)
    best = sweep.best.first()["best_layer"]
    rows = sweep.results.collect()
    assert len(rows) == 12 and {r["layer"] for r in rows} == {best}
    assert all(r["spec_rank"] >= 1 and r["lobo_lr"] is not None for r in rows)
    matches = spark.createDataFrame([("b", "b0_0", ["label zero (cap0)"], None)], "benchmark string, match string, clusters array<string>, note string")
    manual = spark.createDataFrame([("cap0", "b0_0")], "cluster_id string, dataset_id string")
    cleaned = cleaning_loop.clean(sweep, texts, matches, manual)
    n = texts.filter("dataset_id = 'b0_0'").count()
    assert {r["what"]: r["n"] for r in cleaning_loop.totals(cleaned).collect()} == {"mappings": 1, "matches": 1, "texts": n}
