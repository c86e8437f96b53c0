import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capsonde.operators.auc import count_wins, rank_sum_auc


def brute(pos, neg):
    pairs = [(p > n) + 0.5 * (p == n) for p in pos for n in neg]
    return sum(pairs) / len(pairs) if pairs else None


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, part string, s double, y boolean")


SCORES = st.lists(
    st.tuples(st.sampled_from("ab"), st.sampled_from("pq"), st.integers(-4, 4), st.booleans()),
    min_size=20, max_size=60,
)


@settings(max_examples=4, deadline=None)
@given(SCORES)
def test_auc_is_the_pairwise_share(spark, rows):
    rows = [(g, p, s / 3, y) for g, p, s, y in rows]
    got = {r["g"]: r["auc"] for r in rank_sum_auc(frame(spark, rows), ["g"], "s", "y").collect()}
    for g in {r[0] for r in rows}:
        pos = [s for h, _, s, y in rows if h == g and y]
        neg = [s for h, _, s, y in rows if h == g and not y]
        want = brute(pos, neg)
        assert got[g] == (want if want is None else pytest.approx(want, abs=1e-12))


@settings(max_examples=4, deadline=None)
@given(SCORES)
def test_wins_of_parts_share_the_negatives(spark, rows):
    rows = [(g, p, s / 3, y) for g, p, s, y in rows]
    wins = count_wins(frame(spark, rows), ["g"], "s", "y", "part").collect()
    got = {(r["g"], r["part"]): (r["wins"], r["n_pos"], r["n_neg"]) for r in wins}
    for g, p in {(r[0], r[1]) for r in rows if r[3]}:
        pos = [s for h, q, s, y in rows if (h, q) == (g, p) and y]
        neg = [s for h, _, s, y in rows if h == g and not y]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[g, p] == (wins, len(pos), len(neg))
    assert set(got) == {(r[0], r[1]) for r in rows if r[3]}


def test_symmetry_and_monotone_invariance(spark):
    rng = random.Random(3)
    rows = [("g", "p", rng.gauss(0, 1), rng.random() < 0.4) for _ in range(300)]
    df = frame(spark, rows)
    auc = rank_sum_auc(df, ["g"], "s", "y").first()["auc"]
    flipped = rank_sum_auc(df.withColumn("s", -F.col("s")), ["g"], "s", "y").first()["auc"]
    warped = rank_sum_auc(df.withColumn("s", F.exp("s") * 1000), ["g"], "s", "y").first()["auc"]
    assert auc + flipped == pytest.approx(1.0, abs=1e-12)
    assert warped == pytest.approx(auc, abs=1e-12)


def test_all_ties_give_one_half(spark):
    rows = [("g", "p", 0.0, i % 3 == 0) for i in range(200)]
    assert rank_sum_auc(frame(spark, rows), ["g"], "s", "y").first()["auc"] == 0.5


def test_an_empty_class_gives_null(spark):
    rows = [("g", "p", 1.0, True), ("g", "p", 2.0, True)]
    row = rank_sum_auc(frame(spark, rows), ["g"], "s", "y").first()
    assert row["auc"] is None and row["n_neg"] == 0


def test_no_group_is_sorted_in_one_task(spark):
    """The window over scores is partitioned by bucket as well as by group."""
    rows = [("g", "p", float(i), i % 2 == 0) for i in range(10)]
    plan = rank_sum_auc(frame(spark, rows), ["g"], "s", "y")._jdf.queryExecution().optimizedPlan().toString()
    specs = [w.split("windowspecdefinition(")[1] for w in plan.splitlines() if "Window [sum(_q" in w]
    by_score = [spec for spec in specs if "_s#" in spec]
    assert by_score and all("_b#" in spec.split("_s#")[0] for spec in by_score)


def narrow(spark, n, width):
    return spark.range(n).select(
        F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("part"),
        (3.0 + F.floor(F.rand(5) * 5000) / 5000 * width).alias("s"), (F.rand(6) < 0.3).alias("y")).cache()


@pytest.mark.parametrize("width, heavy", [(3e-3, None), (3e-9, 100)])
def test_close_scores_spread_over_many_tasks(spark, width, heavy):
    from capsonde.functions.numbering import cut_heavy_buckets, value_bucket

    df = narrow(spark, 20_000, width)
    cut = df.groupBy("g", value_bucket(F.col("s")).alias("_b"), "s").agg(F.count("*").alias("n")).withColumn("_c", F.lit(0))
    if heavy:
        cut = cut_heavy_buckets(cut.drop("_c"), ["g"], "s", F.col("n"), heavy_rows=heavy)
    sizes = [r["n"] for r in cut.groupBy("_b", "_c").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 20_000 / 10
    rows = [tuple(r) for r in df.collect()]
    pos, neg = [r[2] for r in rows if r[3]], sorted(r[2] for r in rows if not r[3])
    import bisect

    wins = {p: sum((bisect.bisect_left(neg, s) + bisect.bisect_right(neg, s)) / 2 for _, q, s, y in rows if y and q == p) for p in "pq"}
    got = {r["part"]: r["wins"] for r in count_wins(df, ["g"], "s", "y", "part", heavy_rows=heavy).collect()}
    assert got == pytest.approx(wins)
    auc = rank_sum_auc(df, ["g"], "s", "y", heavy_rows=heavy).first()["auc"]
    assert auc == pytest.approx(sum(wins.values()) / len(pos) / len(neg))


@settings(max_examples=3, deadline=None)
@given(SCORES)
def test_cut_buckets_rank_the_same(spark, rows):
    from capsonde.functions.numbering import average_rank

    df = frame(spark, [(g, p, s / 3, y) for g, p, s, y in rows]).cache()
    plain = sorted(map(tuple, average_rank(df, ["g"], "s").collect()))
    assert plain == sorted(map(tuple, average_rank(df, ["g"], "s", heavy_rows=2).collect()))
    assert sorted(map(tuple, count_wins(df, ["g"], "s", "y", "part").collect())) == sorted(
        map(tuple, count_wins(df, ["g"], "s", "y", "part", heavy_rows=2).collect()))
