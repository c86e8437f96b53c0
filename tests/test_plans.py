"""What the physical plans must show at any size."""

import re

import pytest
from pyspark.sql import functions as F

from capsonde.operators import abilities as A
from capsonde.operators import corpus as P
from capsonde.operators import directions as D
from capsonde.operators import lens as N
from capsonde.operators import linear_probes as M
from capsonde.operators import lobo as L
from capsonde.operators import sampling as S
from capsonde.operators import sparse as Z
from capsonde.session import broadcast_if_small, materialize, shared_dir
from capsonde.sources import hidden as H
from workload import inputs as I

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketed_hidden_states_join_without_a_shuffle(spark, no_auto_broadcast):
    texts = I.probe_texts(spark, SF)
    split = materialize(S.negative_split(texts, I.NEGATIVES))
    H.write_bucketed(I.hidden(spark, SF), "hidden_b", 4)
    H.write_bucketed(texts, "texts_b", 4)
    rows = D.with_roles(spark.table("hidden_b"), spark.table("texts_b"), split)
    plan = physical(rows)
    assert "SortMergeJoin" in plan and "hashpartitioning(uid" not in plan.replace(
        "\n", " ").split("BroadcastExchange")[0]
    stored = rows.groupBy("layer").count().collect()
    plain = D.with_roles(I.hidden(spark, SF), texts, split).groupBy("layer").count().collect()
    assert sorted(map(tuple, stored)) == sorted(map(tuple, plain))


def test_partitioned_and_bucketed_states_are_pruned_and_not_shuffled(spark, no_auto_broadcast):
    texts = I.probe_texts(spark, SF)
    H.write_bucketed(I.hidden(spark, SF), "hidden_pb", 4, partition_by=H.LAYER)
    H.write_bucketed(texts, "texts_pb", 4)
    one = spark.table("hidden_pb").filter("tag = 'm' AND layer = 2")
    joined = one.join(spark.table("texts_pb").select("uid", "dataset_id"), "uid")
    plan = physical(joined)
    assert "Exchange" not in plan and re.search(r"PartitionFilters: \[[^\]]*layer", plan)
    want = I.hidden(spark, SF).filter("layer = 2").join(texts.select("uid", "dataset_id"), "uid")
    assert sorted(map(str, joined.select("uid", "h").collect())) == sorted(map(str, want.select("uid", "h").collect()))


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_moments_combine_before_the_shuffle(spark):
    texts = I.probe_texts(spark, SF)
    rows = D.with_roles(I.hidden(spark, SF), texts, materialize(S.negative_split(texts, I.NEGATIVES)))
    plan = physical(D.group_moments(rows))
    order = [plan.index(step) for step in ("ObjectHashAggregate", "Exchange hashpartitioning(tag#", "MapInArrow")]
    assert order == sorted(order)
    assert "Exchange" not in plan[order[1] + 8 : order[2]]


def test_probe_fits_never_exchange_vectors(spark, tmp_path):
    texts = I.probe_texts(spark, SF)
    H.write_hidden(I.hidden(spark, SF), str(tmp_path / "h"))
    p = L.Protocol(H.read_hidden(spark, str(tmp_path / "h")), texts, per_dataset=I.NEGATIVES)
    scaling = D.standardiser(p.moments)
    blocks = M.protocol_blocks(p.rows, scaling)
    named = p.folds.join(scaling.select("tag", "layer", F.col("mu").alias("w")), how="cross").withColumn("dir_id", F.lit(1))
    for plan in (
        physical(M._packed(p.rows.select("tag", "layer", "dataset_id", "h", F.lit("c").alias("cluster_id"), F.lit(2).alias("role")), scaling.withColumnRenamed("mu", "w"))),
        physical(M.product_tiles(blocks)),
        physical(M._loss_sums(blocks, M._shared(named), 0.1)),
        physical(M.score_blocks(blocks, named)),
    ):
        below = plan[plan.index("MapInArrow") :]
        vectors = [x for x in below.split("\n") if "Exchange" in x and ("h#" in x or "z#" in x)]
        scan = next(i for i, x in enumerate(below.split("\n")) if "Scan parquet" in x and ("h#" in x or "z#" in x))
        depth = len(re.match(r"[ :|+*()0-9-]*", below.split("\n")[scan]).group())
        over = [x for x in below.split("\n")[:scan] if len(re.match(r"[ :|+*()0-9-]*", x).group()) < depth]
        assert not vectors and not any("Exchange" in x and "Broadcast" not in x for x in over[1:])


@pytest.mark.parametrize("limit", [1 << 20, 512])
def test_weights_above_the_limit_take_one_scan(spark, limit):
    hidden = I.hidden(spark, SF).drop("dataset_id")
    plans = [physical(Z.encode(hidden, I.sae_encoders(spark, SF), limit)), physical(N.token_scores(hidden, I.lens(spark, SF), limit=limit))]
    whole = physical(hidden.filter("layer = 3"))
    assert all(p.count("Scan parquet") == whole.count("Scan parquet") for p in plans)


@pytest.mark.parametrize("make", [
    lambda s: S.negative_candidates(I.probe_texts(s, SF), I.NEGATIVES),
    lambda s: P.sample_texts(s.range(10**6).select(F.col("id").alias("row_idx"), (F.col("id") % 2).alias("dataset_id"))),
    lambda s: P.cap_rows(s.range(10**6).select(F.col("id").alias("row_idx"), (F.col("id") % 2).alias("dataset_id"))),
    lambda s: A.most_common(I.table(s, SF, "part"), ["p_brand"], "p_name", F.col("p_partkey"), 3),
])
def test_top_k_windows_cut_before_the_shuffle(spark, make):
    assert re.search(r"WindowGroupLimit .*Partial", physical(make(spark)))


def test_limited_and_whole_fields_share_one_aggregate(spark, no_auto_broadcast):
    from capsonde.plans import refinement

    raw = refinement.refine(I.judge_results(spark, SF)).raw_abilities
    df = A.ability_values(raw)
    df.collect()
    assert "ReusedExchange" in physical(df)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    H.write_hidden(I.hidden(spark, SF), str(tmp_path / "h"))
    plan = physical(H.read_hidden(spark, str(tmp_path / "h"), ["m"], [2]).select("uid"))
    assert "PartitionFilters: [tag#" in plan or re.search(r"PartitionFilters: \[.*layer", plan)
    assert "ReadSchema: struct<uid:string>" in plan


def test_broadcast_hint_only_under_the_limit(spark):
    df = spark.range(100)
    assert "ResolvedHint" in broadcast_if_small(df, 8, 800)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(df, 8, 792)._jdf.queryExecution().analyzed().toString()


def test_shared_dir_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured
    assert configured in spark.sparkContext.getCheckpointDir()
