"""Judged records, ability merging, JSON lines, streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from capsonde.operators import abilities as A
from capsonde.operators import judging as J
from capsonde.plans import refinement
from capsonde.session import scratch_path
from capsonde.sources import jsonl
from capsonde.sources.schemas import CLUSTERS, JUDGE_RESULTS, MENTIONS
from capsonde.streaming import judgments as ST


def result(pos, text, status="ok", **more):
    row = {"pos": pos, "cluster_id": f"r{pos}", "family": "fam", "size": pos * 10, "status": status,
           "response_text": text, **more}
    return json.dumps(row)


ABILITY = {"ability_name": "Plan Making", "definition": "d1", "source_benchmark_examples": ["b1", "b2"],
           "contrast_pair_feasibility": "yes"}
LINES = [
    result(0, json.dumps({"cluster_id": "j0", "representation_fit": "keep", "fit_score": "4",
                          "latent_abilities": [ABILITY, {"ability_name": "Recall"}]})),
    result(1, "```json\n" + json.dumps({"family": None, "representation_fit": None, "latent_abilities": None}) + "\n```"),
    result(2, 'As asked: {"representation_fit": "drop", "fit_score": {"odd": 1}, "latent_abilities": []} bye'),
    result(3, '{"representation_fit": "keep"'),
    result(4, '[{"representation_fit": "keep"}]'),
    result(5, None, status="error", error="timed out"),
    result(6, json.dumps({"latent_abilities": [{**ABILITY, "ability_name": "plan-making!", "definition": "d2"}]})),
    result(7, ""),
]


@pytest.fixture(scope="module")
def results(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    return lines.select(F.from_json("value", JUDGE_RESULTS).alias("r")).select("r.*")


def test_outcomes(results):
    got = {r["pos"]: r["outcome"] for r in J.parse_replies(results).collect()}
    assert got == {0: "parsed", 1: "parsed", 2: "parsed", 3: "parse_error", 4: "parse_error",
                   5: "request_error", 6: "parsed", 7: "parse_error"}


def test_judgment_defaults_only_fill_missing_keys(results):
    got = {r["pos"]: r for r in refinement.refine(results).judgments.collect()}
    assert (got[0]["cluster_id"], got[0]["family"], got[0]["fit_score"]) == ("j0", "fam", 4)
    assert (got[1]["cluster_id"], got[1]["family"]) == ("r1", None)
    assert got[2]["fit_score"] is None and got[2]["representation_fit"] == "drop"
    assert got[6]["_source_size"] == 60


def test_rejects_keep_error_or_text(results):
    got = {r["pos"]: (r["error"], r["text"]) for r in refinement.refine(results).rejects.collect()}
    assert got[5] == ("timed out", None)
    assert got[3] == ("not a JSON object", '{"representation_fit": "keep"')
    assert set(got) == {3, 4, 5, 7}


def test_summary_counts(results):
    got = {r["metric"]: r["n"] for r in refinement.refine(results).summary.collect()}
    assert got == {"results": 8, "request_errors": 1, "parse_errors": 3, "parsed": 4, "fit:keep": 1,
                   "fit:None": 1, "fit:drop": 1, "fit:missing": 1, "raw_abilities": 3}


def test_raw_abilities_is_reported_when_there_are_none(spark, results):
    got = {r["metric"]: r["n"] for r in J.summary_counts(J.parse_replies(results.filter("pos = 5"))).collect()}
    assert got == {"results": 1, "request_errors": 1, "raw_abilities": 0}


def test_final_abilities_merge_by_name(results):
    final = {r["ability_name"]: r for r in refinement.refine(results).final_abilities.collect()}
    plan = final["plan_making"]
    assert plan["display_name"] == "Plan Making" and plan["mention_count"] == 2
    assert [(e["value"], e["count"]) for e in plan["definition_candidates"]] == [("d1", 1), ("d2", 1)]
    assert [(e["value"], e["count"]) for e in plan["top_benchmark_examples"]] == [("b1", 2), ("b2", 2)]
    assert [(e["value"], e["count"]) for e in plan["generalities"]] == [(None, 2)]
    assert plan["representation_family"] == "fam" and plan["source_cluster_count"] == 2
    assert final["recall"]["definition_candidates"] == []


RAW = "pos bigint, ability_index int, source_cluster_id string, source_family string, " + ", ".join(
    f"{c} string" for c in J.ABILITY_STRINGS
) + ", source_benchmark_examples array<string>, source_task_examples array<string>"


def raw(spark, rows):
    blank = dict.fromkeys(["source_cluster_id", "source_family", *J.ABILITY_STRINGS, *J.ABILITY_LISTS])
    return spark.createDataFrame(
        [{**blank, "pos": i, "ability_index": 0, "ability_name": "a", **r} for i, r in enumerate(rows)], RAW
    )


def test_filters_let_unknown_values_pass(spark):
    rows = [{"contrast_pair_feasibility": "no"}, {"generality": "narrow"}, {}, {"generality": "x"}]
    r = raw(spark, rows)
    assert [x["pos"] for x in A.usable(r).orderBy("pos").collect()] == [2, 3]
    assert A.usable(r, keep_no_contrast=True, keep_narrow=True).count() == 4


def test_source_count_takes_a_missing_cluster_as_one_value(spark):
    r = raw(spark, [{"source_cluster_id": c} for c in ("x", None, "y", None, "x")])
    row = A.source_counts(r).first()
    assert (row["source_cluster_count"], row["mention_count"]) == (3, 5)


def test_first_seen_wins_a_tie(spark):
    r = raw(spark, [{"definition": d} for d in ("z", "a", "a", "z", "m", "b", "c")])
    got = A.ability_values(r).filter("field = 'definition'").orderBy("rank").collect()
    assert [(x["value"], x["count"]) for x in got] == [("z", 2), ("a", 2), ("m", 1)]


def test_list_order_breaks_ties_inside_a_record(spark):
    r = raw(spark, [{"source_task_examples": ["t2", "t1"]}, {"source_task_examples": ["t1", "t2"]}])
    got = A.ability_values(r).filter("field = 'source_task_examples'").orderBy("rank").collect()
    assert [x["value"] for x in got] == ["t2", "t1"]


def test_final_order(spark):
    r = raw(spark, [
        {"ability_name": "b", "representation_family": "f2", "source_cluster_id": "1"},
        {"ability_name": "c", "representation_family": "f1", "source_cluster_id": "1"},
        {"ability_name": "a", "representation_family": "f1", "source_cluster_id": "1"},
        {"ability_name": "c", "representation_family": "f1", "source_cluster_id": "2"},
    ])
    assert [x["ability_name"] for x in A.build_final(r).collect()] == ["c", "a", "b"]


@pytest.fixture(scope="module")
def evidence(spark):
    clusters = spark.createDataFrame(
        [{"cluster_id": c, "family": "f", "size": 3, "top_tasks": [(f"t{i}", i) for i in range(20)] if c == "a" else None}
         for c in ("a", "b")], CLUSTERS,
    ).withColumn("pos", F.ascii("cluster_id"))
    mentions = spark.createDataFrame(
        [{"pos": 100 - i, "cluster_id": "a", "canonical_name": f"n{i}", "definition": "w " * 300} for i in range(12)], MENTIONS
    )
    return clusters, mentions


def test_prompts_show_shortened_evidence(evidence):
    clusters, mentions = evidence
    got = {r["cluster_id"]: r["prompt"] for r in refinement.prompts(clusters, mentions).collect()}
    payload = json.loads(got["a"].split("Now judge this cluster:\n\n")[1])
    shown = payload["representative_mentions"]
    assert [m["capability_name"] for m in shown] == [f"n{i}" for i in range(11, 1, -1)]
    assert len(shown[0]["definition"]) == 450 and shown[0]["definition"].endswith("w...")
    assert len(payload["top_tasks"]) == 12 and payload["top_domains"] == []
    assert payload["representative_mentions"][0]["agentic_dimensions"] == []
    assert json.loads(got["b"].split("Now judge this cluster:\n\n")[1])["representative_mentions"] == []


def test_prompts_limit_and_resume(spark, evidence):
    clusters, mentions = evidence
    assert [r["cluster_id"] for r in refinement.prompts(clusters, mentions, limit=1).collect()] == ["a"]
    done = spark.createDataFrame([("a",), ("a",)], "cluster_id string")
    assert [r["cluster_id"] for r in refinement.prompts(clusters, mentions, done).collect()] == ["b"]


def test_jsonl_round_trip_keeps_nulls_and_order(spark):
    path = scratch_path(spark, "t")
    df = spark.createDataFrame([(i, None if i % 2 else "é\n") for i in range(50)], "i int, s string")
    jsonl.write_jsonl(df.coalesce(1), path)
    with open(next(os.path.join(path, f) for f in os.listdir(path) if f.startswith("part")), encoding="utf-8") as f:
        lines = f.read().splitlines()
    assert lines[0] == '{"i":0,"s":"é\\n"}' and lines[1] == '{"i":1,"s":null}'
    back = jsonl.read_jsonl(spark, path, "i int, s string", order="at").orderBy("at")
    assert [r["i"] for r in back.collect()] == list(range(50))


def test_tolerant_read(spark):
    path = scratch_path(spark, "t")
    lines = ['{"cluster_id":"a","n":1}', "garbage", '{"cluster_id":""}', '{"n":2}', '{"cluster_id":"b"', '{"cluster_id":"c"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = jsonl.read_jsonl_tolerant(spark, path, "cluster_id string, n int", "cluster_id")
    assert sorted(r["cluster_id"] for r in got.collect()) == ["a", "c"]
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, path, "cluster_id string, n int").collect()


def test_failed_rows_count_as_done_unless_retried(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "k int")
    done = spark.createDataFrame([(0, "ok"), (1, "error"), (1, "error"), (2, None)], "k int, status string")
    assert [r["k"] for r in jsonl.pending(rows, done, "k").collect()] == [3]
    assert sorted(r["k"] for r in jsonl.pending(rows, done, "k", retry_errors=True).collect()) == [1, 2, 3]


def test_append_pending_is_idempotent(spark):
    path = scratch_path(spark, "log")
    rows = spark.createDataFrame([(i,) for i in range(5)], "k int")
    for _ in range(2):
        log = jsonl.append_pending(rows, path, "k", lambda todo: todo.withColumn("v", F.col("k") * 2))
    assert sorted((r["k"], r["v"]) for r in log.collect()) == [(i, 2 * i) for i in range(5)]


def test_corpus_slice_needs_enough_texts(spark):
    texts = spark.createDataFrame([(i, " " * 5 + "x" * (595 + i)) for i in range(10)], "pos int, text string")
    assert [r["pos"] for r in jsonl.corpus_slice(texts, 3).collect()] == [5, 6, 7]
    with pytest.raises(ValueError, match="only found 5"):
        jsonl.corpus_slice(texts, 6)


def test_next_shard(spark):
    assert jsonl.next_shard(spark.createDataFrame([(0,), (3,), (1,)], "shard int")).first()[0] == 4


def test_stream_takes_up_where_it_stopped(spark):
    source, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    whole = spark.createDataFrame([(x,) for x in LINES], "value string").repartition(3)
    whole.limit(3).write.text(source)
    ST.refine_stream(ST.read_results(spark, source), out, state).awaitTermination()
    first = ST.read_output(spark, out, "judgments").count() + ST.read_output(spark, out, "rejects").count()
    assert first == 3
    seen = {r["value"] for r in spark.read.text(source).collect()}
    whole.filter(~F.col("value").isin(list(seen))).write.mode("append").text(source)
    ST.refine_stream(ST.read_results(spark, source, per_trigger=1), out, state).awaitTermination()
    judged = ST.read_output(spark, out, "judgments")
    assert sorted(r["pos"] for r in judged.collect()) == [0, 1, 2, 6]
    assert ST.read_output(spark, out, "rejects").count() == 4
    assert ST.read_output(spark, out, "abilities").count() == 3


def mention_rows(spark, rows):
    blank = dict.fromkeys(c.split(" ")[0] for c in MENTIONS.split(", "))
    return spark.createDataFrame([{**blank, "cluster_id": c, "pos": p, "definition": d} for c, p, d in rows], MENTIONS)


def test_mentions_without_cluster_or_place(spark):
    rows = [("a", p, f"a{p}") for p in (5, 3, None, 9, 7, 1)] + [(None, p, f"n{p}") for p in (2, None, 1, 4)] + [("b", 8, "b8")]
    rows += [("t", 1, "t1"), *[("t", 2, "t2")] * 5, ("t", 3, "t3"), *[("u", None, "uNone")] * 5, ("u", 1, "u1")]
    got = J.representative_mentions(mention_rows(spark, rows), 3).collect()
    by_cluster = {}
    for r in sorted(got, key=lambda r: r["mention_no"]):
        by_cluster.setdefault(r["cluster_id"], []).append(r["definition"])
    assert by_cluster == {"a": ["aNone", "a1", "a3"], None: ["nNone", "n1", "n2"], "b": ["b8"],
                          "t": ["t1", "t2", "t2"], "u": ["uNone"] * 3}


def test_texts_of_mentions_are_sorted_only_within_the_limits(spark):
    mentions = mention_rows(spark, [("a", p, f"text {p}") for p in range(40)])
    plan = J.representative_mentions(mentions, 3)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = [x.split("\n") for x in plan.split("\n\n(")[1:]]
    of = lambda kind: [(i, x) for i, x in enumerate(nodes) if x[0].split(") ")[-1].startswith(kind)]
    wide = [i for i, x in of("Sort") if any("definition" in line for line in x if line.startswith("Input"))]
    limited = [i for i, _ in of("BroadcastHashJoin")]
    assert wide and limited and min(limited) < min(wide)


def test_few_mentions_remain_of_many_that_share_a_place(spark):
    rows = [("nulls", None, f"n{i}") for i in range(600)] + [("copies", 4, "same")] * 600
    rows += [("tied", 1, "first"), *[("tied", 2, f"t{i}") for i in range(600)]] + [("few", None, "x"), ("few", 9, "y")]
    mentions = mention_rows(spark, rows).repartition(5).cache()
    sizes = {r["cluster_id"]: r["count"] for r in J.early_mentions(mentions, 3).groupBy("cluster_id").count().collect()}
    assert sizes["copies"] == 3 and sizes["few"] == 2 and 3 <= sizes["nulls"] < 100 and 3 <= sizes["tied"] < 100
    got = {}
    for r in sorted(J.representative_mentions(mentions, 3).collect(), key=lambda r: r["mention_no"]):
        got.setdefault(r["cluster_id"], []).append(r["definition"])
    assert got["copies"] == ["same"] * 3 and got["few"] == ["x", "y"] and got["tied"][0] == "first"
    assert {c: len(set(d)) for c, d in got.items()} == {"nulls": 3, "copies": 1, "tied": 3, "few": 2}
    again = J.representative_mentions(mentions.repartition(2), 3).collect()
    assert sorted(r["definition"] for r in again) == sorted(d for t in got.values() for d in t)


def test_bounds_of_places_take_no_sort(spark):
    mentions = spark.range(5000).selectExpr("id % 3 AS cluster_id", "CASE WHEN id % 3 > 0 OR id % 30 > 0 THEN 9999 - id END AS pos")
    bounds = J.least_bounds(mentions, ["cluster_id"], "pos", 10)
    assert "Sort" not in bounds._jdf.queryExecution().executedPlan().toString().replace("sort_array", "")
    rows = {r["cluster_id"]: r for r in bounds.collect()}
    assert rows[0]["_nulls"] and not rows[1]["_nulls"]
    for c in (1, 2):
        up_to = mentions.filter(f"cluster_id = {c} AND pos <= {rows[c]['_bound']}").count()
        assert 10 <= up_to < 40
