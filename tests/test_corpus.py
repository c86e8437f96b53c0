import hashlib
import json

import pytest
from pyspark.sql import functions as F

from capsonde.operators import catalog as G
from capsonde.operators import corpus as P
from capsonde.sources.schemas import CANDIDATES, EXPERIMENT_CLUSTERS, FINAL_MENTIONS, SELECTION, SPLITS


def rows_of(spark, datasets):
    data = [(d, i, json.dumps(r)) for d, rows in datasets.items() for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "dataset_id string, row_idx bigint, row_json string")


def roles(spark, *rows):
    df = rows_of(spark, {f"d{i}": [r, {"question": "ignored"}] for i, r in enumerate(rows)})
    got = P.field_roles(P.with_fields(P.first_rows(df))).orderBy("dataset_id").collect()
    return [(r["prim"], r["ctx"], r["opt"]) for r in got]


def test_field_roles(spark):
    assert roles(
        spark,
        {"Text": "a", "QUESTION": "b", "Passage": "c", "choices": ["x"]},
        {"title": "t", "Article": "c", "document": "d"},
        {"prompt": "first", "Prompt": "second"},
        {"idx": 1, "short": "ab", "long": "abc", "also": "abd"},
        {"n": 1, "m": None},
    ) == [
        ("QUESTION", "Passage", "choices"),
        ("title", "document", None),
        ("Prompt", None, None),
        ("long", None, None),
        (None, None, None),
    ]


def assembled(spark, row, **roles_):
    df = rows_of(spark, {"d": [row]})
    r = spark.createDataFrame(
        [("d", roles_.get("prim"), roles_.get("ctx"), roles_.get("opt"), roles_.get("sec"))],
        "dataset_id string, prim string, ctx string, opt string, sec string",
    )
    return P.assemble_rows(df, r).first()["text"]


def test_assemble_order_limits_and_trims(spark):
    row = {"q": "  ask \n", "c": " " + "c" * 3000, "o": ["o" * 700, "p"], "s": "s" * 2000}
    text = assembled(spark, row, prim="q", ctx="c", opt="o")
    assert text == "c" * 2000 + "\n\nask\n\nOptions:\n" + "o" * 600
    assert assembled(spark, row, prim="q", ctx="missing") == "ask"


def test_cut_comes_before_the_secondary_text(spark):
    row = {"q": "q" * 5000, "s": " " + "s" * 2000}
    text = assembled(spark, row, prim="q", sec="s")
    assert text == "q" * 4000 + "\n\n" + "s" * 1500
    assert assembled(spark, {"q": "", "s": "only"}, prim="q", sec="s") == "only"
    assert assembled(spark, {"q": "ask", "s": " "}, prim="q", sec="s") == "ask"


def test_upper_median(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 9, 7)] + [("b", 2)], "k string, v int")
    got = {r["k"]: (r["n"], r["med"]) for r in P.upper_median(df, ["k"], "v", "med").collect()}
    assert got == {"a": (4, 7), "b": (1, 2)}


def corpus_case():
    long = "a long enough text number {} for the rule"
    return {
        "plain": [{"question": long.format(i % 25)} for i in range(40)],
        "few": [{"question": long.format(i)} for i in range(5)],
        "nli": [{"premise": "the same premise in every single row", "label": "no",
                 "hypothesis": f"a hypothesis of its own, {i}", "other": f"also its own value {i // 2}"} for i in range(30)],
        "big": [{"prompt": long.format(i)} for i in range(200)],
        "short": [{"question": f"thirty characters and some {i:03d}"} for i in range(25)],
        "tiny": [{"question": f"short {i}"} for i in range(25)],
        "unlisted": [{"question": long.format(i)} for i in range(30)],
        "failed": [{"question": long.format(i)} for i in range(30)],
    }


@pytest.fixture(scope="module")
def built(spark):
    rows = rows_of(spark, corpus_case())
    listed = [d for d in corpus_case() if d != "unlisted"]
    clusters = spark.createDataFrame(
        [(c, c, [(d, "error" if d == "failed" else "ok", f"{d}.jsonl") for d in listed] + [("gone", "ok", "x"), ("nofile", "ok", "")])
         for c in ("c2", "c1")], EXPERIMENT_CLUSTERS,
    )
    return P.build_probe_texts(rows, P.dataset_clusters(clusters))


def test_mapping_log(built):
    got = {r["dataset_id"]: (r["fields"], r["n_texts"], r["median_chars"], r["status"]) for r in built.log.collect()}
    assert got == {
        "plain": ("question", 25, 41, "ok"),
        "few": ("question", 5, 40, "dropped"),
        "nli": ("premise+hypothesis", 30, len("the same premise in every single row\n\na hypothesis of its own, 15"), "ok"),
        "big": ("prompt", 150, 42, "ok"),
        "short": ("question", 25, 30, "dropped"),
        "tiny": ("question", 0, 0, "dropped"),
    }


def test_probe_texts(built):
    got = built.texts.collect()
    by_dataset = {}
    for r in got:
        assert r["clusters"] == ["c1", "c2"]
        by_dataset.setdefault(r["dataset_id"], {})[r["uid"]] = r["text"]
    assert {d: len(t) for d, t in by_dataset.items()} == {"plain": 25, "nli": 30, "big": 150}
    assert set(by_dataset["plain"]) == {f"plain::{i}" for i in range(25)}
    assert by_dataset["plain"]["plain::3"] == "a long enough text number 3 for the rule"
    key = lambda i: hashlib.md5(f"0:big:{i}".encode()).hexdigest()
    drawn = sorted(sorted(range(200), key=key)[:150])
    assert [by_dataset["big"][f"big::{k}"].split()[5] for k in range(150)] == [str(i) for i in drawn]


def test_secondary_field_tie_goes_to_the_first_key(spark):
    rows = rows_of(spark, {"d": [
        {"question": "same", "one": f"fifteen characters {i}", "two": f"fifteen characters {i}"} for i in range(4)
    ]})
    r = P.field_roles(P.with_fields(P.first_rows(rows)))
    assert P.secondary_fields(rows, r).first()["sec"] == "one"


def test_secondary_field_counts_missing_as_one_value(spark):
    rows = rows_of(spark, {"d": [{"question": "same", "a": "a" * 20, "b": "b" * 20}]
                           + [{"question": "same", "a": f"{'a' * 20}{i % 2}"} for i in range(5)]
                           + [{"question": "same", "b": f"{'b' * 20}{i}"} for i in range(2)]})
    r = P.field_roles(P.with_fields(P.first_rows(rows)))
    # a: three values and the empty one; b: three values and the empty one, later key.
    assert P.secondary_fields(rows, r).first()["sec"] == "a"


def test_copies_collapse_to_the_first_row(spark):
    df = spark.createDataFrame([("d", i, "x" * 30) for i in (7, 3, 9)] + [("d", 1, "y" * 29)], "dataset_id string, row_idx bigint, text string")
    got = P.distinct_texts(df).collect()
    assert [(r["row_idx"], r["n_chars"]) for r in got] == [(3, 30)]


def test_row_cap(spark):
    df = spark.createDataFrame([("a", i) for i in range(9, -1, -1)] + [("b", 1)], "dataset_id string, row_idx bigint")
    assert sorted((r[0], r[1]) for r in P.cap_rows(df, 3).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 1)]


def test_coverage(spark):
    texts = spark.createDataFrame([(["a", "b"],)] * 60 + [(["b"],)], "clusters array<string>")
    assert {r["cluster_id"]: (r["n_texts"], r["weak"]) for r in P.coverage(texts).collect()} == {"a": (60, False), "b": (61, False)}
    assert tuple(P.coverage_summary(texts.limit(10)).first()) == (2, 10, 2)


def test_pick_split(spark):
    rows = [
        ("a", 0, "extra", "train"), ("a", 1, "Main", "train"), ("a", 2, "Main", "Dev"), ("a", 3, "ALL", "test"),
        ("b", 0, "en", "weird"), ("b", 1, "fr", "test"), ("b", 2, "en", "odd"),
        ("c", 0, "default", "val"), ("c", 1, "default", "VALIDATION"), ("c", 2, "default", "testing"),
    ]
    got = {r["dataset_id"]: (r["config"], r["split"]) for r in G.pick_split(spark.createDataFrame(rows, SPLITS)).collect()}
    assert got == {"a": ("Main", "Dev"), "b": ("en", "weird"), "c": ("default", "testing")}


def test_targets(spark):
    selection = spark.createDataFrame([
        (0, "c1", "one", False, [("B1", 3), ("B2", 5)] + [(f"X{i}", 1) for i in range(6)]),
        (1, "c2", "two", True, [("B1", 100)]),
        (2, "c3", "three", False, [("B1", 2)]),
    ], SELECTION)
    mentions = spark.createDataFrame([
        (5, "c1", "B1", "t5"), (1, "c1", "B1", "z1"), (2, "c3", "B1", "z1"), (3, "c2", "B1", "a0"),
        (4, "c1", "B1", None), (6, "c1", "B1", "a6"), (7, "c1", "B2", "y" * 200),
    ], FINAL_MENTIONS)
    got = G.benchmark_targets(selection, mentions).collect()
    assert [(r["benchmark"], r["mentions"]) for r in got] == [("B1", 5), ("B2", 5), ("X0", 1), ("X1", 1), ("X2", 1), ("X3", 1)]
    assert got[0]["clusters"] == ["one (c1)", "three (c3)"]
    assert got[0]["paper_titles"] == ["", "t5", "z1"]
    assert got[1]["paper_titles"] == ["y" * 120] and got[2]["paper_titles"] == []


def test_candidates_and_acceptance(spark):
    rows = [("b", q, p, f"id{(q * 7 + p) % 12}", 1, 2, "d") for q in (1, 0) for p in range(8)]
    c = spark.createDataFrame(rows, CANDIDATES)
    got = G.merged_candidates(c).orderBy("candidate_no").collect()
    assert [r["id"] for r in got] == [f"id{i}" for i in range(12)]
    assert [r["shown"] for r in got] == [True] * 10 + [False] * 2
    proposals = spark.createDataFrame(
        [("b", "id11", "high"), ("c", "id1", "high"), ("b", "None", "low"), ("b", None, "low"), ("b", "other", "low")],
        "benchmark string, proposed string, confidence string",
    )
    accepted = sorted((r["benchmark"], r["match"], r["confidence"]) for r in G.accepted_matches(proposals, c).collect() if r["match"])
    assert accepted == [("b", "id11", "high")]
    assert G.accepted_matches(proposals, c).count() == 5


def test_manifest(spark):
    matches = spark.createDataFrame(
        [(1, "B2", ["y (c2)"], "org/a b"), (0, "B1", ["x (c1)", "y (c2)"], "org/a b"), (2, "B3", ["z"], "none"), (3, "B4", ["z"], None)],
        "pos int, benchmark string, clusters array<string>, match string",
    )
    chosen = spark.createDataFrame([("org/a b", "main", "test")], "dataset_id string, config string, split string")
    rows = rows_of(spark, {"org/a b": [{"z": 1, "a": 2}, {"other": 3}]})
    got = {r["dataset_id"]: r for r in G.manifest(matches, chosen, rows).collect()}
    a = got["org/a b"]
    assert (a["n_benchmarks"], a["clusters"], a["n_rows"], a["file"], a["columns"], a["status"]) == (
        2, ["x (c1)", "y (c2)"], 2, "org__a__b.jsonl", ["a", "z"], "ok")
    assert (got["none"]["status"], got["none"]["error"], got["none"]["file"]) == ("error", "no splits", None)
    listed = G.matched_benchmarks(matches).filter("dataset_id = 'org/a b'").orderBy("pos").collect()
    assert [r["benchmark"] for r in listed] == ["B1", "B2"]


def test_search_queries(spark):
    t = spark.createDataFrame([("A b (c)",)], "benchmark string")
    assert [r["query"] for r in G.search_queries(t).orderBy("query_no").collect()] == ["A b (c)", "A-b-(c)", "A b"]


def test_dataset_clusters_need_a_read_file(spark, built):
    assert built.log.filter(F.col("dataset_id").isin("failed", "gone", "nofile", "unlisted")).count() == 0
