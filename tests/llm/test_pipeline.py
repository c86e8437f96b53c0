"""The pipeline's stages: what each takes out, what it leaves, and the columns in between."""

import pytest

import corpus_pipeline as P
from capsonde.llm import sampled_encoding
from capsonde.llm.registry import PIECES
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    yield out
    for df in out[1:]:
        df.unpersist()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "samples"]


def test_quality_stage_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in pairs(stages[1])}
    clean = [d for d, q in labels.items() if q == 1]
    junk = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in clean) > 0.98 * len(clean) and sum(d in kept for d in junk) < 0.1 * len(junk)


def test_one_document_of_each_group_stays(stages):
    expected = sorted(d for d, _, c in brute.jaccard_components(pairs(stages[1])) if c == d)
    assert sorted(d for d, _ in pairs(stages[2])) == expected


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = pairs(stages[2])
    got = {d for d, _ in pairs(stages[3])}
    some = [x for x in before if x[0] not in got] + before[::9]
    expected = {d for d, *_, bad in brute.contamination(some, items) if bad}
    assert expected == {d for d, _ in some} - got
    assert set(pairs(stages[3])) <= set(before)


def test_personal_data_and_pieces(spark, stages):
    assert [d for d, _ in sorted(pairs(stages[4]))] == [d for d, _ in sorted(pairs(stages[3]))]
    texts = dict(pairs(stages[4]))
    changed = [d for d, t in pairs(stages[3]) if t != texts[d]]
    assert changed and not any("@mail" in t and ".example.com" in t for t in texts.values())
    assert all(r.n_chars == len(r.text) for r in stages[4].collect() if r.doc_id in set(changed))
    flat = stages[5].selectExpr("doc_id", "text", "explode(samples) AS s").selectExpr("doc_id", "text", "s.ids AS ids")
    assert flat.count() == 2 * len(texts)
    assert sampled_encoding.decode(flat, PIECES).where("decoded <> text").count() == 0


def test_awkward_documents_pass_through(spark, awkward_docs, no_docs):
    for docs in (awkward_docs, no_docs):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.count()


def test_a_doc_id_on_several_texts_loses_only_copies(spark):
    words = [f"w{i}" for i in range(200)]
    long, near = " ".join(words[:60]), " ".join([*words[:58], "x", "y"])
    other, fourth = " ".join(words[60:120]), " ".join(words[120:180])
    rows = [(1, long), (2, near), (2, other), (3, other + " z"), (4, fourth), (4, fourth + " q"), (4, fourth.upper()), (5, ""), (5, ""), (5, " "),
            (None, long), (None, long), (None, "w1 w2"), (6, "alone"), (6, "alone")]
    docs = spark.createDataFrame([(d, t, 9, "id", 1) for d, t in rows], "doc_id long, text string, helper_0 int, Helper_1 string, class int").repartition(4)
    out = P.drop_near_duplicates(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    four = [t for d, t in got if d == 4]
    assert len(four) == 1 and four[0].lower().startswith(fourth)
    assert [x for x in got if x[0] != 4] == sorted(
        [(1, long), (2, other), (5, ""), (5, " "), (None, long), (None, "w1 w2"), (6, "alone")], key=repr)
