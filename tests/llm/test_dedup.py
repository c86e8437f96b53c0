"""Operators that look for repeats, on awkward rows, against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from capsonde.llm import components, decontamination, jaccard_join, repeat_dedup, substring_dedup
from tests.llm import brute

EXTRA = ["lang", "source", "n_chars", "score", "spans", "key", "class"]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_jaccard_components(awkward, awkward_docs):
    got = jaccard_join.similarity_components(awkward_docs)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute.jaccard_components(awkward)


def test_jaccard_other_threshold(awkward, awkward_docs):
    got = jaccard_join.similarity_components(awkward_docs, shingle=2, percent=50)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute.jaccard_components(awkward, 50, 2)


def test_jaccard_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(130)]
    rows = [(100 - i, " ".join(words[i : i + 100])) for i in range(0, 24, 3)]
    got = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute.jaccard_components(rows)
    assert len({r.component_id for r in got.collect()}) == 1


def test_words_seen_before(awkward, awkward_docs):
    found = substring_dedup.without_spans(substring_dedup.duplicate_words(awkward_docs))
    got = found.withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "sha") == brute.dedup_words(awkward)
    assert [c for c in found.columns if c in EXTRA] == EXTRA


def test_bytes_seen_before(awkward, awkward_docs):
    found = repeat_dedup.without_spans(repeat_dedup.duplicate_bytes(awkward_docs))
    got = found.withColumn("sha", F.sha2("kept", 256))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == brute.dedup_bytes(awkward)
    assert [c for c in found.columns if c in EXTRA] == EXTRA


def test_short_repeats_deep_in_the_interval_tree(spark):
    rows = [(1, "abcabcabcabd" * 9), (2, "abcabd" * 30), (3, "xxabcabcabdyy" * 4), (4, "abcab"), (5, "zz" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (5, 8, 20):
        found = repeat_dedup.without_spans(repeat_dedup.duplicate_bytes(docs, size)).withColumn("sha", F.sha2("kept", 256))
        assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == brute.dedup_bytes(rows, size)


def items(awkward):
    long = [t for _, t in awkward if t and len(t) > 200]
    return [(3, " ".join(long[0].split()[4:30])), (20, long[1][:120]), (5, "one"), (6, None), (7, ""), (8, "!!"), (9, "three"),
            (10, long[2].upper()), (10, "Two Three"), (None, "changed")]


def test_contamination(spark, awkward, awkward_docs):
    bench = spark.createDataFrame(items(awkward), "item_id long, text string")
    expected = brute.contamination(awkward, [("" if i is None else i, t) for i, t in items(awkward)])
    for block in (1 << 20, 30):  # one block of items, and several
        found = decontamination.find_contamination(awkward_docs, bench, block_words=block)
        got = found.select("doc_id", "n_words", decontamination.n_hit(), F.size("hit_items"),
                           F.sha2(F.array_join("hit_items", ",").cast("binary"), 256), decontamination.contaminated())
        assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert [c for c in found.columns if c in EXTRA] == EXTRA


def test_hits_cut_out(spark):
    docs = spark.createDataFrame([(1, "Start, THE secret answer is here. End"), (2, "nothing"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the secret answer is here")], "item_id long, text string")
    cut = decontamination.cut_hits(decontamination.find_contamination(docs, bench))
    assert rows_of(cut, "doc_id", "text") == [(1, "Start, . End"), (2, "nothing"), (3, None)]


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.similarity_components(no_docs).count() == 0
    assert substring_dedup.without_spans(substring_dedup.duplicate_words(no_docs)).count() == 0
    assert repeat_dedup.without_spans(repeat_dedup.duplicate_bytes(no_docs)).count() == 0
    assert decontamination.find_contamination(no_docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontamination.find_contamination(one, bench).first().n_words == 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {200 + i: 200 for i in range(50)} | {300: 300, 301: 300}


def test_a_large_group_takes_little_memory():
    text = np.random.default_rng(3).integers(97, 123, 100_000).astype(np.uint8).tobytes()
    doc, zero = np.arange(3), np.zeros(3, np.int64)
    tracemalloc.start()
    row, start, end = repeat_dedup.parse_block(100)(zero, doc, zero, pa.array([text] * 3, pa.binary()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 170 * 3 * len(text)
    for d in (1, 2):
        gone = np.zeros(len(text), bool)
        for a, b in zip(start[row == d], end[row == d], strict=True):
            gone[a:b] = True
        assert gone.all()
    assert not (row == 0).any()
