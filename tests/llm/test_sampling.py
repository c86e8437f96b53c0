"""Sampled segmentations: exact round trips, distinctness, and the distribution of the draw."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from capsonde.llm import lattice as L
from capsonde.llm import sampled_encoding as S
from capsonde.llm import tokens as W
from capsonde.llm.registry import PIECES


@pytest.fixture(scope="module")
def vocabulary():
    return L.load_vocabulary(PIECES)


def flat(df):
    return df.select("doc_id", F.explode("samples").alias("s")).select("doc_id", "s.*")


def test_awkward_texts_come_back(spark, awkward, awkward_docs):
    encoded = S.encode(awkward_docs, PIECES, k=3)
    assert encoded.columns == [*awkward_docs.columns, "samples"]
    back = S.decode(flat(encoded), PIECES).collect()
    texts = Counter((d, t or "") for d, t in awkward)
    got = Counter((r.doc_id, r.decoded) for r in back)
    assert set(got) == set(texts)
    for rows in encoded.select("text", "samples").collect():
        ids = [tuple(s.ids) for s in rows.samples]
        assert len(set(ids)) == len(ids) and 1 <= len(ids) <= 3
        assert rows.text or len(ids) == 1
        assert all(0 <= s.inclusion <= 1 and s.log_prob <= 0 for s in rows.samples)


def test_empty_table(spark, no_docs):
    assert S.encode(no_docs, PIECES).count() == 0


def test_samples_depend_on_key_and_text_only(spark, awkward_docs):
    one, two = (
        {(r.doc_id, r.text): r.samples for r in S.encode(docs, PIECES).select("doc_id", "text", "samples").collect()}
        for docs in (awkward_docs, awkward_docs.repartition(2, "text"))
    )
    assert one.keys() == two.keys()
    for key, samples in one.items():
        assert [s.ids for s in samples] == [s.ids for s in two[key]]
        assert [s.log_prob for s in samples] == pytest.approx([s.log_prob for s in two[key]], abs=1e-6)


def ways(text, vocabulary, smoothing):
    """All segmentations of a short text without odd characters, with their log-probabilities."""
    pieces = {vocabulary.texts[i].decode(): (i, smoothing * p) for i, p in zip(vocabulary.ids.tolist(), vocabulary.log_probs.tolist())}

    def split(word):
        if not word:
            yield (), 0.0
        for n in range(1, len(word) + 1):
            if word[:n] in pieces:
                i, p = pieces[word[:n]]
                for rest, q in split(word[n:]):
                    yield (i, *rest), p + q

    all_ = [((), 0.0)]
    for word in [" " + w for w in text.split(" ")]:
        all_ = [(a + b, p + q) for a, p in all_ for b, q in split(word)]
    total = np.logaddexp.reduce([p for _, p in all_])
    return {ids: p - total for ids, p in all_}


def test_draws_follow_the_distribution(vocabulary):
    text, smoothing, n = "the cat", 0.4, 4000
    expected = ways(text, vocabulary, smoothing)
    seeds = W.mix(np.arange(n, dtype=np.uint64))
    samples = S.encode_chunk([text] * n, seeds, vocabulary, 2, smoothing).to_pylist()
    first = Counter(tuple(s[0]["ids"]) for s in samples)
    second = Counter(tuple(s[1]["ids"]) for s in samples)
    assert set(first) <= set(expected) and all(abs(s[0]["log_prob"] - expected[tuple(s[0]["ids"])]) < 1e-4 for s in samples[:200])
    for ids, log_p in sorted(expected.items(), key=lambda x: -x[1])[:6]:
        p = math.exp(log_p)
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
        # The second draw without replacement: sum over what the first one took.
        q = sum(math.exp(o) * p / (1 - math.exp(o)) for i, o in expected.items() if i != ids)
        assert abs(second[ids] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3
    # Inclusion scores weigh samples: the weighted count of segmentations is their number.
    weights = [sum(math.exp(s["log_prob"]) / s["inclusion"] for s in x) for x in samples]
    assert abs(np.mean(weights) - 1) < 5 * np.std(weights) / math.sqrt(n)


def test_all_ways_of_a_short_text(vocabulary):
    expected = ways("at", vocabulary, 0.5)
    samples = S.encode_chunk(["at"], W.mix(np.array([5], np.uint64)), vocabulary, len(expected) + 3, 0.5).to_pylist()[0]
    assert {tuple(s["ids"]) for s in samples} == set(expected) and len(samples) == len(expected)
    assert all(s["inclusion"] == 1 for s in samples)


def test_a_lattice_holds_edges_only(vocabulary):
    text = " the cat sat on  the mat"
    chars = np.array([ord(c) for c in text])
    starts = np.flatnonzero(chars == L.SPACE)
    ends = np.append(starts[1:], len(chars))
    lat = L.build(chars, W.prefix_sums(L.char_symbols(chars)), starts, ends - starts, vocabulary, 0.5)
    pieces = {vocabulary.texts[i].decode() for i in vocabulary.ids.tolist()}
    words = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    expected = [w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w[i:j] in pieces]
    assert [vocabulary.texts[i].decode() for i in lat.pieces.tolist()] == expected
    assert len(lat.chosen) == len(lat.steps) == len(lat.place) == len(expected)
