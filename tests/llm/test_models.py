"""The classifier and the language model: held-out accuracy, formulas, awkward rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capsonde.llm import lm_scoring, quality, registry

SF = "/root/testdata/sf0.01"


def test_quality_of_held_out_rows(spark):
    scored = registry.QUERIES["op3_quality_classifier"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc > 0.97 and np.mean((s >= 0.3) == (y == 1)) > 0.95
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_labels_of_held_out_rows_are_never_seen(spark):
    used = registry.training_labels(spark, SF).select("doc_id", registry.held_out().alias("h")).collect()
    assert used and not any(r.h for r in used)


def test_classifier_on_awkward_rows(spark, awkward, awkward_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, None), (None, 1)], "doc_id long, label int")
    scored = quality.classify(awkward_docs, labels)
    rows = scored.collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 for r in rows)
    assert scored.columns == [c for c in awkward_docs.columns if c != "score"] + ["score"]
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(max(s) - min(s) < 1e-6 for s in by_text.values())
    assert quality.classify(no_docs, labels).count() == 0
    none = quality.classify(awkward_docs, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    ones = quality.classify(awkward_docs, labels.where("label = 1")).select("score").distinct().collect()
    assert len(ones) == 1 and ones[0].score > 0.5


def test_temperature_flattens_overconfident_logits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (rng.random(2000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = quality.Network(x, y)
    p = net.probabilities(x)
    assert 0.25 <= net.temperature <= 8 and abs(p.mean() - y.mean()) < 0.05


def test_pooling_is_the_mean_of_word_vectors():
    vectors = quality.index_vectors()
    got = quality.pooled(pa.array(["one two!! TWO two", None, ""]), vectors)
    bucket, first = quality.buckets_of(quality.W.texts_of(pa.array(["one two!! TWO two"])))
    assert np.allclose(got[0, :-1], vectors[bucket].mean(0), atol=1e-6)
    assert len(bucket) == 5 + 1 + 2  # words, signs; a loud word, two that repeat the last one
    assert not got[1:].any()


def test_pseudo_likelihood_is_the_sum_of_conditionals():
    rng = np.random.default_rng(1)
    w = lm_scoring.start_weights()
    w["out1"] += rng.normal(0, 0.3, w["out1"].shape).astype(np.float32)
    w["out2"] += rng.normal(0, 0.3, w["out2"].shape).astype(np.float32)
    codes, places, _, of = lm_scoring.codes_of(pa.array(["a b c a", "b", None, "c c"]))
    got = lm_scoring.word_log_probs(w, codes, places)
    d = lm_scoring.DIGITS
    for i, at in enumerate(places):
        steps = [s for s in range(-lm_scoring.REACH, lm_scoring.REACH + 1) if s]
        h = np.tanh(sum(w["context"][k * d * d + codes[at + s]] for k, s in enumerate(steps)))
        a, b = divmod(int(codes[at]), d)
        h2 = h + w["digit"][a]
        logits = [w["out1"][:, :-1] @ h + w["out1"][:, -1], w["out2"][:, :-1] @ h2 + w["out2"][:, -1]]
        expected = sum(x[j] - np.log(np.exp(x).sum()) for x, j in zip(logits, (a, b)))
        assert got[i] == pytest.approx(expected, abs=1e-4)
    every = np.arange(d * d)  # the conditionals of all codes in one place sum to one
    codes = np.tile(codes[: lm_scoring.REACH * 2 + 1], d * d)
    spots = every * (2 * lm_scoring.REACH + 1) + lm_scoring.REACH
    codes[spots] = every
    assert np.exp(lm_scoring.word_log_probs(w, codes, spots)).sum() == pytest.approx(1, abs=1e-3)


def test_training_step_descends_the_loss():
    rng = np.random.default_rng(2)
    w = lm_scoring.start_weights()
    texts = pa.array([" ".join(rng.choice(["the", "cat", "sat", "mat"], 200)) for _ in range(20)])
    codes, places, _, _ = lm_scoring.codes_of(texts)
    before = lm_scoring.word_log_probs(w, codes, places).mean()
    for i in range(0, len(places), 256):
        lm_scoring.train_batch(w, codes, places[i : i + 256], 0.5)
    assert lm_scoring.word_log_probs(w, codes, places).mean() > before + 1


def test_language_model_on_awkward_rows(spark, awkward, awkward_docs, no_docs):
    scored = lm_scoring.score(awkward_docs, lm_scoring.train(awkward_docs))
    rows = scored.collect()
    assert len(rows) == len(awkward)
    for r in rows:
        n = len((r.text or "").replace("\n", " ").replace("\t", " ").split(" ")) - (r.text or "").replace("\n", " ").replace("\t", " ").split(" ").count("")
        assert r.n_words == n and r.log_prob <= 0 and (r.mean_log_prob is None) == (n == 0)
    assert lm_scoring.score(no_docs, lm_scoring.train(no_docs)).count() == 0


def test_training_learns_from_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    uniform = -np.log(lm_scoring.DIGITS**2)
    mean = lm_scoring.score(docs, lm_scoring.train(docs)).agg(F.sum("log_prob") / F.sum("n_words")).first()[0]
    assert mean > uniform + 0.2


def test_every_word_has_its_share_of_its_code(spark, awkward, awkward_docs, no_docs):
    weights = lm_scoring.start_weights()
    words = lm_scoring.count_words(awkward_docs)
    counted = {r.word: r.n for r in words.table.collect()}
    plain = {r.text: r.log_prob for r in lm_scoring.score(awkward_docs, weights).collect()}
    share, rare = {}, words.frequent[::2]
    for t in {t for _, t in awkward}:
        _, _, hashes, _ = lm_scoring.codes_of(pa.array([t], pa.string()))
        n = np.array([counted[h] for h in hashes.view(np.int64).tolist()])
        share[t] = np.log(n / (words.totals[lm_scoring.word_codes(hashes)] + 1)).sum()
    assert sum(counted.values()) == words.totals.sum()
    # the same scores from frequent words as from joined ones, also where rows repeat
    some = lm_scoring.WordCounts(words.table, words.totals, rare, words.logs[::2])
    for w in (words, some):
        rows = lm_scoring.score(awkward_docs, weights, w).collect()
        assert len(rows) == len(awkward)
        for r in rows:
            assert r.log_prob == pytest.approx(plain[r.text] + share[r.text], rel=1e-9, abs=1e-9)
    assert lm_scoring.score(no_docs, weights, lm_scoring.count_words(no_docs)).count() == 0


def test_rare_word_is_told_from_a_frequent_one_of_its_code(spark):
    hashes = lm_scoring.codes_of(pa.array([" ".join(f"w{i}" for i in range(30000))]))[2]
    codes = lm_scoring.word_codes(hashes)
    same = np.flatnonzero(codes == codes[0])[:3]
    often, once, never = (f"w{i}" for i in same)
    docs = spark.createDataFrame([(0, " ".join([often] * 99)), (1, once)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, often), (1, once), (2, never)], "doc_id long, text string")
    scored = lm_scoring.score(asked, lm_scoring.train(docs), lm_scoring.count_words(docs)).orderBy("doc_id").collect()
    p = [r.log_prob for r in scored]
    assert p[0] - p[1] == pytest.approx(np.log(99)) and p[1] - p[2] == pytest.approx(-lm_scoring.UNSEEN)


def test_every_word_is_a_target_once(awkward):
    texts = [t for _, t in awkward]
    _, _, hashes, of = lm_scoring.codes_of(pa.array(texts))
    whole = lm_scoring.round_of(hashes, of, len(texts), 3)
    assert set(whole) == {0, 1, 2}
    parts = []
    for some in (texts[:7], texts[7:]):  # the draw does not depend on the chunk
        _, _, hashes, of = lm_scoring.codes_of(pa.array(some))
        parts.append(lm_scoring.round_of(hashes, of, len(some), 3))
    assert np.concatenate(parts).tolist() == whole.tolist()


def test_training_beats_the_unigram_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    column = docs.toArrow()["text"].combine_chunks()
    n = np.bincount(lm_scoring.word_codes(lm_scoring.codes_of(column)[2]))
    n = n[n > 0]
    unigram = (n * np.log(n / n.sum())).sum() / n.sum()
    mean = lm_scoring.score(docs, lm_scoring.train(docs)).agg(F.sum("log_prob") / F.sum("n_words")).first()[0]
    assert mean > unigram, (mean, unigram)


def test_a_task_trains_on_the_quick_path_of_ufunc_at():
    import pickle

    sent = pickle.loads(pickle.dumps(lm_scoring.start_weights(), 5))
    own = lm_scoring.own_weights(sent)
    assert all(v.dtype is np.dtype(np.float32) and not np.shares_memory(v, sent[n]) for n, v in own.items())
    codes, at = np.arange(40) % 7, np.arange(5, 30)
    other = {n: v.copy() for n, v in sent.items()}
    for w in (own, other):
        lm_scoring.train_batch(w, codes, at, 0.5)
    assert all(np.array_equal(own[n], other[n]) for n in own)


def plain_step(w, codes, at, rate):
    """A training step with a word's logits in a row, and one flat index for each neighbour."""
    steps = np.array([s for s in range(-lm_scoring.REACH, lm_scoring.REACH + 1) if s])
    rows = codes[at[:, None] + steps] + np.arange(len(steps)) * lm_scoring.DIGITS**2
    h = np.tanh(sum(w["context"][rows[:, k]] for k in range(len(steps))))
    first, second = np.divmod(codes[at], lm_scoring.DIGITS)
    h2 = h + w["digit"][first]
    grads = []
    for out, x, digit in (("out1", h, first), ("out2", h2, second)):
        g = x @ w[out][:, :-1].T + w[out][:, -1]
        g = np.exp(g - g.max(1, keepdims=True))
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(at)), digit] -= 1
        grads.append((g, g @ w[out][:, :-1]))
    step = np.float32(rate / len(at))
    back = (grads[0][1] + grads[1][1]) * (1 - h * h)
    for out, x, (g, _) in (("out1", h, grads[0]), ("out2", h2, grads[1])):
        w[out][:, :-1] -= step * (g.T @ x)
        w[out][:, -1] -= step * g.sum(0)
    moved = [("digit", first, step * grads[1][1]), *(("context", rows[:, k], step * 8 * back) for k in range(len(steps)))]
    for name, r, values in moved:
        np.subtract.at(w[name].reshape(-1), (r[:, None] * lm_scoring.HIDDEN + np.arange(lm_scoring.HIDDEN)).ravel(), values.ravel())


def test_training_step_is_quicker_than_the_plain_one_and_the_same():
    import time

    rng = np.random.default_rng(4)
    codes = rng.zipf(1.3, 256 * 40 + 4) % 4095 + 1
    took, trained = {}, {}
    for step in (plain_step, lm_scoring.train_batch) * 4:
        w = lm_scoring.start_weights()
        began = time.perf_counter()
        for i in range(40):
            step(w, codes, np.arange(2 + 256 * i, 258 + 256 * i), 0.5)
        took[step] = min(took.get(step, 9), time.perf_counter() - began)
        trained[step] = w
    for n, v in trained[plain_step].items():
        np.testing.assert_allclose(trained[lm_scoring.train_batch][n], v, rtol=1e-3, atol=1e-5)
    assert took[lm_scoring.train_batch] < 0.9 * took[plain_step]


def test_hashes_do_not_depend_on_the_piece(monkeypatch):
    texts = pa.array(["a b c", "", None, "d " * 50, "É e", "  ", "a"])
    whole = lm_scoring.codes_of(texts)
    monkeypatch.setattr(lm_scoring, "PIECE", 4)
    assert all(np.array_equal(a, b) for a, b in zip(whole, lm_scoring.codes_of(texts), strict=True))
    assert [len(x) for x in lm_scoring.codes_of(pa.array([], pa.string()))] == [2, 0, 0, 0]
