"""Line frequency, spelling variants and hard negatives against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from capsonde.llm import hard_negatives, line_frequency, spelling
from tests.llm import brute


def norm(line):
    return re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def judged(rows):
    """rows of (doc_id, host, text): the measures and the verdict of each, in plain Python."""
    from collections import Counter

    texts = {(h, t or "") for _, h, t in rows}
    per_host = Counter(h for h, _ in texts)
    seen = Counter((h, x) for h, t in texts for x in {norm(x) for x in t.split("\n")} - {""})
    often = {k for k, n in seen.items() if n > 10 and 100 * n > per_host[k[0]]}
    out = []
    for doc_id, host, text in rows:
        text = text or ""
        w = brute.SPACED.findall(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        counts = Counter(grams)
        repeated = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if brute.SPACED.search(x)]
        lost = sum(len(brute.SPACED.findall(x)) for x in lines if (host, norm(x)) in often)
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        out.append((
            doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(repeated), lost, failed, not failed and 100 * lost <= 50 * len(w)))
    return sorted(out, key=repr)


MEASURES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"]


def host_rows(awkward):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    banner = "Seite 12 von  30 | " + line(60)
    rows = [(d, rng.choice(["a", "b", None]), t) for d, t in awkward]
    rows += [(1000 + i, "a", banner.replace("12", str(i)) + "\n" + line(rng.randint(10, 100))) for i in range(30)]
    rows += [(2000 + i, "b", banner + "\n" + line(55)) for i in range(5)]
    rows += [(3000 + i, "c", "one text " + " ".join(words[:70])) for i in range(40)]  # copies are one text
    rows += [(4000, "a", ("x y z " * 3000).strip()), (4001, "a", "\n".join(line(5) for _ in range(20000)))]
    return rows + rows[5:9]


def host_table(spark, rows):
    full = [(d, h, t, "e", 7, "k") for d, h, t in rows]
    return spark.createDataFrame(full, "doc_id long, source string, text string, lang string, lines int, host string").repartition(6)


def test_line_frequency(spark, awkward):
    rows = host_rows(awkward)
    got = line_frequency.judge(host_table(spark, rows)).select(*MEASURES).collect()
    want = judged(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert any(r[6] and not r[8] and not r[7] for r in want) and any(r[6] and r[8] for r in want)


def test_cleaned_texts(spark, awkward):
    rows = host_rows(awkward)
    docs = host_table(spark, rows)
    out = line_frequency.clean(docs)
    assert out.columns == docs.columns
    kept = [r for r in judged(rows) if r[8]]
    got = out.collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in kept)
    texts = {r.doc_id: r.text for r in got}
    assert "Seite" not in texts[next(r[0] for r in kept if r[0] and 1000 <= r[0] < 1030)] and "Seite" in texts[2000]
    assert line_frequency.judge(docs.limit(0)).count() == 0


def test_spelling_variants(spark, awkward):
    rng = random.Random(2)
    base = ["letters", "lettres", "spelling", "naïveté", "straße×", "aaaaaa", "bookkeeper", "Zürcher", "x" * 70]
    text = []
    for w in base:
        text += [w] * rng.randint(30, 60)
        for _ in range(4):
            i = rng.randrange(len(w))
            variant = rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "e" + w[i + 1 :]])
            text += [variant] * rng.choice([4, 5, 6, 7])
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::9])) for i in range(9)] + list(awkward) + [(None, "letters letters"), (7, "q" * 200_000)]
    docs = spark.createDataFrame([(d, t, "mine", 3) for d, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == brute.spelling(rows)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("scheme", [spelling.SAME, (2, 2, 3), (2, 3, 1), spelling.NEXT, (3, 2, 4)])
def test_signatures_meet_within_the_distance(scheme):
    k, n1, n2 = scheme
    rng = np.random.default_rng(0)
    sets = spelling.enumerated(*scheme)
    for _ in range(300):
        apart = set(rng.integers(0, n1 * n2, k).tolist())  # parts in which two vectors differ
        assert any(not apart & set(s) for s in sets)


def mined(rows, n_pos=5, n_neg=3):
    whole = {}
    for vid, v, label in rows:
        if vid is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole[(vid, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), label)] = None
    out = []
    for a, av, al in whole:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v, strict=True)), b, lab) for b, v, lab in whole if len(v) == len(av)]
        for s, b, _ in sorted({x for x in scored if x[2] == al and x[1] != a})[:n_pos]:
            band = sorted({(t, c) for t, c, lab in scored if lab != al and 50 * -s <= 100 * -t <= 95 * -s})[:n_neg]
            out += [(a, b, i + 1, c, -s, -t) for i, (t, c) in enumerate(band)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, dim int, part string, salt string"
NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mine(spark, rows):
    table = spark.createDataFrame([(*r, 1, "p", None) for r in rows], VECTORS).repartition(4)
    return hard_negatives.hard_negatives(table, F.col("vid") % 50 == 0, F.col("label"))


def test_hard_negatives(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 10))
    rows = []
    for i in range(700):
        label = int(rng.choice([0, 0, 0, 1, 2]))
        v = centres[label] + rng.normal(size=10) * 0.6
        rows.append((i, [float(x) for x in v * rng.choice([0.1, 1, 1, 5])], label))
    got = sorted(map(tuple, mine(spark, rows).select(*NEGATIVES).collect()))
    assert got == mined(rows) and got


def test_awkward_hard_negatives(spark):
    rows = [(i, [0.5, 0.25], i % 3) for i in range(120)]  # ties
    rows += [(0, [0.5, 0.25], 0), (200, None, 1), (250, [], 1), (300, [1.0, None], 1), (350, [float("nan"), 1.0], 1), (400, [float("inf"), 1.0], 1),
             (None, [1.0, 1.0], 1), (450, [1.0, 2.0, 3.0], 1), (451, [1.0, 2.0, 2.0], 1), (452, [1.0, 1.0, 2.0], 0), (500, [0.0, 0.0], 1), (501, [0.0, 0.0], 1),
             (550, [-1.0, -1.0], 2), (600, [1.0, 1.0], None), (650, [9.0], 1), (700, [20000.0, 3.5], 4), (701, [20000.0, 3.5], 4), (702, [14000.0, 3.5], 5)]
    got = sorted(map(tuple, mine(spark, rows).select(*NEGATIVES).collect()))
    assert got == mined(rows) and got
    assert mine(spark, rows).limit(0).count() == 0 and mine(spark, [(1, None, 1)]).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    for trial in range(60):
        v = rng.integers(-300, 300, (200, 6)) * rng.choice([1, 1000], (200, 1))
        if trial % 3 == 0:
            v[1:50] = v[0]
        lengths = np.sqrt((v.astype(float) ** 2).sum(1))
        units = v[rng.choice(200, 4)] / np.maximum(lengths[rng.choice(200, 4)], 1)[:, None]
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        angles = hard_negatives.angles_to(v, lengths, units)
        for a in range(0, 200, 40):
            product = lengths[a] * lengths
            low, high = hard_negatives.score_bounds(*hard_negatives.angle_interval(angles[a], angles, angles), product, product)
            scores = v @ v[a]
            assert (low <= scores).all() and (scores <= high).all()


def test_scores_of_any_size():
    q, rows = np.array([1 << 40, 3]), np.array([[1 << 40, 1], [-(1 << 40), 1], [5, 2]])
    assert hard_negatives.integer_scores(q, rows, 2.0**80).tolist() == [hard_negatives.MOST, hard_negatives.LEAST, 5 * (1 << 40) + 6]
