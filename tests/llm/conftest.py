import random
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, key string, class int"


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def awkward_rows():
    """Documents with every awkward shape: nulls, empty and long texts, ties, repeats, copies."""
    rng = random.Random(3)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    words += ["Ünï", "naïve", "日本語", "x▁y", "😀", "A-b"]
    base = [sentence(rng, rng.randint(20, 120), words) for _ in range(12)]
    passage = sentence(rng, 60, words)
    texts = [None, "", " \n\t ", "one", "One two three", "one two  three", "a b c d e", "A b c d e"]
    texts += base + base[:4] + [base[0], base[0]]
    for t in base[:6]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    for t in base[6:10]:  # shared passages, also twice in one text
        texts.append(t + "\n" + passage + " " + sentence(rng, 15, words))
        texts.append(passage + "  " + t[:50] + " " + passage)
    texts += ["Und " * 300, "Und " * 80 + "das", "ab" * 150, "ab" * 151 + "c", "a" * 101, "\x00" * 120 + "q", sentence(rng, 9000, words)]
    texts.append(texts[-1][5:])
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows += [rows[10], rows[11], rows[11], (rows[12][0], base[3] + " more"), (None, base[2]), (None, "nobody's own words here"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward():
    return awkward_rows()


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    rows = [(d, t, None, "s", None if t is None else len(t), "mine", 7, "k", 1) for d, t in awkward]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
