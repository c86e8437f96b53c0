"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words fall into hashed buckets; every bucket has a sparse random index vector, and its context
vector is the sum of its neighbours' index vectors over all documents. A document is the mean of
its words' vectors. The network is fitted in numpy on a bounded sample of labelled rows, and its
logits are divided by a temperature fitted on rows held back from it. Marks (runs of symbols, words
in capitals, a word that repeats the last one) are words of their own, so spelling counts too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.llm import tokens as W

BUCKETS = 1024  # hashed words; fixes the size of the model, not of the corpus
MARKS = 256  # buckets kept for marks
DIMS = 64
NONZERO = 8  # entries of an index vector
REACH = 2  # words on either side that are context
FIT_ROWS = 20_000  # labelled rows that the network is fitted on, at most
CALIBRATE_EVERY = 5
HIDDEN = 32
EPOCHS = 60
SEED = 11

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
OTHER = ~LETTERS & ~W.WHITESPACE


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((buckets, dims), np.float32)
    for row in out:
        row[rng.choice(dims, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def buckets_of(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and mark in reading order, and the first one of every text."""
    lower = W.LOWER[texts.data]
    words = W.find_words(texts, LETTERS)
    hashes = W.word_hashes(lower, words)
    word_bucket = (hashes % np.uint64(BUCKETS - MARKS)).astype(np.int64) + MARKS
    capitals = np.concatenate([[0], np.cumsum(UPPER[texts.data])])
    length = words.ends - words.starts
    loud = (capitals[words.ends] - capitals[words.starts] == length) & (length > 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    inner = words.first[:-1][words.first[:-1] < len(same)]
    same[inner] = False
    signs = W.find_words(texts, OTHER)
    sign_bucket = (W.word_hashes(texts.data, signs) % np.uint64(MARKS - 8)).astype(np.int64) + 8
    at = np.concatenate([words.starts, signs.starts, words.starts[loud], words.starts[same]])
    bucket = np.concatenate([word_bucket, sign_bucket, np.zeros(int(loud.sum()), np.int64), np.ones(int(same.sum()), np.int64)])
    order = np.argsort(at, kind="stable")
    return bucket[order], np.searchsorted(at[order], texts.offsets)


def neighbour_counts(bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each bucket stands near each other one, within texts."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.zeros(BUCKETS * BUCKETS, np.int64)
    for step in range(1, REACH + 1):
        near = of[step:] == of[:-step]
        pair = bucket[:-step][near] * BUCKETS + bucket[step:][near]
        total += np.bincount(pair, minlength=BUCKETS * BUCKETS)
    total = total.reshape(BUCKETS, BUCKETS)
    return total + total.T


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Word vectors from all documents: each task adds up its own part, Spark adds the parts.

    Only BUCKETS rows reach the driver, however large the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, BUCKETS), np.int64)
        for batch in W.chunks(batches, text):
            total += neighbour_counts(*buckets_of(W.texts_of(batch.column(text))))
        sums = total @ index_vectors().astype(np.int64)
        seen = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(sums[seen].tolist(), pa.list_(pa.int64()))], ["bucket", "v"]
        )

    sums = F.array(*[F.sum(F.col("v")[i]) for i in range(DIMS)]).alias("v")
    rows = docs.select(text).mapInArrow(run, "bucket int, v array<long>").groupBy("bucket").agg(sums).collect()
    out = np.zeros((BUCKETS, DIMS))
    for r in rows:
        out[r.bucket] = r.v
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-9) + index_vectors() / np.sqrt(NONZERO)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of every text and, last, the logarithm of its number of words; zeros if empty."""
    bucket, first = buckets_of(W.texts_of(column))
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(first) - 1
    counts = np.bincount(of * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float64)
    total = np.diff(first)
    mean = counts @ vectors / np.maximum(total, 1)[:, None]
    return np.concatenate([mean, np.log1p(total)[:, None]], 1)


class Network:
    """tanh hidden layer, one logit, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.shift, self.scale = x.sum(0) / max(len(x), 1), x.std(0) + 1e-6 if len(x) else np.ones(x.shape[1])
        self.w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0
        self.temperature = 1.0
        kept = np.arange(len(x)) % CALIBRATE_EVERY != 0
        if len(np.unique(y[kept])) < 2:  # one label or none: its smoothed rate for every row
            self.w2[:] = 0
            rate = (y.sum() + 1) / (len(y) + 2)
            self.b2 = float(np.log(rate / (1 - rate)))
            return
        self._fit((x[kept] - self.shift) / self.scale, y[kept], rng)
        held = ~kept
        if len(np.unique(y[held])) == 2:
            self._calibrate(self.logits(x[held]), y[held])

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                a = np.tanh(x[at] @ params[0] + params[1])
                error = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30))) - y[at]) / len(at)
                back = error[:, None] * params[2] * (1 - a * a)
                grads = [x[at].T @ back + 1e-4 * params[0], back.sum(0), a.T @ error, error.sum(keepdims=True)]
                step += 1
                for p, g, mi, vi in zip(params, grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    p -= 0.003 * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
        self.b2 = float(params[3][0])

    def _calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        candidates = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        losses = [np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean() for t in candidates]
        self.temperature = float(candidates[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labelled: DataFrame, vectors: np.ndarray, rows: int = FIT_ROWS, text: str = "text") -> Network:
    """Network fitted on at most `rows` rows of labelled (doc_id, label), the first by hash."""
    chosen = labelled.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(
        F.max("label").alias("label")
    ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            x = pooled(batch.column(text), vectors)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"]
            )

    # rows ids at most: a table of known size
    sample = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select(
        F.col("doc_id").cast("long"), F.col("label").cast("int"), text
    ).mapInArrow(run, "doc_id long, label int, x array<double>")
    table = sample.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    if not table.num_rows:
        return Network(np.zeros((0, DIMS + 1)), np.zeros(0))
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).astype(np.float64)
    return Network(x, table["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, name: str = "score", text: str = "text") -> DataFrame:
    """docs with a column `name`: the calibrated probability of label 1.

    It depends on the text alone. Null is scored as the empty text, which has the pooled vector
    zero; repeated rows get equal scores, to nine places; a column of that name is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            p = network.probabilities(pooled(batch.column(text), vectors)).round(9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], schema=batch.schema)

    out = docs.drop(name).withColumn(name, F.lit(0.0))
    return out.mapInArrow(run, out.schema)


def classify(docs: DataFrame, labelled: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """docs with `score`, learned from labelled (doc_id, label); without any labels 0.5 for all."""
    vectors = context_vectors(docs)
    return score(docs, vectors, fit(docs, labelled, vectors, rows))
