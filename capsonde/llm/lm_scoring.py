"""Masked pseudo-likelihood of documents under a bidirectional window network.

A word is predicted from the words on both sides of it, never from itself. Words are hashed into
codes of two digits; the network predicts the first digit from its hidden layer, and the second
from that and the first digit. It is trained in numpy on all words of all documents, each masked in
one of the rounds: in a round each task goes over its own documents from the shared weights, and
Spark averages the tasks' weights by the words they saw. Within its code a word has its share of the code's words: Spark
counts every distinct word of all documents, and the counts are stored and joined. A document's
score is the sum of its words' conditional log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.llm import tokens as W
from capsonde.llm.storage import stored

DIGITS = 64  # values of a digit; DIGITS**2 codes
HIDDEN = 16
REACH = 2  # words on either side
ROUNDS = 2
BATCH = 256
RATE = 0.5
SEED = 5
BLANK = 0  # code beyond a text's border
PIECE = 1 << 16  # bytes of texts whose words are found together: eight bytes for each stay in cache
LOWER_SYMBOL = W.SYMBOL[W.LOWER]
SLICE = 1 << 10  # words scored together: their logits stay in cache
FREQUENT = 1 << 18  # a word with more than one in so many places is sent to all tasks: fewer words than this
CELLS = np.arange(2 * REACH * DIGITS * DIGITS * HIDDEN).reshape(-1, HIDDEN)  # flat places of a table's rows
UNSEEN = -np.log(2.0**64 / (DIGITS * DIGITS - 1))  # an uncounted word: one count, shared by all hashes of its code


def start_weights() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return {
        "context": rng.normal(0, 0.1, (2 * REACH * DIGITS * DIGITS, HIDDEN)).astype(np.float32),
        "digit": rng.normal(0, 0.1, (DIGITS, HIDDEN)).astype(np.float32),
        "out1": np.zeros((DIGITS, HIDDEN + 1), np.float32),
        "out2": np.zeros((DIGITS, HIDDEN + 1), np.float32),
    }


def own_weights(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A task's copy. Unpickled arrays have a dtype object of their own, with which `ufunc.at` takes
    its general path, many times slower than the one for numpy's own float32."""
    return {n: v.astype(np.float32) for n, v in weights.items()}


def word_codes(hashes: np.ndarray) -> np.ndarray:
    return 1 + (hashes % np.uint64(DIGITS * DIGITS - 1)).astype(np.int64)


def pieces(texts: W.Texts) -> Iterator[W.Texts]:
    """Texts in pieces of about PIECE bytes; a text stays whole."""
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(texts.offsets, texts.offsets[at] + PIECE, "right")) - 1)
        first, last = texts.offsets[at], texts.offsets[to]
        yield W.Texts(texts.data[first:last], texts.offsets[at : to + 1] - first)
        at = to


def codes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word codes with blanks around every text; places, hashes and texts of the words."""
    texts = W.texts_of(column)
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for piece in pieces(texts):
        words = W.find_words(piece, W.NOT_SPACE)
        found.append(W.run_hashes(W.prefix_sums(LOWER_SYMBOL[piece.data]), words.starts, words.ends))
        counts.append(words.counts)
    hashes = np.concatenate(found)
    of = np.repeat(np.arange(len(texts)), np.concatenate(counts))
    codes = np.full(len(hashes) + REACH * (len(texts) + 1), BLANK, np.int64)
    places = np.arange(len(hashes)) + REACH * (of + 1)
    codes[places] = word_codes(hashes)
    return codes, places, hashes, of


def text_keys(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """A hash of the words of each of n texts, in order."""
    first = np.searchsorted(of, np.arange(n + 1))
    return W.run_hashes(W.prefix_sums(hashes), first[:-1], first[1:])


@dataclass
class WordCounts:
    """Words of a corpus: all of them in a stored table, the frequent ones and code totals in memory."""

    table: DataFrame  # word (its hash), n
    totals: np.ndarray  # words of every code
    frequent: np.ndarray  # sorted hashes
    logs: np.ndarray  # logarithms of their counts


def count_words(docs: DataFrame, text: str = "text") -> WordCounts:
    """Counts of every distinct word of all documents.

    The table grows with the vocabulary and stays in the shared folder; the driver gets the totals
    of the codes and fewer than FREQUENT words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            word, n = np.unique(codes_of(batch.column(text))[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIGITS * DIGITS, np.int64)
        for batch in batches:
            np.add.at(total, word_codes(batch["word"].to_numpy().view(np.uint64)), batch["n"].to_numpy())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["code", "n"])

    table = stored(docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    totals = np.zeros(DIGITS * DIGITS, np.int64)
    for r in table.mapInArrow(add, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        totals[r.code] = r.n
    frequent = table.where(F.col("n") > int(totals.sum()) // FREQUENT).toArrow()
    hashes = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return WordCounts(table, totals, hashes[order], np.log(frequent["n"].to_numpy()[order]))


def context_rows(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows of the context table: one row of them for each neighbour and side, a place in a column."""
    side = np.arange(2 * REACH)[:, None]
    return codes[places + (side - REACH + (side >= REACH))] + side * DIGITS * DIGITS


def hidden(w: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    total = w["context"].take(rows, 0).sum(0)
    return np.tanh(total, out=total)


# Logits stand a digit's value in a row, a word in a column: steps over a word's logits are then
# steps over whole rows, many times quicker than over 64 neighbours.


def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the DIGITS rows, eighths first and then pairs, as numpy sums neighbours."""
    total = x.reshape(DIGITS // 8, -1).sum(0).reshape(8, -1)
    while len(total) > 1:
        total = total[::2] + total[1::2]
    return total[0]


def softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of every column; x is overwritten."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= column_sums(x)
    return x


def log_softmax_at(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One row of each column's log-softmax; x is overwritten."""
    x -= x.max(0)
    taken = x[row, np.arange(x.shape[1])]
    return taken - np.log(column_sums(np.exp(x, out=x)))


def with_one(h: np.ndarray) -> np.ndarray:
    """h and a column of ones, which the outputs' last column, their bias, belongs to."""
    out = np.empty((len(h), HIDDEN + 1), np.float32)
    out[:, :-1] = h
    out[:, -1] = 1
    return out


def heads(w: dict[str, np.ndarray], h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits of both digits, and what each of them comes from."""
    h1, h2 = with_one(h), with_one(h + w["digit"].take(first, 0))
    return w["out1"] @ h1.T, w["out2"] @ h2.T, h1, h2


def word_log_probs(w: dict[str, np.ndarray], codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.zeros(len(places))
    for i in range(0, len(places), SLICE):
        at = places[i : i + SLICE]
        first, second = np.divmod(codes[at], DIGITS)
        one, two, _, _ = heads(w, hidden(w, context_rows(codes, at)), first)
        out[i : i + len(at)] = log_softmax_at(one, first).astype(np.float64) + log_softmax_at(two, second)
    return out


def subtract_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """np.subtract.at of the values over whole rows, for each of several lists of rows.

    Flat indices are quicker, above all when they are read from a table.
    """
    at = CELLS.take(rows, 0)
    every = np.empty(at.shape, np.float32)
    every[:] = values
    np.subtract.at(table.reshape(-1), at.reshape(-1), every.reshape(-1))


def lower_at(x: np.ndarray, row: np.ndarray) -> None:
    """Takes 1 from one row of each column."""
    x.reshape(-1)[row * x.shape[1] + np.arange(x.shape[1])] -= 1


def round_of(hashes: np.ndarray, of: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """The round in which each word is masked: by its text's words and its place in the text."""
    place = np.arange(len(hashes)) - np.searchsorted(of, np.arange(n))[of]
    draw = W.mix(text_keys(hashes, of, n)[of] ^ W.mix(place.astype(np.uint64)))
    return (draw % np.uint64(rounds)).astype(np.int64)


def train_batch(w: dict[str, np.ndarray], codes: np.ndarray, at: np.ndarray, rate: float) -> None:
    rows = context_rows(codes, at)
    first, second = np.divmod(codes[at], DIGITS)
    h = hidden(w, rows)
    one, two, h1, h2 = heads(w, h, first)
    g1, g2 = softmax(one), softmax(two)
    lower_at(g1, first)
    lower_at(g2, second)
    step = np.float32(rate / len(at))
    back2 = g2.T @ w["out2"][:, :-1]
    back = (g1.T @ w["out1"][:, :-1] + back2) * (1 - h * h)
    w["out1"] -= step * (h1.T @ g1.T).T
    w["out2"] -= step * (h2.T @ g2.T).T
    subtract_rows(w["digit"], first[None], step * back2)
    # A context word is rare within a batch: its rows take larger steps than the shared outputs.
    subtract_rows(w["context"], rows, step * 8 * back)


def train_round(docs: DataFrame, weights: dict[str, np.ndarray], number: int, rounds: int, text: str) -> dict[str, np.ndarray]:
    """Weights after one round over all documents, averaged over tasks by masked words seen."""
    names = list(weights)
    sizes = [len(weights[n]) for n in names]
    width = HIDDEN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = own_weights(weights)
        seen = 0
        for batch in W.chunks(batches, text):
            codes, places, hashes, of = codes_of(batch.column(text))
            at = places[round_of(hashes, of, batch.num_rows, rounds) == number]
            seen += len(at)
            for i in range(0, len(at), BATCH):
                train_batch(w, codes, at[i : i + BATCH], RATE)
        if not seen:
            return
        # Rows that the task did not move are sent too: an average needs all tasks' rows.
        flat = np.zeros((sum(sizes), width), np.float64)
        at = 0
        for n in names:
            flat[at : at + len(w[n]), : w[n].shape[1]] = w[n]
            at += len(w[n])
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * width), pa.array((flat * seen).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.full(len(flat), seen)), values], ["row", "n", "v"])

    sums = [F.sum(F.col("v")[i]) / F.sum("n") for i in range(width)]
    table = docs.select(text).mapInArrow(run, "row int, n long, v array<double>").groupBy("row").agg(F.array(*sums).alias("v")).toArrow()
    if not table.num_rows:
        return weights
    flat = np.zeros((sum(sizes), width))
    flat[table["row"].to_numpy()] = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    out, at = {}, 0
    for n, size in zip(names, sizes, strict=True):
        out[n] = flat[at : at + size, : weights[n].shape[1]].astype(np.float32)
        at += size
    return out


def train(docs: DataFrame, rounds: int = ROUNDS, text: str = "text") -> dict[str, np.ndarray]:
    """Every word is a target in exactly one of the rounds."""
    weights = start_weights()
    for number in range(rounds):
        weights = train_round(docs, weights, number, rounds, text)
    return weights


def find(hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes among the sorted frequent ones, and which of them stand there."""
    if not len(frequent):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return at, frequent[at] == hashes


def rare_logs(docs: DataFrame, frequent: np.ndarray, counts: DataFrame, text: str) -> DataFrame:
    """(key, s, m): sum of the logarithms of the counts of a text's m other words, over all its rows.

    Only rare words are joined: none has more than one in FREQUENT of all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            _, _, hashes, of = codes_of(batch.column(text))
            keys = text_keys(hashes, of, batch.num_rows)
            rare = ~find(hashes, frequent)[1]
            h, t = hashes[rare], of[rare]
            order = np.lexsort((h, t))
            h, t = h[order], t[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[t[first]].view(np.int64)), pa.array(h[first].view(np.int64)), pa.array(n, pa.int64())], ["key", "word", "k"])

    pairs = docs.select(text).mapInArrow(run, "key long, word long, k long").join(counts, "word", "left")
    log = F.coalesce(F.log("n"), F.lit(float(UNSEEN)))
    return pairs.groupBy("key").agg(F.sum(F.col("k") * log).alias("s"), F.sum("k").alias("m"))


def score(docs: DataFrame, weights: dict[str, np.ndarray], words: WordCounts | None = None, text: str = "text") -> DataFrame:
    """docs with n_words, log_prob (sum over words) and mean_log_prob.

    With `words` a word's probability is that of its code times its share of the code; a word that
    was not counted gets an even part of one count. Without, it is that of the code.
    Null and empty texts have no words, log_prob 0 and a null mean. Repeated rows get equal scores;
    other columns are kept, ones with these names are replaced; an empty table stays empty.
    """
    totals = np.log1p(words.totals) if words else np.zeros(DIGITS * DIGITS)
    frequent, logs = (words.frequent, words.logs) if words else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            codes, places, hashes, of = codes_of(batch.column(text))
            n = np.bincount(of, minlength=batch.num_rows)
            each = word_log_probs(weights, codes, places) - totals[codes[places]]
            rare = np.zeros(batch.num_rows, np.int64)
            if frequent is not None:
                at, known = find(hashes, frequent)
                each[known] += logs[at[known]]
                rare = np.bincount(of[~known], minlength=batch.num_rows)
            values = {"n_words": pa.array(n, pa.int64()), "log_prob": pa.array(np.bincount(of, each, batch.num_rows)),
                      "__key": pa.array(text_keys(hashes, of, batch.num_rows).view(np.int64)), "__rare": pa.array(rare, pa.int64())}
            columns = [values[c] if c in values else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    zero = F.lit(0).cast("long")
    kept = docs.drop("n_words", "log_prob", "mean_log_prob")
    out = kept.select("*", zero.alias("n_words"), F.lit(0.0).alias("log_prob"), zero.alias("__key"), zero.alias("__rare"))
    out = out.mapInArrow(run, out.schema)
    log_prob = F.col("log_prob")
    if words:
        # A text in several rows has its words in the sums once for each: m is a multiple of its own.
        sums = rare_logs(kept, words.frequent, words.table, text).withColumnsRenamed({"key": "__key", "s": "__s", "m": "__m"})
        out = out.join(sums, "__key", "left")
        log_prob += F.when(F.col("__rare") > 0, F.col("__s") * F.col("__rare") / F.col("__m")).otherwise(0.0)
    return out.select(*kept.columns, "n_words", log_prob.alias("log_prob")).withColumn(
        "mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
