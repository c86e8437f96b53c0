"""Spelling variants by PartEnum signatures over letter multisets.

A word's letter multiset is a vector of bits: bit (c, j) is set if letter c occurs more than j
times. One changed letter moves two bits, one more or fewer moves one, so near words are at a
Hamming distance of exactly two at equal length and of one otherwise. The bits are cut into n1 x n2
parts; two vectors within k agree on all but ceil((k + 1) / n1) - 1 of the n2 parts of some first
part, so each word enumerates the parts that may agree and hashes them to exact signatures. Equal
signatures are joined and the spellings verified. As one edit leaves the first or the last half of
the shorter spelling alone, that half splits a signature's group: a frequent letter pattern does not
bring all its words together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.llm.storage import stored
from capsonde.llm.tokens import BASE, mix

# Fixed values of the contract.
RUN = r"[A-Za-zÀ-ÿ]{%d,}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MISSPELT_EVERY = 199
MIN_LENGTH = 6
MIN_COUNT = 5
TIMES = 5

# (k, n1, n2) for words of one length, and for words whose lengths differ by one.
SAME = (2, 1, 5)
NEXT = (1, 1, 3)
CHARS = 1 << 20  # of the words hashed at once


def observed_words(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) of every run of at least min_length letters, one of MISSPELT_EVERY with a letter left out.

    Null and empty texts have no words; a null id is written as `null`. Repeated rows count each.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"),
        F.explode(F.regexp_extract_all(text_col, F.lit(RUN % min_length), F.lit(0))).alias("_run"))
    # translate() looks up every letter, and most runs need none of it.
    small = F.when(F.lower("_run") == F.col("_run"), F.col("_run")).otherwise(F.translate("_run", UPPER, LOWER))
    hashed = runs.select("_id", small.alias("_run")).select("_run", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")).alias("_h"))
    at = F.pmod("_h", F.char_length("_run").cast("long")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    word = F.when(F.col("_h") % MISSPELT_EVERY == 0, shorter).otherwise(F.col("_run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= min_length)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least min_count times; counted map-side first."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def part_hashes(letters: np.ndarray, word: np.ndarray, n_words: int, parts: int) -> np.ndarray:
    """Hash of each word's bits in each part: the sum of its bits' random values. Bit (c, j) is in
    part (c + j) modulo parts, so the copies of one letter go to different parts."""
    order = np.lexsort((letters, word))
    letters, word = letters[order], word[order]
    at = np.arange(len(letters))
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
    j = at - np.maximum.accumulate(np.where(new, at, 0))
    value = mix((letters.astype(np.uint64) << np.uint64(32)) + j.astype(np.uint64) + np.uint64(1))
    out = np.zeros((n_words, parts), np.uint64)
    np.add.at(out, (word, (letters.astype(np.int64) + j) % parts), value)
    return out


def enumerated(k: int, n1: int, n2: int) -> list[list[int]]:
    """The sets of parts, of n1 * n2, that are hashed together to a signature for distance k."""
    apart = -(-(k + 1) // n1) - 1
    if not 0 <= apart < n2:
        raise ValueError(f"{n2} parts cannot bring together vectors {k} apart")
    return [[first * n2 + i for i in some] for first in range(n1) for some in combinations(range(n2), n2 - apart)]


def half_hashes(words: list[str], shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and the last half of each spelling, halves of a word of the given length."""
    def hashed(parts: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum([len(p) for p in parts])
        place = np.arange(len(codes)) - np.repeat(ends - [len(p) for p in parts], [len(p) for p in parts])
        sums = np.zeros(len(parts), np.uint64)
        np.add.at(sums, np.repeat(np.arange(len(parts)), [len(p) for p in parts]), mix((codes << np.uint64(32)) + place.astype(np.uint64)))
        return mix(sums)

    first = [w[: n // 2] for w, n in zip(words, shorter.tolist(), strict=True)]
    last = [w[len(w) - (n - n // 2) :] for w, n in zip(words, shorter.tolist(), strict=True)]
    return hashed(first), hashed(last)


def word_keys(words: list[str], same: tuple[int, int, int] = SAME, following: tuple[int, int, int] = NEXT) -> np.ndarray:
    """Keys of each word, one column per signature and half: words within reach share one at least."""
    length = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), length)
    columns = []
    # Words of one length, then those one longer, then those one shorter: `shorter` names the pair.
    for number, (scheme, shorter) in enumerate(((same, length), (following, length), (following, length - 1))):
        hashes = part_hashes(letters, word, len(words), scheme[1] * scheme[2])
        halves = half_hashes(words, shorter)
        kind = shorter.astype(np.uint64) * np.uint64(4) + np.uint64(0 if number == 0 else 1)
        for subset_no, parts in enumerate(enumerated(*scheme)):
            signature = mix(hashes[:, parts].sum(axis=1, dtype=np.uint64) + kind * np.uint64(BASE) + np.uint64(subset_no))
            for half_no, half in enumerate(halves):
                columns.append(mix(signature + half * np.uint64(2 * half_no + 1)))
    return np.column_stack(columns).view(np.int64)


def signatures(words: DataFrame) -> DataFrame:
    """(key, word, n), one row per word and key."""

    def pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
        listed = column.to_pylist()
        start, size = 0, 0
        for i, w in enumerate(listed):
            if i > start and size + len(w) > CHARS:
                yield start, listed[start:i]
                start, size = i, 0
            size += len(w)
        if listed[start:]:
            yield start, listed[start:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in pieces(batch["word"]):
                keys = word_keys(some)
                part = batch.slice(start, len(some))
                for column in keys.T:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(column)), part["word"], part["n"]], ["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words exactly one inserted, deleted or replaced letter apart."""
    keyed = signatures(words)
    # The keys' number is not in the optimizer's estimate, so the join's kind is named.
    a = keyed.hint("merge")
    b = keyed.select(F.col("key").alias("key_b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    verified = (
        (F.col("key") == F.col("key_b")) & (F.col("word") < F.col("near"))
        & (F.abs(F.char_length("word") - F.char_length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1))
    pairs = a.join(b, verified).select("word", "n", "near", "near_n").distinct()
    both = F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return stored(pairs, "near-words").select(F.inline(both))


def with_forms(words: DataFrame, near: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, if at least `times` the word's own."""
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.m") >= times * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds `root`, the last word of a word's chain of forms, itself without a form.

    Counts grow along a chain by a factor, so it ends; each round doubles the steps taken. A word
    has at most as many near words as its letters can be edited to, so no key of the join is hot.
    """
    steps = stored(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(steps.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return forms.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every frequent word of the whole texts.

    Near words of equal count rank by code points. No documents, or only short and rare words, give
    no rows. Other columns of `docs` are not looked at. A word of any length is kept whole.
    """
    words = stored(vocabulary(observed_words(docs, min_length, id_col, text_col), min_count), "vocabulary")
    forms = stored(with_forms(words, near_words(words), times), "word-forms")
    return with_roots(forms)
