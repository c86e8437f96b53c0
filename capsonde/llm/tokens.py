"""Words and window hashes of whole Arrow text columns, as numpy arrays.

A column's texts lie in one byte buffer. Word borders come from a table of byte classes, and the
hash of any word or run of words from prefix sums, so that no Python code runs per word. Bytes of
0x80 and above always belong to words in the classes used here, so bytes and code points agree.
Hashes have 64 bits: sums of random values times powers of an odd base, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8: differences of its powers keep most bits
SYMBOL = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~WHITESPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, more than n of each; the longest are kept."""
    if not _POWERS or len(_POWERS[0]) <= n:
        kept = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full((1 << max(16, int(n).bit_length())) + 1, base, np.uint64)
            p[0] = 1
            kept.append(np.multiply.accumulate(p, out=p))
        _POWERS[:] = kept
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Running sums of symbol times power; `run_hashes` reads runs out of them."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


@dataclass
class Texts:
    """Texts in one buffer: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    """A string column's bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return Texts(data[first : offsets[-1]], offsets - first)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `limit` bytes of text each; one row at least, rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of several texts: bytes starts[j]:ends[j]; text i has words first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int) -> np.ndarray:
        """Numbers of the words at which a run of n words of one text starts."""
        if n <= 0 or not len(self.starts):
            return np.zeros(0, np.int64)
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(left >= n)


def find_words(texts: Texts, member: np.ndarray) -> Words:
    """Maximal runs of bytes with member[byte]; runs end at the border of a text."""
    inside = member[texts.data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    borders = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    opens[borders] = inside[borders]
    lasts = texts.offsets[1:][np.diff(texts.offsets) > 0] - 1
    closes[lasts] = inside[lasts]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, texts.offsets))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return run_hashes(prefix_sums(SYMBOL[data]), words.starts, words.ends)


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0
