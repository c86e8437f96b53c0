"""Repeated byte strings from the interval tree of an enhanced suffix array.

Everything that can repeat meets in one block (see `seeds`). A block's suffixes are grouped by
their first `size` bytes, suffixes that stand alone are dropped, and the others are sorted by what
follows; the lengths of common prefixes of neighbours then make a forest of intervals, which a
stack scans from the deepest up. An interval whose occurrences differ in the byte before them, or
have none, is a maximal repeat: all its occurrences but the earliest are duplicate spans. Others
are left to the longer repeat that starts a byte earlier.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.llm import tokens as W
from capsonde.llm.seeds import Windows, byte_units, content_hashes, with_duplicate_spans

SIZE = 100
GRAM = 32
DEPTH = 72  # bytes beyond `size` that are told apart, a multiple of 8; longer repeats overlap in steps


def following_word(data: np.ndarray, at: np.ndarray, left: np.ndarray, skip: int) -> np.ndarray:
    """Eight bytes from `skip` bytes after each place, as a big-endian number; zeros after a segment's end."""
    word = np.zeros(len(at), np.uint64)
    for i in range(skip, skip + 8):
        byte = data[np.minimum(at + i, len(data) - 1)]
        word = (word << np.uint64(8)) | np.where(i < left, byte, 0).astype(np.uint64)
    return word


def enhanced_suffix_array(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share `size` bytes with another, in groups and sorted inside; and the length of
    the prefix that each shares with the one before it (0: another group; at most size + DEPTH)."""
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - size + 1, 0)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - offsets[:-1], counts)
    left = np.repeat(offsets[1:], counts) - at
    sums = W.prefix_sums(W.SYMBOL[data])
    head = W.run_hashes(sums, at, at + size)
    order = np.argsort(head)
    head = head[order]
    same = head[1:] == head[:-1]
    many = np.zeros(len(head), bool)
    many[1:] |= same
    many[:-1] |= same
    at, left, head = at[order][many], left[order][many], head[many]
    # From the last word to the first, and stably: one word is held at a time.
    for i in range(DEPTH - 8, -1, -8):
        order = np.argsort(following_word(data, at, left, size + i), kind="stable")
        at, left, head = at[order], left[order], head[order]
    order = np.argsort(head, kind="stable")
    at, left, head = at[order], left[order], head[order]
    common = np.zeros(len(at), np.int64)
    if len(at) > 1:
        deep = np.full(len(at) - 1, DEPTH, np.int64)
        for i in range(DEPTH // 8 - 1, -1, -1):
            word = following_word(data, at, left, size + 8 * i)
            differ = word[1:] ^ word[:-1]
            equal_bytes = sum((differ < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
            deep = np.where(differ != 0, 8 * i + equal_bytes, deep)
        common[1:] = np.where(head[1:] == head[:-1], np.minimum(np.minimum(left[1:], left[:-1]), size + deep), 0)
    return at, common


def maximal_repeats(
    common: np.ndarray, before: np.ndarray, when: np.ndarray, cap: int,
) -> Iterator[tuple[int, int, list[int], int]]:
    """(length, earliest, later occurrences, how many in all) of every maximal repeat, deepest first.

    `before` is the symbol in front of a suffix, unlike every other where there is none; `when`
    orders places. Occurrences that a deeper repeat has named as later are not named again.
    """
    # Views, not lists: an element takes 8 bytes instead of 40.
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]).data
    lcp, when = np.append(common[1:], 0).data, np.ascontiguousarray(when).data
    stack: list = []  # length, first suffix, occurrences not yet named
    for i, shared in enumerate(lcp):
        first, open_ = i, [i]
        while stack and stack[-1][0] > shared:
            length, left, waiting = stack.pop()
            waiting.extend(open_)
            first, open_ = left, waiting
            if changes[i] > changes[left] or length >= cap:
                earliest = min(when[x] for x in waiting)
                later = [x for x in waiting if when[x] > earliest]
                open_ = [x for x in waiting if when[x] == earliest]
                if later:
                    yield length, open_[0], later, i - left + 1
        if shared and stack and stack[-1][0] == shared:
            stack[-1][2].extend(open_)
        elif shared:
            stack.append([shared, first, open_])


def parse_block(size: int):
    def parse(key: np.ndarray, doc: np.ndarray, start: np.ndarray, content: pa.Array) -> tuple[np.ndarray, ...]:
        data, offsets, _ = content_hashes(content)
        at, common = enhanced_suffix_array(data, offsets, size)
        segment = np.searchsorted(offsets, at, "right") - 1
        place = start[segment] + at - offsets[segment]
        inner = at > offsets[segment]
        before = np.where(inner, data[at - 1].astype(np.int64), 256 + np.arange(len(at)))
        # Rank of a place: equal places (rows that repeat) have equal ranks.
        order = np.lexsort((place, doc[segment]))
        d, p = doc[segment][order], place[order]
        when = np.empty(len(at), np.int64)
        when[order] = np.concatenate([[0], np.cumsum((d[1:] != d[:-1]) | (p[1:] != p[:-1]))]) if len(at) else 0
        rows, lengths = array("q"), array("q")
        for length, _, later, _ in maximal_repeats(common, before, when, size + DEPTH):
            rows.extend(later)
            lengths.extend(repeat(length, len(later)))
        rows, lengths = np.array(rows, np.int64), np.array(lengths, np.int64)
        return segment[rows], place[rows], place[rows] + lengths

    return parse


def duplicate_bytes(docs: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """docs with dup_spans: runs of UTF-8 bytes (start, end) that also start earlier, not yet merged.

    A byte is in a span when a string of `size` bytes covers it which also starts in a document
    with a smaller doc_id, or earlier in its own. Null is the empty text, which has no spans. Rows
    that share a doc_id count as one document's texts: equal places don't count against each
    other. A null doc_id is larger than every other. An empty table stays empty; other columns are
    kept, one called dup_spans is replaced.
    """
    windows = Windows(size, min(GRAM, size), byte_units, True, F.octet_length)
    return with_duplicate_spans(docs, windows, parse_block(size), text)


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `duplicate_bytes` with n_bytes, n_removed, n_spans (merged) and kept, the other bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            texts = W.texts_of(batch.column(text))
            lists, borders = batch.column("dup_spans"), texts.offsets
            inner = lists.flatten()
            of = np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
            gone = W.cover(len(texts.data), borders[of] + inner.field("start").to_numpy(), borders[of] + inner.field("end").to_numpy())
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            some = borders[:-1][np.diff(borders) > 0]
            begins[some] = gone[some]
            total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[borders])
            kept = [texts.data[a:b][~gone[a:b]].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]
            values = {"n_bytes": pa.array(np.diff(borders), pa.int64()), "n_removed": pa.array(total(gone), pa.int64()),
                      "n_spans": pa.array(total(begins), pa.int64()), "kept": pa.array(kept, pa.binary())}
            columns = [values[n] if n in values else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    zero = F.lit(0).cast("long")
    out = found.drop("n_bytes", "n_removed", "n_spans", "kept").select(
        "*", zero.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.lit("").cast("binary").alias("kept"))
    return out.mapInArrow(run, out.schema)
