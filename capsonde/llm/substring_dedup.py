"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks by content (see `seeds`): everything that can
match a stretch of a document stands in the block that the stretch is sent to. A block is indexed
by the first place of every window; a stretch is factored greedily, each factor as long as it
agrees with an earlier document of the block. Factors shorter than a window are literals. At a
factor's end parsing goes on with the windows across the border, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.llm import tokens as W
from capsonde.llm.seeds import Windows, content_hashes, with_duplicate_spans, word_units

WINDOW = 13
GRAM = 4
WORD = "[^\\x20\\x09-\\x0D]+"


def parse_block(size: int):
    def parse(key: np.ndarray, doc: np.ndarray, start: np.ndarray, content: pa.Array) -> tuple[np.ndarray, ...]:
        data, offsets, _ = content_hashes(content)
        symbols, first = data.view(np.uint64), offsets // 8  # window hashes, and each segment's first
        n = np.diff(first)
        segment = np.repeat(np.arange(len(n)), n)
        place = start[segment] + np.arange(len(symbols)) - first[segment]
        # Index of the reference block: the first place of every window.
        order = np.lexsort((place, doc[segment], symbols))
        new = np.ones(len(order), bool)
        new[1:] = symbols[order][1:] != symbols[order][:-1]
        source = np.empty(len(order), np.int64)
        source[order] = order[new][np.cumsum(new) - 1] if len(order) else order
        matched = doc[segment[source]] < doc[segment]
        # One factor of every segment at a time.
        ends = first[1:]
        found = np.flatnonzero(matched)
        rows, begins, stops = [], [], []
        active, at = np.arange(len(n)), first[:-1].copy()
        while len(active):
            nearest = np.searchsorted(found, at)
            here = nearest < len(found)
            active, at = active[here], found[nearest[here]]
            inside = at < ends[active]
            active, at = active[inside], at[inside]
            if not len(active):
                break
            length = np.ones(len(active), np.int64)
            growing = np.arange(len(active))
            while len(growing):
                mine, its = at[growing] + length[growing], source[at[growing]] + length[growing]
                ok = (mine < ends[active[growing]]) & (its < ends[segment[source[at[growing]]]])
                growing, mine, its = growing[ok], mine[ok], its[ok]
                growing = growing[symbols[mine] == symbols[its]]
                length[growing] += 1
            rows.append(active)
            begins.append(place[at])
            stops.append(place[at] + length + size - 1)
            at = at + length
        if not rows:
            z = np.zeros(0, np.int64)
            return z, z, z
        return np.concatenate(rows), np.concatenate(begins), np.concatenate(stops)

    return parse


def duplicate_words(docs: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with dup_spans: merged runs of words that earlier documents also have.

    A word is in a span when a window of `size` consecutive words covers it whose word sequence
    also starts in a document with a smaller doc_id. Null and empty texts have no words. Rows that
    share a doc_id don't count against each other; a null doc_id is larger than every other. An
    empty table stays empty; other columns are kept, one called dup_spans is replaced.
    """
    windows = Windows(size, GRAM, word_units, False, lambda t: F.regexp_count(t, F.lit(WORD)))
    return with_duplicate_spans(docs, windows, parse_block(size), text)


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `duplicate_words` with n_words, n_removed and kept: the other words, one space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            texts = W.texts_of(batch.column(text))
            words = W.find_words(texts, W.NOT_SPACE)
            first, lists = words.first, batch.column("dup_spans")
            inner = lists.flatten()
            of = np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
            gone = W.cover(len(words.starts), first[of] + inner.field("start").to_numpy(), first[of] + inner.field("end").to_numpy())
            # Of a kept word its bytes and the one after it, a space by now; at a text's end there is none.
            starts, ends, borders = words.starts[~gone], words.ends[~gone], texts.offsets
            inner_end = ends < borders[np.searchsorted(borders, ends - 1, "right")]
            data = texts.data.copy()
            data[ends[inner_end]] = 32
            mask = W.cover(len(data), starts, ends + inner_end)
            kept = [data[a:b][mask[a:b]].tobytes().rstrip(b" ") for a, b in zip(borders[:-1], borders[1:], strict=True)]
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            values = {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                      "kept": pa.array(kept, pa.binary()).cast(pa.string())}
            columns = [values[n] if n in values else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = found.drop("n_words", "n_removed", "kept").select(
        "*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"))
    return out.mapInArrow(run, out.schema)
