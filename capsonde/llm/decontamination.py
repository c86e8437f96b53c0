"""Benchmark decontamination: an FM-index per training shard, searched for the test phrases.

Each task gathers its documents into shards of bounded size, indexes a shard's words, runs all
phrases of a block of benchmark items backwards through the index at once, and locates the hits.
A word that no phrase holds cannot lie in an occurrence, so it becomes a break of the shard's
text, as do runs of phrase words too short for the shortest phrase; the index stays small and
loses no occurrence. Documents are read once for each block of items and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsonde.llm import tokens as W
from capsonde.llm.fm_index import FmIndex

WINDOW = 13
SHARD_BYTES = 2 << 20  # of document text in one index
BLOCK_WORDS = 1 << 20  # of benchmark text searched in one pass: bounds what each task is sent
SHARE = 20  # contaminated: at least one word in SHARE is hit

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ADDED = T.StructType([
    T.StructField("hit_spans", SPAN),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("n_words", T.LongType()),
])


@dataclass
class Phrases:
    """Distinct phrases of a block of items, by length; owners are the items of each phrase."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 1
    by_length: list[tuple[np.ndarray, list[np.ndarray]]]
    items: list[str]

    @property
    def shortest(self) -> int:
        return min((p.shape[1] for p, _ in self.by_length), default=0)


def lowered(column: pa.Array) -> tuple[W.Texts, W.Words, np.ndarray]:
    texts = W.texts_of(column)
    texts = W.Texts(W.LOWER[texts.data], texts.offsets)
    words = W.find_words(texts, W.ALNUM)
    return texts, words, W.word_hashes(texts.data, words)


def phrases_of(items: list[tuple[str, str]], window: int) -> Phrases:
    column = pa.array([t for _, t in items], pa.large_string())
    _, words, hashes = lowered(column)
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    symbols = symbols + 1
    by_length: dict[int, tuple[list, list]] = {}
    for item, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        n = min(window, b - a)
        if n:
            runs = np.lib.stride_tricks.sliding_window_view(symbols[a:b], n)
            rows, owners = by_length.setdefault(n, ([], []))
            rows.append(runs)
            owners.append(np.full(len(runs), item))
    out = []
    for rows, owners in by_length.values():
        distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        owner = np.concatenate(owners)
        order = np.argsort(which.ravel(), kind="stable")
        cuts = np.cumsum(np.bincount(which.ravel(), minlength=len(distinct)))[:-1]
        out.append((distinct, [np.unique(x) for x in np.split(owner[order], cuts)]))
    return Phrases(vocabulary, out, [i for i, _ in items])


def shard_symbols(hashes: np.ndarray, words: W.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """The shard's text for the index, and the word number behind each of its places."""
    vocabulary = phrases.vocabulary
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    symbols = np.where(vocabulary[at] == hashes, at + 1, 0)
    # Runs of known words within one text, long enough for the shortest phrase.
    opens = symbols > 0
    breaks = np.ones(len(symbols) + 1, bool)
    breaks[1:-1] = False
    breaks[words.first] = True
    starts = np.flatnonzero(opens & (breaks[:-1] | ~np.concatenate([[False], opens[:-1]])))
    ends = np.flatnonzero(opens & (breaks[1:] | ~np.concatenate([opens[1:], [False]]))) + 1
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    lengths = ends - starts + 1  # one break after each run
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    source = np.arange(total) - np.repeat(firsts - starts, lengths)
    text = symbols[np.minimum(source, len(symbols) - 1)] if total else np.zeros(0, np.int64)
    text[np.cumsum(lengths) - 1] = 0
    return text, source


def search_shard(column: pa.Array, phrases: Phrases) -> tuple[list, list, np.ndarray, W.Words]:
    """Per text: merged hit spans (word numbers) and the items with occurrences."""
    _, words, hashes = lowered(column)
    n_texts = len(words.first) - 1
    spans: list = [[] for _ in range(n_texts)]
    items: list = [set() for _ in range(n_texts)]
    if not phrases.by_length or not len(hashes):
        return spans, items, words.counts, words
    text, source = shard_symbols(hashes, words, phrases)
    if not len(text):
        return spans, items, words.counts, words
    index = FmIndex(text, len(phrases.vocabulary) + 1)
    hit = np.zeros(len(hashes), bool)
    for table, owners in phrases.by_length:
        lo, hi = index.search(table)
        counts = hi - lo
        found = np.flatnonzero(counts)
        counts = counts[found]
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - lo[found], counts)
        at = source[index.locate(rows)]
        phrase = np.repeat(found, counts)
        hit |= W.cover(len(hit), at, at + table.shape[1])
        of = np.searchsorted(words.first, at, "right") - 1
        for t, p in np.unique(np.stack([of, phrase], 1), axis=0):
            items[t].update(owners[p].tolist())
    touched = np.unique(np.searchsorted(words.first, np.flatnonzero(hit), "right") - 1)
    for t in touched:
        starts, ends = W.spans_of(hit[words.first[t] : words.first[t + 1]])
        spans[t] = list(zip(starts.tolist(), ends.tolist(), strict=True))
    return spans, [[phrases.items[i] for i in x] for x in items], words.counts, words


def merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded text, one partition at a time on the driver."""
    block: list = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        block.append(("" if r.i is None else r.i, r.t))
        size += len(r.t) // 2 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
    block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """docs with hit_spans (word numbers, merged), hit_items (sorted strings) and n_words.

    Columns of docs stay as they are; one that has an added column's name is replaced. Null and
    empty texts have no words and no hits; null or empty benchmark texts have no phrases; repeated
    rows get the same answer each; an empty benchmark hits nothing. Item ids are compared as
    strings, a null one as the empty string.
    """
    out = docs.drop(*ADDED.names).select(
        "*", F.array().cast(SPAN).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"),
        F.lit(0).cast("long").alias("n_words"),
    )
    blocks = list(item_blocks(benchmark, block_words)) or [[]]
    for block in blocks:
        out = out.mapInArrow(searcher(phrases_of(block, window), text, shard_bytes), out.schema)
    return out


def searcher(phrases: Phrases, text: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text, shard_bytes):
            spans, items, n_words, _ = search_shard(batch.column(text), phrases)
            before = batch.column("hit_spans").to_pylist()
            items_before = batch.column("hit_items").to_pylist()
            spans = [merged([(x["start"], x["end"]) for x in b] + s) if s else [(x["start"], x["end"]) for x in b]
                     for b, s in zip(before, spans, strict=True)]
            values = {
                "hit_spans": [[{"start": a, "end": b} for a, b in s] for s in spans],
                "hit_items": [sorted({*b, *i}) for b, i in zip(items_before, items, strict=True)],
                "n_words": n_words.tolist(),
            }
            columns = [
                pa.array(values[f.name], f.type) if f.name in values else batch.column(f.name)
                for f in batch.schema
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def n_hit() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(share: int = SHARE) -> F.Column:
    return (n_hit() > 0) & (share * n_hit() >= F.col("n_words"))


def cut_hits(found: DataFrame, text: str = "text") -> DataFrame:
    """find_contamination's rows with the hit words, and what stands between them, cut out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            _, words, _ = lowered(batch.column(text))
            originals = batch.column(text).cast(pa.large_binary()).to_pylist()
            offsets = W.texts_of(batch.column(text)).offsets
            out = []
            for i, (t, spans) in enumerate(zip(originals, batch.column("hit_spans").to_pylist(), strict=True)):
                if t is None or not spans:
                    out.append(t)
                    continue
                first, base, at, kept = words.first[i], offsets[i], 0, []
                for s in spans:
                    kept.append(t[at : words.starts[first + s["start"]] - base])
                    at = words.ends[first + s["end"] - 1] - base
                out.append(b"".join([*kept, t[at:]]))
            k = batch.schema.get_field_index(text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, pa.large_binary()).cast(batch.schema.field(k).type))

    return found.mapInArrow(run, found.schema)
