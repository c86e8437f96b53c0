"""SentencePiece encoding with several sampled segmentations, and decoding.

Gumbel top-k without replacement: every segmentation of a text has its log-probability plus Gumbel
noise, and the k largest are wanted. They are found without listing any others, by a best-first
search from the top down. A text's decisions are the pieces taken along its lattice. The best
segmentation is a draw from the root; at each of its decisions the ways not taken form a node,
whose largest perturbed value is drawn directly, below that of the way taken. The best node of all
is opened next: its way up to there, another piece, and a new draw for the rest. A segmentation's
inclusion score is its chance to lie above the best value left over at the end.

All texts of a chunk are searched side by side. Noise is a hash of a text's row key and of the
place it is for, so a row's samples do not depend on its neighbours or on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.llm import lattice as L
from capsonde.llm import tokens as W

SAMPLES = 2
SMOOTHING = 0.5  # log-probabilities are multiplied by it: below 1, samples differ more
CHUNK_BYTES = 1 << 19  # of text encoded together: working arrays take some 150 times as much
SAMPLE = "array<struct<ids: array<int>, log_prob: double, inclusion: double>>"


def uniform(seed: np.ndarray, *parts) -> np.ndarray:
    h = seed
    for p in parts:
        h = W.mix(h ^ W.mix(np.atleast_1d(p).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def left_over(log_p: np.ndarray) -> np.ndarray:
    """log(1 - exp(log_p))."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(log_p))


def below(limit: np.ndarray, mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel value around `mass`, given that it is under `limit`."""
    return -np.logaddexp(-limit, np.log(-np.log(u)) - mass)


class Search:
    """Decisions of all samples so far, in one pool; sample r of text t has span[r][t]."""

    def __init__(self, lat: L.Lattice, word: np.ndarray, first: np.ndarray, seeds: np.ndarray):
        self.lat, self.word, self.first, self.seeds = lat, word, first, seeds
        self.text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.pool = {n: np.zeros(0, t) for n, t in (("edge", np.int32), ("occurrence", np.int32), ("before", float), ("node", float), ("taken", np.int64))}
        self.spans: list[np.ndarray] = []
        self.log_probs: list[np.ndarray] = []

    def walk(self, occurrences: np.ndarray, places: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """Draw pieces from each place to its word's end: (occurrence, edge), in order."""
        seed = self.seeds[self.text_of[occurrences]]
        inside = (occurrences - self.first[self.text_of[occurrences]]) << 32 | round_
        got: list = []
        row = np.flatnonzero(self.lat.goes_on[places])
        at, step = places[row], 0
        while len(row):
            u = uniform(seed[row], inside[row] | step << 8).astype(np.float32)
            edge = self.lat.draw(at, u)
            got.append((row, np.full(len(row), step), edge))
            at = self.lat.target[edge]
            step += 1
            open_ = np.flatnonzero(self.lat.goes_on[at])
            row, at = row[open_], at[open_]
        if not got:
            z = np.zeros(0, np.int64)
            return z, z
        row, steps, edge = (np.concatenate(x) for x in zip(*got, strict=True))
        counts = np.bincount(row, minlength=len(occurrences))
        to = (np.cumsum(counts) - counts)[row] + steps
        out = np.empty((2, len(row)), np.int64)
        out[0, to], out[1, to] = occurrences[row], edge
        return out[0], out[1]

    def add(self, texts: np.ndarray, kept: np.ndarray, parents: np.ndarray, branch: np.ndarray, walked: tuple, limit: np.ndarray, round_: int) -> None:
        """A sample for each of `texts`: `kept` decisions from pool places `parents` on, one at
        (occurrence, edge) of `branch` unless that is -1, then what was walked."""
        n = len(self.first) - 1
        text_w = self.text_of[walked[0]]
        rest = np.bincount(text_w, minlength=n)[texts]
        has = (branch[0] >= 0).astype(np.int64)
        size = kept + has + rest
        begin = np.cumsum(size) - size
        total = int(size.sum())
        new = {k: np.zeros(total, v.dtype) for k, v in self.pool.items()}
        inner = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
        to, source = np.repeat(begin, kept) + inner, np.repeat(parents, kept) + inner
        for k in ("edge", "occurrence"):
            new[k][to] = self.pool[k][source]
        b = begin[has > 0] + kept[has > 0]
        new["occurrence"][b], new["edge"][b] = (x[has > 0] for x in branch)
        inner = np.arange(len(text_w)) - np.repeat(np.cumsum(rest) - rest, rest)
        fresh = np.repeat(begin + kept + has, rest) + inner
        new["occurrence"][fresh], new["edge"][fresh] = walked
        step = self.lat.steps[new["edge"]]
        sums = np.concatenate([[0.0], np.cumsum(step)])
        new["before"] = sums[:-1] - np.repeat(sums[begin], size)
        new["taken"] = 1 << (self.lat.lengths[new["edge"]].astype(np.int64) - 1)
        # Only what was walked leaves new nodes.
        owner = np.repeat(np.arange(len(texts)), rest)
        u = uniform(self.seeds[texts][owner], (fresh - begin[owner]) | 1 << 62 | round_ << 48)
        node = below(limit[owner], new["before"][fresh] + left_over(step[fresh]), u)
        new["node"][:] = -np.inf
        new["node"][fresh] = np.where(np.isfinite(node), node, -np.inf)
        base = len(self.pool["edge"])
        span = np.full((n, 2), -1, np.int64)
        span[texts] = np.stack([base + begin, base + begin + size], 1)
        log_prob = np.full(n, -np.inf)
        log_prob[texts] = sums[begin + size] - sums[begin]
        self.pool = {k: np.concatenate([v, new[k]]) for k, v in self.pool.items()}
        self.spans.append(span)
        self.log_probs.append(log_prob)

    def best_nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every text the largest node: its value, pool place and sample; -inf if none is left."""
        n = len(self.first) - 1
        value, place, sample = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
        for r, span in enumerate(self.spans):
            texts = np.flatnonzero(span[:, 1] > span[:, 0])
            if not len(texts):
                continue
            begin, end = span[texts, 0], span[texts, 1]
            nodes = self.pool["node"][begin[0] : end[-1]]
            top = np.maximum.reduceat(nodes, begin - begin[0])
            hit = np.flatnonzero(nodes == np.repeat(top, end - begin))
            owner = np.searchsorted(begin - begin[0], hit, "right") - 1
            _, one = np.unique(owner, return_index=True)
            better = top > value[texts]
            value[texts[better]] = top[better]
            place[texts[better]] = hit[one][better] + begin[0]
            sample[texts[better]] = r
        return value, place, sample

    def ways(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place a row of probabilities by the pieces' lengths, and one of edges, -1 where there is none."""
        begin, counts = self.lat.edges[places], self.lat.edges[places + 1] - self.lat.edges[places]
        row = np.repeat(np.arange(len(places)), counts)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        edge = begin[row] + inner
        length = self.lat.lengths[edge]
        lower = np.where(inner > 0, self.lat.chosen[edge - 1], np.float32(0))
        odds, edges = np.zeros((len(places), int(length.max(initial=1)))), np.full((len(places), int(length.max(initial=1))), -1)
        odds[row, length - 1] = self.lat.chosen[edge] - lower
        edges[row, length - 1] = edge
        return odds, edges

    def run(self, k: int) -> np.ndarray:
        """Adds up to k samples of every text; returns the best value that is left over."""
        n = len(self.first) - 1
        texts = np.arange(n)
        nobody = np.full((2, n), -1, np.int64)
        zero = np.zeros(n, np.int64)
        root = -np.log(-np.log(uniform(self.seeds, zero + (1 << 41))))
        self.add(texts, zero, zero, nobody, self.walk(np.arange(len(self.word)), self.lat.first[self.word], 0), root, 0)
        for r in range(1, k):
            value, place, sample = self.best_nodes()
            texts = np.flatnonzero(np.isfinite(value))
            if not len(texts):
                break
            at, limit = place[texts], value[texts]
            spans = np.stack(self.spans)[sample[texts], texts]
            taken, before = self.pool["taken"][at], self.pool["before"][at]
            odds, edges = self.ways(self.lat.place[self.pool["edge"][at]])
            free = (edges >= 0) & ((taken[:, None] >> np.arange(odds.shape[1])) & 1 == 0)
            odds = np.where(free, np.maximum(odds, 1e-300), 0.0)
            total = np.cumsum(odds, 1)
            u = uniform(self.seeds[texts], at - spans[:, 0], np.full(len(texts), 1 << 42 | r))
            column = np.minimum((total < (u * total[:, -1])[:, None]).sum(1), odds.shape[1] - 1)
            # What is still open at the opened node is a smaller node below the one just taken.
            odds[np.arange(len(texts)), column] = 0
            rest = odds.sum(1)
            u = uniform(self.seeds[texts], at - spans[:, 0], np.full(len(texts), 1 << 43 | r))
            with np.errstate(divide="ignore"):
                node = below(limit, before + np.log(rest), u)
            self.pool["node"][at] = np.where(rest > 0, node, -np.inf)
            self.pool["taken"][at] = taken | (1 << column)
            occurrence, edge = self.pool["occurrence"][at].astype(np.int64), edges[np.arange(len(texts)), column]
            later = self.first[texts + 1] - occurrence  # this word's rest and the words after it
            inner = np.arange(int(later.sum())) - np.repeat(np.cumsum(later) - later, later)
            occurrences = np.repeat(occurrence, later) + inner
            places = np.where(inner == 0, np.repeat(self.lat.target[edge], later), self.lat.first[self.word[occurrences]])
            walked = self.walk(occurrences, places, r)
            self.add(texts, at - spans[:, 0], spans[:, 0], np.stack([occurrence, edge]), walked, limit, r)
        return self.best_nodes()[0]


def encode_chunk(texts: list[str], keys: np.ndarray, vocabulary: L.Vocabulary, k: int, smoothing: float) -> pa.Array:
    whole = "".join(" " + t for t in texts)
    chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    chars = np.where(chars == L.META, L.LITERAL, chars)
    starts = np.flatnonzero(chars == L.SPACE)
    ends = np.append(starts[1:], len(chars))
    sums = W.prefix_sums(L.char_symbols(chars))
    _, one, word = np.unique(W.run_hashes(sums, starts, ends), return_index=True, return_inverse=True)
    # In the order of the text, words that are read together lie together.
    order = np.argsort(one)
    rank = np.empty(len(one), np.int64)
    rank[order] = np.arange(len(one))
    one, word = one[order], rank[word]
    lat = L.build(chars, sums, starts[one], (ends - starts)[one], vocabulary, smoothing)
    borders = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, borders)
    search = Search(lat, word, first, keys)
    spare = search.run(k)
    ids, counts = L.expand_fallback(lat.pieces[search.pool["edge"]], vocabulary)
    at = np.concatenate([[0], np.cumsum(counts)])
    spans, log_probs = np.stack(search.spans, 1), np.stack(search.log_probs, 1)
    real = spans[:, :, 0] >= 0
    with np.errstate(over="ignore", invalid="ignore"):
        inclusion = np.where(np.isfinite(spare)[:, None], -np.expm1(-np.exp(log_probs - spare[:, None])), 1.0)
    begin, end = at[spans[real][:, 0]], at[spans[real][:, 1]]
    size = end - begin
    take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids[take].astype(np.int32)))
    struct = pa.StructArray.from_arrays([lists, pa.array(log_probs[real]), pa.array(inclusion[real])], ["ids", "log_prob", "inclusion"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32)), struct)


def encode(
    docs: DataFrame, model_path: str, key: str = "doc_id", k: int = SAMPLES, smoothing: float = SMOOTHING,
    text: str = "text",
) -> DataFrame:
    """docs with `samples`: up to k distinct segmentations, the likeliest under the noise first.

    Each has the piece ids, its log-probability among all segmentations of the text, and its
    inclusion score. Every sample decodes to the text exactly. Null is encoded as the empty text,
    which has one segmentation: the lone word start. Texts with fewer than k segmentations give all,
    with scores of 1. Noise depends on the key column and the text's places only: rows that agree in
    both have equal samples (scores up to rounding); a null key is a key of its own. An empty table stays empty; other
    columns are kept, one called samples is replaced. The model is read on the driver.
    """
    vocabulary = L.load_vocabulary(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text, CHUNK_BYTES):
            texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
            seeds = W.mix(batch.column("__seed").to_numpy().view(np.uint64))
            samples = encode_chunk(texts, seeds, vocabulary, k, smoothing)
            columns = [samples.cast(f.type) if f.name == "samples" else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.drop("samples").select("*", F.xxhash64(key).alias("__seed"), F.array().cast(SAMPLE).alias("samples"))
    return out.mapInArrow(run, out.schema).drop("__seed")


def decode(rows: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the text of an id list; null stays null, the empty list is the empty text."""
    pieces = L.load_vocabulary(model_path).texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else b"".join([pieces[x] for x in i])[1:].decode("utf-8", "replace")
                     for i in batch.column(ids).to_pylist()]
            columns = [pa.array(texts, f.type) if f.name == name else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = rows.drop(name).withColumn(name, F.lit(None).cast("string"))
    return out.mapInArrow(run, out.schema)
