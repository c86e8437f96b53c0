"""Bring every repeated window of the corpus together without shipping the corpus.

A window is n consecutive symbols of one text. Its key is the least hash of the k-grams in it, so
equal windows have equal keys, and neighbouring windows mostly share one: a text becomes runs of
windows with one key. Whole copies of a text are known from its hash and go no further. Keys that
stand in one place only are found by counting keys alone and drop out; the other runs are sent, by
key, as segments. Wherever equal windows meet is thereby one
group, and copies of a whole segment that a task already holds are sent as places without content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsonde.llm import tokens as W
from capsonde.llm.jaccard_join import planes, unplanes
from capsonde.llm.storage import stored

WHOLE = -1  # end of a span that goes to the text's end
LAST = (1 << 63) - 1  # stands for a null doc_id: later than every other
FRAGMENT_BYTES = 32 << 20  # of text behind one fragment of keys
LEAST_FRAGMENTS = 64
TEXT_BYTES = 1 << 19  # of text whose windows a task looks at together: each byte takes some 80 of working arrays
UNIT = 1 << 20  # runs that a task holds before it sends their keys off
HELD_BYTES = 2 << 20  # of segments that a task holds to find copies
PARSED_BYTES = 1 << 20  # of segments parsed together: whole groups, one at least


@dataclass
class Units:
    """Texts as symbols: text i has symbols first[i]:first[i + 1]; `sums` are their prefix sums."""

    sums: np.ndarray
    first: np.ndarray
    contents: Callable[[np.ndarray, np.ndarray], pa.Array]


@dataclass(frozen=True)
class Windows:
    size: int
    gram: int
    parse: Callable[[pa.Array, int], Units]
    within: bool  # whether repeats inside one document count
    length: Callable[[Column], Column]  # symbols of a text


def word_units(column: pa.Array, size: int) -> Units:
    """Words as symbols; the content of a run is its windows' hashes."""
    texts = W.texts_of(column)
    words = W.find_words(texts, W.NOT_SPACE)
    sums = W.prefix_sums(W.word_hashes(texts.data, words))

    def contents(starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        lengths = ends - starts
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)
        return binaries(W.run_hashes(sums, at, at + size).view(np.uint8), lengths * 8)

    return Units(sums, words.first, contents)


def byte_units(column: pa.Array, size: int) -> Units:
    """Bytes as symbols; the content of a run is all bytes of its windows."""
    texts = W.texts_of(column)

    def contents(starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        lengths = ends - starts + size - 1
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)
        return binaries(texts.data[at], lengths)

    return Units(W.prefix_sums(W.SYMBOL[texts.data]), texts.offsets, contents)


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def runs(units: Units, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Starts and ends (window starts), key and text of every run, and whether its key stands twice in it."""
    first, sums = units.first, units.sums
    n = len(sums) - 1
    counts = np.maximum(np.diff(first) - size + 1, 0)
    valid = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - first[:-1], counts)
    if not len(valid):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z, np.zeros(0, bool)
    at = np.arange(max(n - gram + 1, 0))
    hashes = W.run_hashes(sums, at, at + gram)
    width, step, least = size - gram + 1, 1, hashes
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    key, of = least[valid], np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(valid), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    starts, ends = valid[begin], valid[np.append(begin[1:], len(valid)) - 1] + 1
    key, of = key[begin], of[begin]
    # A window inside can only repeat inside where the key's gram moves on before the last start.
    twice = np.zeros(len(begin), bool)
    for i in range(0, len(begin), 1 << 14):
        s = slice(i, i + (1 << 14))
        place = starts[s, None] + np.argmax(hashes[starts[s, None] + np.arange(width)] == key[s, None], 1)[:, None]
        twice[s] = place[:, 0] < ends[s] - 1
    return starts, ends, key, of, twice


def identified(docs: DataFrame, text: str) -> DataFrame:
    """docs with __doc (doc_id, null last) and __hash: rows which agree in both have one answer."""
    return docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__hash": F.xxhash64(text)})


def key_rows(docs: DataFrame, windows: Windows, fragments: int, text: str) -> DataFrame:
    ddl = "fragment int, keys binary, members binary, docs binary, hashes binary"
    schema = pa.schema([("fragment", pa.int32()), *[(c, pa.binary()) for c in ("keys", "members", "docs", "hashes")]])

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        shift = np.cumsum([0, *[len(h[2]) for h in held]])
        keys = np.concatenate([h[0] for h in held])
        member = np.concatenate([h[1] + s for h, s in zip(held, shift[:-1], strict=True)])
        docs_, hashes = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        order = np.argsort(keys, kind="stable")
        keys, member = keys[order], member[order]
        piece = ((keys >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(piece, np.arange(fragments + 1))
        for f in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[f], cuts[f + 1])
            here, local = np.unique(member[at], return_inverse=True)
            yield pa.RecordBatch.from_pylist([{
                "fragment": int(f), "keys": planes(keys[at]), "members": planes(local.astype(np.uint32)),
                "docs": docs_[here].tobytes(), "hashes": hashes[here].tobytes(),
            }], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in W.chunks(batches, text, TEXT_BYTES):
            _, _, key, of, twice = runs(windows.parse(batch.column(text), windows.size), windows.size, windows.gram)
            if windows.within:
                key, of = np.concatenate([key, key[twice]]), np.concatenate([of, of[twice]])
            held.append((spread(key), of, batch.column("__doc").to_numpy(), batch.column("__hash").to_numpy()))
            n += len(key)
            if n >= UNIT:
                yield from emit(held)
                held, n = [], 0
        if held:
            yield from emit(held)

    return docs.select("__doc", "__hash", text).mapInArrow(run, ddl)


def spread(key: np.ndarray) -> np.ndarray:
    """Least hashes are small; mixed again they fill the range that fragments are cut from."""
    return W.mix(key)


def repeated_keys(rows: DataFrame, within: bool) -> DataFrame:
    """(__doc, __hash, __keys): of every document the keys which stand in more than one place.

    Of documents with one text only the first counts and is listed (see `whole_copies`).
    """

    def run(table: pa.Table) -> pa.Table:
        keys, docs, hashes = [], [], []
        for r in table.to_pylist():
            member = unplanes(r["members"], np.uint32)
            keys.append(unplanes(r["keys"], np.uint64))
            docs.append(np.frombuffer(r["docs"], np.int64)[member])
            hashes.append(np.frombuffer(r["hashes"], np.int64)[member])
        keys, docs, hashes = map(np.concatenate, (keys, docs, hashes))
        order = np.lexsort((docs, hashes, keys))
        keys, docs, hashes = keys[order], docs[order], hashes[order]
        text = np.ones(len(keys), bool)
        text[1:] = (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])
        first = docs == docs[np.flatnonzero(text)][np.cumsum(text) - 1]
        keys, docs, hashes = keys[first], docs[first], hashes[first]
        order = np.lexsort((docs, keys))
        keys, docs, hashes = keys[order], docs[order], hashes[order]
        same = keys[1:] == keys[:-1]
        if within:
            many = np.zeros(len(keys), bool)
            many[1:] |= same
            many[:-1] |= same
        else:
            other = same & (docs[1:] != docs[:-1])
            group = np.concatenate([[0], np.cumsum(~same)]) if len(keys) else np.zeros(0, np.int64)
            many = np.bincount(group[1:][other], minlength=int(group[-1]) + 1 if len(group) else 0)[group] > 0
        keys, docs, hashes = keys[many], docs[many], hashes[many]
        order = np.lexsort((keys, hashes, docs))
        keys, docs, hashes = keys[order], docs[order], hashes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
        first = np.flatnonzero(new)
        offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
        return pa.table({"__doc": docs[first], "__hash": hashes[first],
                         "__keys": pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))})

    per_fragment = rows.groupBy("fragment").applyInArrow(run, "__doc long, __hash long, __keys array<long>")
    return per_fragment.groupBy("__doc", "__hash").agg(F.flatten(F.collect_list("__keys")).alias("__keys"))


def whole_copies(docs: DataFrame) -> DataFrame:
    """(__doc, __hash) of documents whose whole text an earlier one has."""
    texts = docs.select("__doc", "__hash")
    first = texts.groupBy("__hash").agg(F.min("__doc").alias("__first"), F.max("__doc").alias("__last"))
    first = first.where("__first < __last").drop("__last")
    return texts.join(first, "__hash").where("__doc > __first").select("__doc", "__hash").distinct()


SEGMENT = "key long, __doc long, __hash long, start int, end int, content binary"
SEGMENT_ARROW = pa.schema([("key", pa.int64()), ("__doc", pa.int64()), ("__hash", pa.int64()), ("start", pa.int32()),
                           ("end", pa.int32()), ("content", pa.binary())])


def segments(docs: DataFrame, repeated: DataFrame, windows: Windows, text: str) -> DataFrame:
    """Runs with a repeated key. Later copies of one that the task holds have no content and lie anywhere."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = windows.parse(batch.column(text), windows.size)
        starts, ends, key, of, _ = runs(units, windows.size, windows.gram)
        key = spread(key)
        lists = batch.column("__keys")
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        known = W.mix(lists.flatten().to_numpy().view(np.uint64) + W.mix(owner.astype(np.uint64)))
        kept = np.isin(W.mix(key + W.mix(of.astype(np.uint64))), known)
        starts, ends, key, of = starts[kept], ends[kept], key[kept], of[kept]
        base = units.first[of]
        return pa.RecordBatch.from_arrays([
            pa.array(key.view(np.int64)), batch.column("__doc").take(pa.array(of)), batch.column("__hash").take(pa.array(of)),
            pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32)), units.contents(starts, ends),
        ], schema=SEGMENT_ARROW)

    def without_copies(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        doc, start = table["__doc"].to_numpy(), table["start"].to_numpy()
        copy = first_copies(table["content"].combine_chunks(), doc, start, windows.within)
        # Mixed with its place, the key of a row without content falls anywhere.
        key = np.where(copy, W.mix(table["__hash"].to_numpy().view(np.uint64) + start.astype(np.uint64)).view(np.int64), table["key"].to_numpy())
        content = pa.compute.if_else(pa.array(copy), pa.scalar(None, pa.binary()), table["content"].combine_chunks())
        out = table.set_column(0, "key", pa.array(key)).set_column(5, "content", content)
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in W.chunks(batches, text, TEXT_BYTES):
            rows = cut(batch)
            if rows.num_rows:
                held.append(rows)
                n += rows.nbytes
            if n >= HELD_BYTES:
                yield without_copies(held)
                held, n = [], 0
        if held:
            yield without_copies(held)

    # All columns go along: the exchange of documents is then the one that their result joins.
    return docs.join(repeated, ["__doc", "__hash"]).mapInArrow(run, SEGMENT)


def content_hashes(content: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, their offsets, and a hash of each value."""
    offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    data = np.frombuffer(content.buffers()[2], np.uint8) if content.buffers()[2] else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    hashes = W.run_hashes(W.prefix_sums(W.SYMBOL[data]), offsets[:-1], offsets[1:])
    return data, offsets, W.mix(hashes + np.diff(offsets).astype(np.uint64))


def first_copies(content: pa.Array, doc: np.ndarray, start: np.ndarray, within: bool) -> np.ndarray:
    """Which rows repeat the content of an earlier place (unless `within`, of an earlier document)."""
    hashes = content_hashes(content)[2]
    order = np.lexsort((start, doc, hashes))
    h, d, s = hashes[order], doc[order], start[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    copy = np.zeros(len(h), bool)
    copy[order] = (d != d[lead]) | within & (s != s[lead])
    return copy


SPAN = "__doc long, __hash long, start int, end int"
SPAN_ARROW = pa.schema([("__doc", pa.int64()), ("__hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
#: A parser takes keys, docs, starts and contents of whole groups; it returns row numbers, starts and ends of spans.
Parser = Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def duplicate_spans(rows: DataFrame, windows: Windows, parse: Parser) -> DataFrame:
    """Spans, in symbols of a document, of the windows that also start earlier.

    A task reads its segments sorted by key, and parses some whole groups at a time.
    """
    tail = windows.size - 1

    def work(held: list) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        known = table["content"].is_null().to_numpy()
        doc, hash_, start, end = (table[c].to_numpy() for c in ("__doc", "__hash", "start", "end"))
        yield spans(doc[known], hash_[known], start[known], end[known] + tail)
        open_ = np.flatnonzero(~known)
        if not len(open_):
            return
        content = table["content"].take(pa.array(open_)).combine_chunks()
        copy = first_copies(content, doc[open_], start[open_], windows.within)
        same = open_[copy]
        yield spans(doc[same], hash_[same], start[same], end[same] + tail)
        open_ = open_[~copy]
        content = content.filter(pa.array(~copy))
        row, a, b = parse(table["key"].to_numpy()[open_], doc[open_], start[open_].astype(np.int64), content)
        yield spans(doc[open_][row], hash_[open_][row], a, b)

    def spans(doc: np.ndarray, hash_: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(hash_), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=SPAN_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        # A batch may hold many times what is parsed at once, so it is taken in slices.
        for batch in W.chunks(batches, "content", PARSED_BYTES // 4):
            key = batch.column("key").to_numpy()
            at = 0
            if n >= PARSED_BYTES:
                others = np.flatnonzero(key != last)
                if len(others):
                    at = int(others[0])
                    yield from work([*held, batch.slice(0, at)])
                    held, n = [], 0
            held.append(batch.slice(at))
            n += batch.nbytes
            last = key[-1]
        if held:
            yield from work(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


def with_duplicate_spans(docs: DataFrame, windows: Windows, parse: Parser, text: str) -> DataFrame:
    """docs with dup_spans: not yet merged runs of symbols in windows that start earlier; else null."""
    docs = identified(docs.drop("dup_spans"), text)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, -(-size // FRAGMENT_BYTES))
    repeated = stored(repeated_keys(key_rows(docs, windows, fragments, text), windows.within), "repeated-keys")
    spans = duplicate_spans(segments(docs, repeated, windows, text), windows, parse)
    whole = whole_copies(docs).select("__doc", "__hash", F.lit(0).alias("start"), F.lit(WHOLE).alias("end"))
    # Rows are dealt out before they are put in lists: a list of one takes twice the room.
    dealt = spans.unionByName(whole).repartition("__doc", "__hash")
    listed = dealt.groupBy("__doc", "__hash").agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    n = windows.length(F.col(text)).cast("int")
    resolved = F.filter(
        F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), F.when(s["end"] == WHOLE, n).otherwise(s["end"]).alias("end"))),
        lambda s: s["end"] - s["start"] >= windows.size)
    return docs.join(listed, ["__doc", "__hash"], "left").withColumn("dup_spans", resolved).drop("__doc", "__hash", "__spans")
