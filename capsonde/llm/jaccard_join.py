"""Similarity join of documents on the Jaccard similarity of their word n-grams.

Vertical partitioning: the global order of n-grams (their hashes) is cut into fragments, and each
fragment is worked on apart. It drops the n-grams of one class of documents only, which no pair can
share, and keeps the others with their document frequencies. Overlaps of a pair are counted in
every fragment separately and summed. Documents with equal sets form one class from the start.

Candidates share one of their rarest n-grams (prefix filter, singles counted in). A list of classes
around an n-gram is not turned into pairs: all are first compared with the most typical one, whose
n-grams are the most frequent, and afterwards only members of different components are paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsonde.llm import tokens as W
from capsonde.llm.components import components
from capsonde.llm.storage import stored

SHINGLE = 5
PERCENT = 80
UNIT = 2 << 20  # n-grams that a task holds before it sends them off
FRAGMENT = 3 << 19  # n-grams in one fragment, about
LEAST_FRAGMENTS = 64
PIECES = 8  # parts that a pair's overlap is counted in


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text, text by text, and where each text's begin."""
    texts = W.texts_of(column)
    texts = W.Texts(W.LOWER[texts.data], texts.offsets)
    words = W.find_words(texts, W.NOT_SPACE)
    sums = W.prefix_sums(W.word_hashes(texts.data, words))
    starts = words.windows(shingle)
    ends = starts + shingle
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    starts = np.concatenate([starts, words.first[short]])
    ends = np.concatenate([ends, words.first[short + 1]])
    of = np.searchsorted(words.first, starts, "right") - 1
    grams = W.run_hashes(sums, starts, ends)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(texts) + 1))


def class_keys(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of every set; equal sets have equal keys."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(grams ^ W.SYMBOL[7]))])
    sizes = np.diff(first).astype(np.uint64)
    return W.mix((sums[first[1:]] - sums[first[:-1]]) * W.SYMBOL[9] + sizes).view(np.int64)


def with_classes(docs: DataFrame, shingle: int, text: str) -> DataFrame:
    """(doc_id, n_shingles, class) of every row; class is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            grams, first = shingle_sets(batch.column(text), shingle)
            sizes = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(class_keys(grams, first), mask=sizes == 0)],
                ["doc_id", "n_shingles", "class"],
            )

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n_shingles long, class long")


def add_class(docs: DataFrame, name: str, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """docs with the class key of each text in a column `name`; null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            grams, first = shingle_sets(batch.column(text), shingle)
            keys = pa.array(class_keys(grams, first), pa.int64(), mask=np.diff(first) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: sorted numbers then compress in a shuffle."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def fragment_rows(docs: DataFrame, shingle: int, fragments: int, text: str) -> DataFrame:
    """N-grams of every class, a row for each fragment and unit of documents."""
    schema = pa.schema([("fragment", pa.int32()), ("grams", pa.binary()), ("members", pa.binary()),
                        ("classes", pa.binary()), ("sizes", pa.binary())])

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        grams, keys, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        distinct, first_of = np.unique(keys, return_index=True)
        size_of = sizes[first_of]
        # Equal sets within the unit are sent once.
        begins = np.cumsum(sizes) - sizes
        take = np.repeat(begins[first_of] - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())
        grams, member = grams[take], np.repeat(np.arange(len(distinct)), size_of)
        order = np.argsort(grams, kind="stable")
        grams, member = grams[order], member[order]
        piece = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(piece, np.arange(fragments + 1))
        for f in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[f], cuts[f + 1])
            here, local = np.unique(member[at], return_inverse=True)
            yield pa.RecordBatch.from_pylist([{
                "fragment": int(f), "grams": planes(grams[at]), "members": planes(local.astype(np.uint32)),
                "classes": distinct[here].tobytes(), "sizes": size_of[here].astype(np.int64).tobytes(),
            }], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in W.chunks(batches, text):
            grams, first = shingle_sets(batch.column(text), shingle)
            sizes = np.diff(first)
            keys = class_keys(grams, first)
            held.append((grams, keys[sizes > 0], sizes[sizes > 0]))
            n += len(grams)
            if n >= UNIT:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return docs.select(text).mapInArrow(run, "fragment int, grams binary, members binary, classes binary, sizes binary")


def shared_grams(rows: DataFrame) -> DataFrame:
    """(fragment, class, n, grams, counts): the n-grams that at least two classes have."""

    def run(table: pa.Table) -> pa.Table:
        grams, classes, sizes = [], [], []
        for r in table.to_pylist():
            member = unplanes(r["members"], np.uint32)
            grams.append(unplanes(r["grams"], np.uint64))
            classes.append(np.frombuffer(r["classes"], np.int64)[member])
            sizes.append(np.frombuffer(r["sizes"], np.int64)[member])
        grams, classes, sizes = map(np.concatenate, (grams, classes, sizes))
        order = np.argsort(grams, kind="stable")
        grams, classes, sizes = grams[order], classes[order], sizes[order]
        # Only n-grams with more than one row need a closer look.
        many = np.zeros(len(grams), bool)
        same = grams[1:] == grams[:-1]
        many[1:] |= same
        many[:-1] |= same
        grams, classes, sizes = grams[many], classes[many], sizes[many]
        order = np.lexsort((classes, grams))
        grams, classes, sizes = grams[order], classes[order], sizes[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (classes[1:] != classes[:-1])
        grams, classes, sizes = grams[new], classes[new], sizes[new]
        _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
        counts = counts[which]
        kept = counts > 1
        grams, classes, sizes, counts = grams[kept], classes[kept], sizes[kept], counts[kept]
        order = np.argsort(classes, kind="stable")
        grams, classes, sizes, counts = grams[order], classes[order], sizes[order], counts[order]
        owners, first = np.unique(classes, return_index=True)
        offsets = pa.array(np.append(first, len(grams)).astype(np.int32))
        return pa.table({
            "fragment": pa.array(np.full(len(owners), table["fragment"][0].as_py(), np.int32)),
            "class": pa.array(owners), "n": pa.array(sizes[first]),
            "grams": pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64))),
            "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
        })

    return rows.groupBy("fragment").applyInArrow(
        run, "fragment int, class long, n long, grams array<long>, counts array<long>")


def needed(n1: Column, n2: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that links them."""
    return F.ceil((n1 + n2) * percent / F.lit(100 + percent))


def prefix_postings(shared: DataFrame, percent: int) -> DataFrame:
    """(gram, class, n, m, place, typical): each class's rarest n-grams in the order of frequency.

    m counts the n-grams it shares at all, place is the n-gram's in the order (singles come
    first), typical is the mean frequency of the class's n-grams.
    """
    whole = shared.groupBy("class").agg(
        F.first("n").alias("n"), F.sum(F.size("grams")).alias("m"),
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("total"),
        F.flatten(F.collect_list(F.arrays_zip("counts", "grams"))).alias("g"),
    )
    # The prefix has n - needed + 1 n-grams, of which n - m are singles.
    slots = F.col("m") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    rare = F.slice(F.sort_array("g"), 1, F.col("slots").cast("int"))["grams"]
    return whole.withColumn("slots", slots).where("slots > 0").select(
        "class", "n", "m", ((F.col("total") + F.col("n") - F.col("m")) / F.col("n")).alias("typical"),
        F.posexplode(rare).alias("i", "gram"),
    ).withColumn("place", F.col("n") - F.col("m") + F.col("i")).drop("i")


def pairable(percent: int) -> Column:
    """What two classes must fulfil where they meet first in the order of n-grams.

    Their overlap is at most what either shares at all, and at most what is left of either from
    there on; later meetings of the same two prove nothing, so they may fail.
    """
    need = F.ceil((F.col("n1") + F.col("n2")) * percent / F.lit(100 + percent))
    return (
        (F.least("m1", "m2") >= need) & (F.least("n1", "n2") >= need)
        & (F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) >= need)
    )


def prefixes_allow(percent: int) -> Column:
    """Overlap is at most that of the prefixes p1 and p2 and the longer rest."""
    need = F.ceil((F.col("n1") + F.col("n2")) * percent / F.lit(100 + percent))
    rest = F.greatest(F.ceil(F.col("n1") * percent / F.lit(100)), F.ceil(F.col("n2") * percent / F.lit(100))) - 1
    return F.size(F.array_intersect("p1", "p2")) + rest >= need


def overlaps(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with `overlap`: counted in every piece apart, then summed.

    A piece is a PIECES-th of the fragments, so that a pair has as many rows at any input size.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    pieces = stored(
        shared.join(wanted, "class", "left_semi").groupBy("class", (F.col("fragment") % PIECES).alias("piece"))
        .agg(F.flatten(F.collect_list("grams")).alias("grams")), "pieces")
    left = pieces.select(F.col("class").alias("a"), "piece", F.col("grams").alias("ga"))
    right = pieces.select(F.col("class").alias("b"), "piece", F.col("grams").alias("gb"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "piece"]).select(
        "a", "b", F.size(F.array_intersect("ga", "gb")).alias("part"))
    return pairs.join(partial.groupBy("a", "b").agg(F.sum("part").alias("overlap")), ["a", "b"])


def linked(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    return overlaps(pairs, shared).where(
        F.col("overlap") * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))).select("a", "b")


def side(postings: DataFrame, i: int, *more: str) -> DataFrame:
    name = "a" if i == 1 else "b"
    return postings.select("gram", F.col("class").alias(name), *[F.col(c).alias(f"{c}{i}") for c in ("n", "m", "place", *more)])


def link_classes(shared: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes which have a link."""
    postings = stored(prefix_postings(shared, percent), "postings")
    hubs = postings.groupBy("gram").agg(
        F.min(F.struct((-F.col("typical")).alias("t"), "class", "n", "m", "place")).alias("hub"), F.count("*").alias("k"),
    ).where("k > 1").select("gram", "hub.class", "hub.n", "hub.m", "hub.place")
    stars = side(hubs, 1).join(side(postings, 2), "gram").where(F.col("a") != F.col("b")).where(pairable(percent))
    stars = stored(stars.select("a", "b", "n1", "n2").distinct(), "star-pairs")
    links = stored(linked(stars, shared, percent), "links")
    roots = stored(components(links), "roots")
    labelled = postings.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    mixed = labelled.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
    open_ = labelled.join(mixed, "gram", "left_semi")
    prefix = postings.groupBy("class").agg(F.collect_list("gram").alias("p"))
    open_ = stored(open_.join(prefix, "class"), "open-postings")
    cross = side(open_, 1, "root", "p").join(side(open_, 2, "root", "p"), "gram").where(
        (F.col("a") < F.col("b")) & (F.col("root1") != F.col("root2"))).where(pairable(percent) & prefixes_allow(percent))
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = stored(cross.select("a", "b", "n1", "n2").distinct().join(done, ["a", "b"], "left_anti"), "cross-pairs")
    more = stored(linked(cross, shared, percent), "links")
    return roots if more.isEmpty() else stored(components(links.unionByName(more)), "roots")


def similarity_components(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, and class, the key of its set.

    Two documents link when their sets' intersection is at least `percent` of the union;
    component_id is the smallest doc_id reachable by links. Null and empty texts, and texts without
    words, have an empty set and are their own component. Repeated rows are documents of one class.
    A null doc_id takes part but is never a component's id unless nothing else is. An empty table
    gives no rows; columns besides doc_id and text are not looked at.
    """
    classed = stored(with_classes(docs, shingle, text), "classes")
    total = classed.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, -(-total // FRAGMENT))
    shared = stored(shared_grams(fragment_rows(docs, shingle, fragments, text)), "shared-grams")
    roots = link_classes(shared, percent)
    least = classed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    least = least.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "component_id")
    return classed.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class")
