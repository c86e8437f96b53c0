"""Hard negatives by angular triangle filtering.

Every vector stores its length and its angles to a few reference directions. Between an anchor at
angles a and a row at angles b the triangle inequality leaves an angle from max |a - b| to
min(a + b, 2 pi - a - b); its cosines times both lengths bound the score from both sides, widened
by more than rounding can move them. A row is scored in integers only if its bounds overlap a
window that can still change the result: first the scores from an anchor's k-th best positive so
far upwards, then each positive's band of negative scores, cut below its k-th best so far.
Vectors are packed into blocks with the ranges of their angles and lengths, so whole blocks are
passed over in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsonde.llm.storage import stored
from capsonde.llm.topk import packed, unpacked
from capsonde.session import broadcast_if_small

REFERENCES = 8
SAMPLE = 2048  # vectors, the first by hash, that reference directions are chosen from
BLOCK = 2048
ANCHORS = 64  # anchors in one block
SALTS = 32  # a label, or the vectors nearest one reference, are dealt to this many keys
ANGLE_SLACK = 1e-6  # arc cosines of cosines near one are off by up to some 1e-8
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1

BLOCK_KIND = (
    "dim int, part long, salt int, block long, ids binary, copies binary, labels binary, data binary, lengths binary, "
    "angles binary, angle_low binary, angle_high binary, length_low double, length_high double, "
    "extra_counts binary, extras binary")


def reference_directions(vectors: DataFrame, references: int = REFERENCES, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Per dimension, unit vectors far from each other: the longest of a bounded sample, then
    always the one that is least like those chosen. Any choice gives the same results."""
    drawn = vectors.where("length > 0").orderBy(F.xxhash64("vid", "copy"), "vid").limit(sample)
    first = drawn.select("dim", "v").toArrow()
    out: dict[int, np.ndarray] = {}
    dims = first["dim"].to_numpy()
    for dim in np.unique(dims):
        rows = np.array(first["v"].filter(pa.array(dims == dim)).to_pylist(), float)
        rows /= np.abs(rows).max(axis=1, keepdims=True)
        rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        like = np.full(len(rows), -np.inf)
        chosen = [0]
        while len(chosen) < min(references, len(rows)):
            like = np.maximum(like, rows @ rows[chosen[-1]])
            chosen.append(int(like.argmin()))
        out[int(dim)] = rows[chosen]
    return out


def angles_to(rows: np.ndarray, lengths: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles in [0, pi]; a vector of length zero has a right angle to everything."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(lengths[:, None] > 0, rows.astype(float) @ references.T / lengths[:, None], 0.0)
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def score_bounds(low: np.ndarray, high: np.ndarray, shortest: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of vectors whose angle lies in [low, high] and whose product of
    lengths lies in [shortest, longest], widened by angle and rounding errors."""
    upper = np.cos(np.clip(low - ANGLE_SLACK, 0.0, np.pi))
    lower = np.cos(np.clip(high + ANGLE_SLACK, 0.0, np.pi))
    slack = longest * 1e-9 + 1.0
    return (
        np.where(lower >= 0, lower * shortest, lower * longest) - slack,
        np.where(upper >= 0, upper * longest, upper * shortest) + slack,
    )


def angle_interval(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles possible between an anchor and rows whose angles to the references lie in [low, high]."""
    if not anchor.shape[-1]:
        return np.zeros(len(low)), np.full(len(low), np.pi)
    least = np.maximum(np.maximum(low - anchor, anchor - high), 0.0).max(axis=-1)
    most = np.minimum(anchor + high, 2 * np.pi - anchor - low).min(axis=-1)
    return least, np.clip(most, least, np.pi)


def integer_scores(q: np.ndarray, rows: np.ndarray, longest: float) -> np.ndarray:
    """Exact products; in floating point where every sum is exact, else in integers of any size.
    Scores beyond 64 bits come out as the least or greatest of them."""
    if longest < EXACT / 4:
        return (rows.astype(float) @ q.astype(float)).astype(np.int64)
    if longest < 2.0**62:
        return rows.astype(np.int64) @ q.astype(np.int64)
    exact = rows.astype(object) @ q.astype(object)
    return np.array([min(max(int(x), LEAST), MOST) for x in exact], np.int64)


def labelled(vectors: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vid, v, label, dim, length, copy) of the rows that take part, rows alike once."""
    fine = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    present = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine & label.isNotNull()
    whole = vectors.where(present).select(
        F.col(id_col).cast("long").alias("vid"), label.cast("long").alias("label"),
        F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    return whole.select(
        "vid", "v", "label", F.size("v").alias("dim"),
        F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("length"),
        F.xxhash64("label", "v").alias("copy"),
    ).dropDuplicates(["vid", "copy"])


def with_angles(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """Adds `angles` to the references of the row's dimension, and `nearest`, the closest of them."""
    shared = rows.sparkSession.sparkContext.broadcast(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lengths = batch["dim"].to_numpy(), batch["length"].to_numpy()
            flat, offsets = batch["v"].flatten().to_numpy(), batch["v"].offsets.to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                data = flat[(offsets[at] - offsets[0])[:, None] + np.arange(dim)]
                angles = angles_to(data, lengths[at], shared.value.get(dim, np.zeros((0, dim))))
                nearest = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(at), np.int64)
                ends = pa.array(np.arange(len(at) + 1) * angles.shape[1], pa.int32())
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(ends, pa.array(angles.ravel())), pa.array(nearest, pa.int32())],
                    [*part.schema.names, "angles", "nearest"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, angles array<double>, nearest int")


def packed_blocks(rows: DataFrame, part: Column, size: int, salts: int) -> DataFrame:
    """Rows of `with_angles` as blocks of at most `size` of one (dim, part, salt).

    A column `extra`, an array of integers, is carried along.
    """
    extra = F.col("extra") if "extra" in rows.columns else F.array().cast("array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def emit(key: tuple) -> pa.RecordBatch:
            ids, copies, labels, data, lengths, angles, counts, extras = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            return pa.RecordBatch.from_pylist([{
                "dim": key[0], "part": key[1], "salt": key[2], "block": int(ids[0]),
                "ids": ids.tobytes(), "copies": copies.tobytes(), "labels": labels.tobytes(),
                "data": packed(data), "lengths": lengths.tobytes(), "angles": angles.tobytes(),
                "angle_low": angles.min(axis=0).tobytes(), "angle_high": angles.max(axis=0).tobytes(),
                "length_low": float(lengths.min()), "length_high": float(lengths.max()),
                "extra_counts": counts.tobytes(), "extras": extras.tobytes(),
            }], schema)

        def matrix(column: pa.Array, at: np.ndarray, width: int, kind: type) -> np.ndarray:
            flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
            return flat[(offsets[at] - offsets[0])[:, None] + np.arange(width)].astype(kind)

        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("dim", "part", "salt")), strict=True))
            numbers = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            number = np.array([numbers[k] for k in keys], np.int64)
            plain = [batch[c].to_numpy() for c in ("vid", "copy", "label", "length")]
            extra_counts = np.diff(batch["extra"].offsets.to_numpy()).astype(np.int64)
            first_extra, extras = np.cumsum(extra_counts) - extra_counts, batch["extra"].flatten().to_numpy()
            widths = np.diff(batch["angles"].offsets.to_numpy())
            for key, i in numbers.items():
                at = np.flatnonzero(number == i)
                for lo in range(0, len(at), size):
                    some = at[lo : lo + size]
                    ids, copies, labels, lengths = (x[some] for x in plain)
                    own = np.concatenate([extras[first_extra[j] : first_extra[j] + extra_counts[j]] for j in some])
                    held.setdefault(key, []).append((
                        ids, copies, labels, matrix(batch["v"], some, key[0], np.int64), lengths,
                        matrix(batch["angles"], some, int(widths[some[0]]), np.float64), extra_counts[some], own.astype(np.int64)))
                    if sum(len(x[0]) for x in held[key]) >= size:
                        yield emit(key)
        for key in list(held):
            yield emit(key)

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in BLOCK_KIND.split(", ")])
    keyed = rows.select(
        "vid", "copy", "v", "label", "dim", "length", "angles", extra.alias("extra"), part.cast("long").alias("part"),
        F.pmod(F.xxhash64("vid"), F.lit(salts)).cast("int").alias("salt"))
    return keyed.repartition("dim", "part", "salt").mapInArrow(run, BLOCK_KIND)


class Block:
    """A block's arrays."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.ids, self.copies, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "copies", "labels"))
        n = len(self.ids)
        self.v = unpacked(row["data"], self.dim, n)
        self.lengths = np.frombuffer(row["lengths"], np.float64)
        self.angles = np.frombuffer(row["angles"], np.float64).reshape(n, -1)
        self.low, self.high = (np.frombuffer(row[c], np.float64)[None] for c in ("angle_low", "angle_high"))
        self.length_low, self.length_high = row["length_low"], row["length_high"]

    def reach(self, angles: np.ndarray, length: float) -> tuple[float, float]:
        """Least and greatest score that an anchor can have with any row here."""
        least, greatest = score_bounds(
            *angle_interval(angles, self.low, self.high), np.array([length * self.length_low]), np.array([length * self.length_high]))
        return float(least[0]), float(greatest[0])

    def bounds(self, angles: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        product = length * self.lengths
        return score_bounds(*angle_interval(angles, self.angles, self.angles), product, product)


class Windows:
    """Per anchor its windows of scores, each with the k best rows so far."""

    def __init__(self, k: int, low: list[int], high: list[int]):
        self.k, self.low, self.high = k, list(low), list(high)
        self.found: list[list[tuple[int, int]]] = [[] for _ in low]  # (-score, id), best first

    def open(self, least: float, greatest: float) -> list[int]:
        return [i for i, (lo, hi) in enumerate(zip(self.low, self.high, strict=True)) if lo <= hi and greatest >= lo and least <= hi]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best = self.found[i] + [(-int(s), int(v)) for s, v in zip(scores, ids, strict=True)]
        self.found[i] = sorted(set(best))[: self.k]
        if len(self.found[i]) == self.k:
            self.low[i] = max(self.low[i], -self.found[i][-1][0])


def meet(q: np.ndarray, angles: np.ndarray, length: float, windows: Windows, block: Block, fits: np.ndarray) -> None:
    """Scores the rows of a block that `fits` allows and whose bounds overlap an open window."""
    if not windows.open(*block.reach(angles, length)):
        return
    least, greatest = block.bounds(angles, length)
    wanted = np.zeros(len(least), bool)
    for lo, hi in zip(windows.low, windows.high, strict=True):
        if lo <= hi:
            wanted |= (greatest >= lo) & (least <= hi)
    at = np.flatnonzero(wanted & fits)
    if not len(at):
        return
    scores = integer_scores(q, block.v[at], length * float(block.lengths[at].max()))
    ids = block.ids[at]
    for i, (lo, hi) in enumerate(zip(windows.low, windows.high, strict=True)):
        hit = np.flatnonzero((scores >= lo) & (scores <= hi))
        if len(hit) > windows.k:
            edge = np.partition(scores[hit], -windows.k)[-windows.k]
            hit = hit[scores[hit] >= edge]
            hit = hit[np.lexsort((ids[hit], -scores[hit]))[: windows.k]]
        if len(hit):
            windows.add(i, scores[hit], ids[hit])


BLOCK_COLUMNS = [c.split()[0] for c in BLOCK_KIND.split(", ")]


def score_pairs(anchors: DataFrame, blocks: DataFrame, salts: int, k: int, same_label: bool) -> DataFrame:
    """Anchor blocks, laid out to every salt, beside the blocks of their (dim, part): the best rows
    of each anchor's windows, (anchor_id, copy, number of the window, vec_id, score).

    An anchor block's rows come one after the other out of the join, so its windows go on closing;
    results do not depend on it. Without `extra` an anchor has one open window.
    """

    def windows_of(block: Block, row: dict) -> list[Windows]:
        if same_label:
            return [Windows(k, [LEAST], [MOST]) for _ in block.ids]
        counts, extras = (np.frombuffer(row[c], np.int64) for c in ("a_extra_counts", "a_extras"))
        ends = np.cumsum(counts)
        scores = [extras[e - n : e].tolist() for n, e in zip(counts, ends, strict=True)]
        return [Windows(k, [-(-p // 2) for p in own], [95 * p // 100 for p in own]) for own in scores]

    def results(block: Block, windows: list[Windows]) -> pa.RecordBatch:
        found = [
            (a, c, i, vid, -s)
            for a, c, w in zip(block.ids.tolist(), block.copies.tolist(), windows, strict=True)
            for i, best in enumerate(w.found) for s, vid in best
        ]
        columns = zip(*found, strict=True) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "copy", "number", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, windows = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch["a_ids"][i].as_py(), batch["a_copies"][i].as_py())
                if key != current:
                    if block is not None:
                        yield results(block, windows)
                    row = {c: batch[c][i].as_py() for c in batch.schema.names if c.startswith("a_")} | {"dim": batch["dim"][i].as_py()}
                    block = Block({c.removeprefix("a_"): v for c, v in row.items()})
                    current, windows = key, windows_of(block, row)
                other = Block({c: batch[c][i].as_py() for c in BLOCK_COLUMNS})
                for j, own in enumerate(windows):
                    alike = other.labels == block.labels[j]
                    fits = alike & (other.ids != block.ids[j]) if same_label else ~alike
                    meet(block.v[j], block.angles[j], float(block.lengths[j]), own, other, fits)
        if block is not None:
            yield results(block, windows)

    spread = anchors.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = ["dim", "part", "salt"]
    named = spread.select(*keys, *[F.col(c).alias(f"a_{c}") for c in BLOCK_COLUMNS if c not in keys])
    return named.hint("merge").join(blocks, keys).mapInArrow(
        run, "anchor_id long, copy long, number long, vec_id long, score long").distinct()


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 3,
    scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Positives are an anchor's n_positives best other rows of its label, negatives the best of the
    rows with another label whose score is from 50 to 95 percent of the positive's; ties go to the
    smaller id. Rows without id or label, or whose vector is null, empty, or holds null or
    non-finite components, take no part; only vectors of one dimension are compared. Rows alike
    count once; rows that share an id but not their vector are rows of their own, and never
    positives of each other. A negative best score leaves an empty band. An empty table gives no
    rows. `is_anchor` is over a column `vid`, `label` over the columns of `vectors`.
    """
    rows = stored(labelled(vectors, label, scale, id_col, vector_col), "labelled-vectors")
    rows = stored(with_angles(rows, reference_directions(rows)), "vector-angles")
    salts = max(SALTS, -(-rows.count() // (64 * BLOCK)))
    anchors = rows.where(is_anchor)
    by_label = packed_blocks(rows, F.col("label"), BLOCK, salts)
    found = score_pairs(packed_blocks(anchors, F.col("label"), ANCHORS, 1), by_label, salts, n_positives, True)
    anchor = ["anchor_id", "copy"]
    positives = stored(ranked(found, anchor, n_positives).select(
        *anchor, "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # At most n_positives scores an anchor, in order of rank: window i belongs to the positive of rank i + 1.
    bands = positives.groupBy(*anchor).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("p")).select(
        F.col("anchor_id").alias("vid"), "copy", F.col("p.positive_score").alias("extra"))
    near = rows.select("dim", F.col("nearest").alias("cell")).distinct()
    banded = anchors.join(bands, ["vid", "copy"]).join(broadcast_if_small(near, 64), "dim")
    by_nearest = packed_blocks(rows, F.col("nearest"), BLOCK, salts)
    found = score_pairs(packed_blocks(banded, F.col("cell"), ANCHORS, 1), by_nearest, salts, n_negatives, False)
    negatives = ranked(found, [*anchor, "number"], n_negatives).select(
        *anchor, (F.col("number") + 1).cast("int").alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.withColumnRenamed("rank", "of")
    return negatives.join(of, [*anchor, "of"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
