"""Exact top-k inner products over buckets of vectors of similar length.

Vectors are grouped by length into buckets, longest first, and packed into blocks. Every query
first meets the blocks of the longest bucket, which gives it a k-th best score so far. That score
over (query length x a bucket's longest vector) is the cosine which a vector there must reach:
above one, the bucket is left out; a high one lets few coordinates decide (coordinate pruning by
Cauchy-Schwarz on the rest), a low one only the vectors' lengths. What remains is multiplied out.
A task goes on with a block of queries through its buckets, and the scores rise as it goes. Bounds
never drop a vector which could still tie with the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048  # vectors in one block
QUERY_BLOCK = 256
LEVELS = 8  # buckets in a halving of the length
FOCUS = 8  # coordinates looked at first
LOCAL_COSINE = 0.5  # from here on coordinates prune better than lengths
EXACT = float(1 << 53)

PACKED = "dim int, bucket int, block long, n int, longest double, ids binary, data binary"


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows whose vector is present, non-empty, and finite throughout, as floor(scale * x)."""
    fine = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vid"),
        F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"),
    ).withColumns({
        "dim": F.size("v"),
        "length": F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))),
    })


def bucketed(vectors: DataFrame) -> DataFrame:
    """Adds the bucket of a vector's length; a higher number holds longer vectors."""
    log = F.when(F.col("length") > 0, F.ceil(F.log2(F.col("length")) * LEVELS)).otherwise(F.lit(-1))
    return vectors.withColumn("bucket", log.cast("int"))


def pack(vectors: DataFrame, parts: int) -> DataFrame:
    """Rows of (vid, v, dim, length, bucket) as blocks of at most BLOCK vectors of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        number = 0

        def emit(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal number
            ids, data, lengths = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            number += 1
            return pa.RecordBatch.from_pylist([{
                "dim": key[0], "bucket": key[1], "block": int(ids.min()), "n": len(ids), "longest": float(lengths.max()),
                "ids": ids.tobytes(), "data": packed(data),
            }], schema)

        for batch in batches:
            dims, buckets = batch["dim"].to_numpy(), batch["bucket"].to_numpy()
            ids, lengths = batch["vid"].to_numpy(), batch["length"].to_numpy()
            vectors_, offsets = batch["v"].flatten().to_numpy(), batch["v"].offsets.to_numpy()
            for dim, bucket in {*zip(dims.tolist(), buckets.tolist(), strict=True)}:
                at = np.flatnonzero((dims == dim) & (buckets == bucket))
                base = offsets[at] - offsets[0]
                for i in range(0, len(at), BLOCK):
                    some = base[i : i + BLOCK]
                    rows = vectors_[some[:, None] + np.arange(dim)]
                    part = at[i : i + BLOCK]
                    held.setdefault((dim, bucket), []).append((ids[part], rows, lengths[part]))
                    if sum(len(x[0]) for x in held[dim, bucket]) >= BLOCK:
                        yield emit((dim, bucket))
        for key in list(held):
            yield emit(key)

    schema = pa.schema([
        ("dim", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()),
        ("longest", pa.float64()), ("ids", pa.binary()), ("data", pa.binary()),
    ])
    return vectors.select("vid", "v", "dim", "length", "bucket").coalesce(parts).mapInArrow(run, PACKED)


class Running:
    """The k best so far of a block of queries, and the score that each must reach."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, theta: np.ndarray, k: int):
        self.ids, self.q, self.theta, self.k = ids, q, theta.copy(), k
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.rows, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, vids: np.ndarray, v: np.ndarray) -> None:
        length = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-length, kind="stable")
        vids, v, length = vids[order], v[order], length[order]
        safe = self.length.max(initial=0) * length.max(initial=0) < EXACT / 4
        kind = np.float64 if safe else np.int64
        q, v = self.q.astype(kind), v.astype(kind)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.theta > 0, self.theta / self.length, -np.inf) * (1 - 1e-9)
        cosine = need / length.max(initial=0) if len(length) and length[0] else np.full(len(need), -np.inf)
        hits: list = []
        for i in np.flatnonzero((cosine <= 1) & (cosine >= LOCAL_COSINE)):
            left = self.by_coordinates(q[i], self.length[i], v, length, self.theta[i])
            hits.append((np.full(len(left), i), left, (v[left] @ q[i]).astype(np.int64)))
        low = np.flatnonzero(cosine < LOCAL_COSINE)
        if len(low):
            # Lengths fall along the block: what is too short for every query is its end.
            reach = int(np.searchsorted(-length, -need[low].min(), "right"))
            scores = q[low] @ v[:reach].T
            row, left = np.nonzero(scores >= self.theta[low][:, None])
            hits.append((low[row], left, scores[row, left].astype(np.int64)))
        if hits:
            rows, left, scores = (np.concatenate(x) for x in zip(*hits, strict=True))
            kept = (scores >= self.theta[rows]) & (vids[left] != self.ids[rows])
            self.merge(rows[kept], vids[left][kept], scores[kept])

    @staticmethod
    def by_coordinates(q: np.ndarray, q_length: float, v: np.ndarray, length: np.ndarray, theta: float) -> np.ndarray:
        """Vectors whose product can reach theta, by the query's largest coordinates and the rest's lengths."""
        first = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        part = (v[:, first] @ q[first]).astype(np.float64)
        q_rest = np.sqrt(max(0.0, q_length**2 - float((q[first].astype(np.float64) ** 2).sum())))
        v_rest = np.sqrt(np.maximum(0.0, length**2 - (v[:, first].astype(np.float64) ** 2).sum(1)))
        bound = np.minimum(q_length * length, part + q_rest * v_rest)
        return np.flatnonzero(bound + 1e-6 * (1.0 + np.abs(part) + q_rest * v_rest) >= theta)

    def merge(self, rows: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        rows, found, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.found, found), (self.scores, scores)))
        order = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[order], found[order], scores[order]
        first = np.searchsorted(rows, np.arange(len(self.ids)))
        kept = np.arange(len(rows)) - first[rows] < self.k
        self.rows, self.found, self.scores = rows[kept], found[kept], scores[kept]
        last = np.searchsorted(self.rows, np.arange(len(self.ids)), "right") - 1
        full = np.bincount(self.rows, minlength=len(self.ids)) >= self.k
        self.theta[full] = np.maximum(self.theta[full], self.scores[last[full]])


def score_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Blocks of queries, each beside its blocks of vectors, longest first: (query_id, vec_id, score)."""

    def done(state: Running) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(state.ids[state.rows]), pa.array(state.found), pa.array(state.scores)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch[c][r].as_py() for c in ("dim", "ids", "data", "q_ids")}
                if row["q_ids"] != current:
                    if state:
                        yield done(state)
                    current = row["q_ids"]
                    state = Running(np.frombuffer(current, np.int64), unpacked(batch["q_data"][r].as_py(), row["dim"], len(current) // 8),
                                    np.frombuffer(batch["q_theta"][r].as_py(), np.float64), k)
                state.meet(np.frombuffer(row["ids"], np.int64), unpacked(row["data"], row["dim"], len(row["ids"]) // 8))
        if state:
            yield done(state)

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def packed(rows: np.ndarray) -> bytes:
    """Integer vectors in the narrowest of 16, 32 and 64 bits that holds them."""
    top = max(int(rows.max(initial=0)), -int(rows.min(initial=0)) - 1)
    return rows.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()


def unpacked(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (dim * n)}").reshape(n, dim).astype(np.int64)


def best(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id; equal rows count once each."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return scores.groupBy("query_id").agg(top.alias("top"))


def with_theta(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    known = best(found, k).select(
        F.col("query_id").alias("vid"),
        F.when(F.size("top") >= k, -F.element_at("top", k)["s"]).cast("double").alias("theta"),
    )
    return queries.join(known, "vid", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))


def pack_queries(queries: DataFrame, parts: int) -> DataFrame:
    """Query blocks of one dimension: ids, vectors and thresholds side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            flat, offsets = batch["v"].flatten().to_numpy(), batch["v"].offsets.to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), QUERY_BLOCK):
                    part = at[i : i + QUERY_BLOCK]
                    rows = flat[(offsets[part] - offsets[0])[:, None] + np.arange(dim)]
                    theta = batch["theta"].to_numpy()[part]
                    yield pa.RecordBatch.from_pylist([{
                        "q_dim": int(dim), "q_ids": batch["vid"].to_numpy()[part].tobytes(), "q_data": packed(rows),
                        "q_theta": theta.tobytes(), "q_reach": reach(rows, theta),
                    }], schema)

    def reach(rows: np.ndarray, theta: np.ndarray) -> float:
        """A bucket whose longest vector is shorter than this holds nothing for any of the queries."""
        length = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(theta > 0, theta / length, -1.0)
        return float(np.nan_to_num(need, nan=-1.0).min()) * (1 - 1e-9)

    schema = pa.schema([
        ("q_dim", pa.int32()), ("q_ids", pa.binary()), ("q_data", pa.binary()), ("q_theta", pa.binary()),
        ("q_reach", pa.float64()),
    ])
    return queries.select("vid", "v", "dim", "theta").coalesce(parts).mapInArrow(
        run, "q_dim int, q_ids binary, q_data binary, q_theta binary, q_reach double"
    )


def top_k(
    vectors: DataFrame, is_query: F.Column, k: int = 20, scale: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k best inner products of every query among all other rows.

    Columns query_id, rank from 1, vec_id, score. Ties go to the smaller vec_id. Vectors which are
    null, empty, or hold null or non-finite components, and rows without an id, take no part; only
    vectors of a query's own dimension are candidates, and never a row with the query's id. Rows
    which repeat an id and a vector count once, as do repeated queries. With fewer than k
    candidates all are returned; an empty table gives no rows. `is_query` is over a column `vid`.
    """
    whole = bucketed(whole_vectors(vectors, scale, id_col, vector_col)).dropDuplicates(["vid", "v"])
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = pack(whole.repartition(parts, "dim", "bucket", F.pmod("vid", F.lit(parts))), parts)
    queries = whole.where(is_query)
    longest = blocks.groupBy("dim").agg(F.max("bucket").alias("top_bucket"))
    top_blocks = blocks.join(longest, "dim").where(F.col("bucket") == F.col("top_bucket")).drop("top_bucket")
    open_queries = pack_queries(queries.withColumn("theta", F.lit(float("-inf"))), parts)
    found = score_pairs(meet(top_blocks, open_queries, parts), k)
    rest = blocks.join(longest, "dim").where(F.col("bucket") < F.col("top_bucket")).drop("top_bucket")
    later = score_pairs(meet(rest, pack_queries(with_theta(queries, found, k), parts), parts), k)
    ranked = best(found.unionByName(later), k).select("query_id", F.posexplode("top").alias("i", "t"))
    return ranked.select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"),
        (-F.col("t.s")).alias("score"),
    )


def meet(blocks: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """Every block of queries with the vector blocks that its thresholds leave open, longest first."""
    on = (F.col("dim") == F.col("q_dim")) & (F.col("longest") >= F.col("q_reach"))
    joined = blocks.join(queries, on).withColumn("q_block", F.xxhash64("q_dim", "q_ids"))
    return joined.repartition(parts, "q_block").sortWithinPartitions("q_block", F.desc("bucket"), "block")
