"""Exact top-k by integer inner product with block-at-a-time pruning.

Every component x becomes floor(1024 x). The terms of a document are the positive and the negative
parts of its components. The index orders vectors by the signs of random projections, so that near
ones fall together, and cuts the order into blocks; each block has the largest positive and negative
part of every term (kept as the largest and smallest component) and a forward index, the block's
components as one matrix. Sixteen blocks form a shard, the unit that Spark moves.

For a query, a block's bound is the sum of its term maxima weighted by the query. Blocks are taken in
falling order of the bound and scored through their forward indexes until the bound falls below the
k-th best score so far. Each query first searches the shard that holds it, which gives a k-th score
that already prunes all others; then chunks of queries meet the shards by key, each pair of chunk and
shard one step of bounded size. Ties go to the smaller id, so blocks whose bound equals the k-th score
are still scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import materialise, prepare

BLOCK = 256
SHARD = 16 * BLOCK
CHUNK = 512
LOWEST = -np.inf


def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(vec_id, vector)`` -> ``(vec_id, dim, place, data)``: components as i64 bytes, and the signs of
    random projections as a sort key. Rows without an id and vectors that are null, empty or hold null
    or non-finite components (or ones beyond the range of a long) are left out."""
    for batch in batches:
        vectors = batch.column(1)
        ids, lists = batch.column(0).to_pylist(), vectors.flatten()
        values = lists.to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
        sizes = np.array([n or 0 for n in pc.list_value_length(vectors).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(1024 * values)
            fine = np.abs(scaled) < 2.0**62
        bad = np.concatenate(([0], np.cumsum(~fine)))
        ok = (sizes > 0) & (bad[ends] == bad[ends - sizes]) & np.array([i is not None for i in ids], bool)
        for dim in np.unique(sizes[ok]).tolist():
            rows = np.flatnonzero(ok & (sizes == dim))
            x = scaled[(ends[rows] - dim)[:, None] + np.arange(dim)]
            planes = np.random.default_rng([7, dim]).standard_normal((dim, 48))
            place = ((x @ planes > 0) @ (1 << np.arange(47, -1, -1, dtype=np.int64))).astype(np.int64)
            data = [r.tobytes() for r in x.astype("<i8")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in rows.tolist()], pa.int64()), pa.array([dim] * len(rows), pa.int32()),
                 pa.array(place), pa.array(data, pa.binary())], ["vec_id", "dim", "place", "data"])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> ``(shard, dim, ids, data)``."""
    part, seq = TaskContext.get().partitionId() << 32, 0
    names = ["shard", "dim", "ids", "data"]
    held: dict[int, tuple[list, list]] = {}

    def out(dim: int, ids: list, data: list) -> pa.RecordBatch:
        nonlocal seq
        seq += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([part | seq], pa.int64()), pa.array([dim], pa.int32()),
             pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())], names)

    for batch in batches:
        for vec_id, dim, data in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
            ids, rows = held.setdefault(dim, ([], []))
            ids.append(vec_id)
            rows.append(data)
            if len(ids) == SHARD:
                yield out(dim, *held.pop(dim))
    for dim, (ids, rows) in held.items():
        yield out(dim, ids, rows)


def exact(matrix: np.ndarray, other: np.ndarray) -> bool:
    """Whether doubles hold every partial sum of the products."""
    big = float(np.abs(matrix).max(initial=0)) * float(np.abs(other).max(initial=0)) * max(1, matrix.shape[1])
    return big < 2.0**53


class Shard:
    """Forward indexes and term maxima of a shard's blocks."""

    def __init__(self, dim: int, ids: bytes, data: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        whole = np.frombuffer(data, "<i8").reshape(-1, dim)
        self.whole = whole
        at = np.arange(0, len(whole), BLOCK)
        self.high, self.low = np.maximum.reduceat(whole, at), np.minimum.reduceat(whole, at)
        self.blocks = [(self.ids[i:i + BLOCK], whole[i:i + BLOCK]) for i in at.tolist()]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
        """``(query row, vec_id, score)`` of up to k best of each query here, none below ``kth``; and the
        k-th best score each query has seen."""
        doubles = exact(queries, self.whole)
        kind = np.float64 if doubles else np.int64
        q = queries.astype(kind)
        positive, negative = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        bound = positive @ self.high.T.astype(float) + negative @ self.low.T.astype(float)
        if not doubles:
            bound += np.abs(bound) * 1e-9 + 1  # rounding must not lower a bound
        order = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((len(q), k), LOWEST)
        kth = kth.astype(float).copy()
        found = []
        for r in range(order.shape[1]):
            block = order[:, r]
            live = np.flatnonzero(bound[np.arange(len(q)), block] >= kth)
            if not len(live):
                break
            for b in np.unique(block[live]).tolist():
                own = live[block[live] == b]
                ids, matrix = self.blocks[b]
                score = q[own] @ matrix.T.astype(kind)
                other = ids[None, :] != query_ids[own][:, None]
                seen = np.where(other, score, LOWEST)
                best[own] = -np.partition(-np.concatenate((best[own], seen), axis=1), k - 1, axis=1)[:, :k]
                kth[own] = np.maximum(kth[own], best[own].min(axis=1))
                i, j = np.nonzero(other & (score >= kth[own][:, None]))
                found.append((own[i], ids[j], score[i, j].astype(np.int64)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), kth
        row, vec, score = (np.concatenate(x) for x in zip(*found))
        keep = score >= kth[row]
        row, vec, score = row[keep], vec[keep], score[keep]
        at = np.lexsort((vec, -score, row))
        row, vec, score = row[at], vec[at], score[at]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        return row[keep], vec[keep], score[keep], kth


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every``, its ``k`` highest scores
    among all rows with another id (all, if there are fewer), ties to the smaller id.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
    an id; vectors are only compared with others of their length. A repeated row is a candidate each
    time; a query id that occurs more than once asks once, with its smallest vector. Other columns are
    not read. An empty table gives no rows."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    coded = materialise(rows.mapInArrow(numbers, "vec_id long, dim int, place long, data binary"), "topk-rows")
    index = materialise(coded.repartitionByRange("dim", "place", "vec_id").sortWithinPartitions("dim", "place", "vec_id")
                        .mapInArrow(shards, "shard long, dim int, ids binary, data binary"), "topk-index")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a shard searched in it: their vectors and first k-th scores."""
        for batch in batches:
            for dim, ids, data in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                shard = Shard(dim, ids, data)
                for at in range(0, len(shard.ids), CHUNK):
                    own = at + np.flatnonzero(shard.ids[at:at + CHUNK] % every == 0)
                    if len(own):
                        kth = shard.search(shard.ids[own], shard.whole[own], np.full(len(own), LOWEST), k)[3]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.ids[own]), pa.array([dim] * len(own), pa.int32()),
                             pa.array([r.tobytes() for r in shard.whole[own]], pa.binary()), pa.array(kth)],
                            ["query_id", "dim", "data", "kth"])

    queries = index.mapInArrow(home, "query_id long, dim int, data binary, kth double")
    queries = queries.groupBy("query_id").agg(F.min(F.struct("dim", "data", (-F.col("kth")).alias("kth"))).alias("q"))
    queries = materialise(queries.select("query_id", "q.dim", "q.data", (-F.col("q.kth")).alias("kth")), "topk-queries")
    n_chunks = -(-queries.count() // CHUNK)
    if not n_chunks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_buckets = max(1, min(index.count(), max(64, spark.sparkContext.defaultParallelism)))
    chunks = (queries.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(n_chunks)))
              .groupBy("dim", "chunk").agg(F.collect_list(F.struct("query_id", "data", "kth")).alias("queries")))
    # A stated query set against all rows, in blocks: each chunk goes to every bucket of shards once.
    chunks = chunks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))))
    placed = index.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(n_buckets)).cast("int"))
    pairs = placed.join(chunks, ["bucket", "dim"]).select("dim", "ids", "data", "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                dim, ids, data, asked = (batch.column(i)[n] for i in range(4))
                asked = asked.values
                query_ids = asked.field(0).to_numpy()
                matrix = np.frombuffer(b"".join(asked.field(1).to_pylist()), "<i8").reshape(len(query_ids), -1)
                shard = Shard(dim.as_py(), ids.as_py(), data.as_py())
                row, vec, score, _ = shard.search(query_ids, matrix, asked.field(2).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(vec), pa.array(score)],
                                                 ["query_id", "vec_id", "score"])

    scored = pairs.mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# The same scores of every query against every row, for DuckDB over the ``embeddings`` view.
ORACLE_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))::BIGINT AS score
  FROM whole q JOIN whole d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
