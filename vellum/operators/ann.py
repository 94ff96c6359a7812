"""Approximate top-k search by an inverted-file index (V11), and rows stored near their like.

Building: k-means (Spark ML) on a bounded sample gives ``cells`` centres; tasks give every row its nearest
centre; rows are written range-partitioned by cell, a large cell in parts of about ``PART_ROWS`` rows
chosen by a hash of the id. Every row is in the index, whatever the sample was.

Searching: a query probes its ``nprobe`` nearest cells. Queries are packed with the numbers of these cells in
blocks in the shared folder, one vector a query however many cells it probes. Tasks hold stored rows up to a
bounded size, read the blocks and let each cell meet the queries that probe it in matrix products; neither rows
nor queries are shuffled. The k-th distance in a query's nearest cell bounds what it keeps elsewhere, and a
task emits at most k rows a query of all it holds. ``probes_for`` finds the least ``nprobe`` whose recall
against exact search reaches a target, on a sample of the queries: for each true neighbour it takes how near
to the query its cell is among all cells.

Exact search over the stored rows (``CellIndex.exact``) is the search of ``operators.knn`` with the bounds of the
nearest cells: its tiles follow the cells, so their radii are small and many are skipped by the triangle inequality.

Cosine indexes hold unit vectors; l2 and ip indexes the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import vectors as vx
from vellum.operators import knn as kn
from vellum.operators.embed import materialize

PART_ROWS = 8192
PART_QUERIES = 4096  # queries in a packed block, at most
HELD_BYTES = kn.DEFAULT_MAX_BLOCK_BYTES // 4  # stored rows that meet the blocks at once
BATCH_VALUES = 1 << 20  # numbers that are held at once while rows are dealt to cells
MAX_CELLS = 4096  # centres are sent to every task: at most so many, so their bytes are bounded by the dimension


def _unit(mat: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return mat
    size = np.sqrt(np.einsum("ij,ij->i", mat, mat))[:, None]
    return np.divide(mat, size, out=np.zeros_like(mat), where=size > 0)


def _apart(q: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """How far queries are from centres, in the order in which cells are probed."""
    if metric == "ip":
        return -(q @ centres.T)
    return (q * q).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2.0 * (q @ centres.T)


def _dealt(id_name: str, centres: np.ndarray, metric: str, nprobe: int, vectors: bool):
    """Batches ``(id, embedding)`` -> batches of the rows with their cells. Rows are dealt out a few at a time, so
    that what is held for them stays within ``BATCH_VALUES`` numbers."""
    dim, nprobe = centres.shape[1], min(nprobe, len(centres))
    step = max(1, BATCH_VALUES // max(len(centres), dim, nprobe * (dim if vectors else 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                mat, _ = kn._list_to_matrix(some.column(1), dim)
                mat = _unit(mat, metric)
                far = _apart(mat, centres, metric if nprobe > 1 or id_name == "query_id" else "l2")
                cells = np.argsort(far, axis=1, kind="stable")[:, :nprobe]
                rows = np.repeat(np.arange(len(mat)), nprobe)
                columns = {id_name: some.column(0).take(pa.array(rows))}
                if vectors:
                    columns["embedding"] = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), pa.array(mat[rows].ravel()))
                columns["cell"] = pa.array(cells.ravel().astype(np.int32))
                columns["place"] = pa.array(np.tile(np.arange(nprobe), len(mat)).astype(np.int32))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _by_cell(df: DataFrame, id_name: str, centres: np.ndarray, metric: str, nprobe: int, vectors: bool = True) -> DataFrame:
    """Rows ``(id, embedding)`` with their ``nprobe`` nearest cells, nearest first: one row a cell, ``(id,
    embedding, cell, place)``, without the embedding unless ``vectors``. The cell of a row is the nearest by
    distance, also for ip."""
    id_type = df.schema["id"].dataType.simpleString()
    return df.select("id", "embedding").mapInArrow(
        _dealt(id_name, centres, metric, nprobe, vectors),
        f"{id_name} {id_type}, {'embedding array<double>, ' if vectors else ''}cell int, place int")


def _pack_probes(centres: np.ndarray, metric: str, nprobe: int, qid_type: pa.DataType):
    """Query rows ``(id, embedding, bound)`` -> blocks ``(ids, mat, bounds, cells)`` of at most ``PART_QUERIES``
    queries and ``BATCH_VALUES`` numbers, with the ``nprobe`` nearest cells of each query."""
    n_cells, dim = centres.shape
    step = max(1, min(PART_QUERIES, BATCH_VALUES // max(n_cells, dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                mat, _ = kn._list_to_matrix(some.column(1), dim)
                mat = _unit(mat, metric)
                cells = np.argsort(_apart(mat, centres, metric), axis=1, kind="stable")[:, :nprobe].astype(np.uint16)
                bound = some.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, len(mat)], pa.int32()), pa.concat_arrays([some.column(0).cast(qid_type)]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in (mat, bound, cells))],
                                                 ["ids", "mat", "bounds", "cells"])

    return run


def _least(who: np.ndarray, what: np.ndarray, far: np.ndarray, order: np.ndarray, k: int, most: np.ndarray) -> tuple:
    """The k nearest of each query among found pairs; ``most`` falls to a query's k-th distance."""
    by = np.lexsort((order[what], far, who))
    place = kn._places(who[by])
    last = by[place == k - 1]
    most[who[last]] = np.minimum(most[who[last]], far[last])
    by = by[place < k]
    return who[by], what[by], far[by]


def _probed(folder: str, metric: str, k: int, dim: int, n_cells: int, qid_type: pa.DataType, id_type: pa.DataType,
            held_bytes: int):
    """Stored rows ``(id, embedding, cell)`` are held up to ``held_bytes``; every query block is read, and each
    held cell meets the queries that probe it. At most k rows a query are emitted of all that is held."""

    def rank(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        rows = rows.take(pc.sort_indices(rows, [("cell", "ascending"), ("id", "ascending")])).combine_chunks()
        ids, cell = rows.column("id").combine_chunks(), rows.column("cell").to_numpy()
        order = np.empty(len(ids), np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        place = np.full(n_cells, -1, np.int32)  # of a cell among those held
        place[cell[starts]] = np.arange(len(starts))
        tiles = []  # a row's id is its place here: inside a cell these follow the order of the ids
        for at, end in zip(starts, np.r_[starts[1:], len(cell)]):
            vectors = rows.column("embedding").slice(at, end - at).combine_chunks()
            some = pa.RecordBatch.from_arrays([pa.array(np.arange(at, end)), vectors], ["id", "embedding"])
            tiles.append(kn.corpus_rows([some], dim, metric, k))
        del rows
        for block, cells in kn._read_blocks(folder, dim, with_cells=True):
            who, nth = np.nonzero(place[cells] >= 0)
            if not len(who):
                continue
            own = place[cells[who, nth]]
            by = np.argsort(own, kind="stable")
            who, own = who[by], own[by]
            most, found, n, limit = block.bound.copy(), [], 0, kn.HELD_PAIRS
            for some in np.split(np.arange(len(own)), np.flatnonzero(own[1:] != own[:-1]) + 1):
                asks = who[some]
                few = kn._Block(pa.array(asks), block.mat[asks], most[asks])
                for b in kn.nearest(few, tiles[own[some[0]]], metric, k, pa.int64(), pa.int64()):
                    found.append([c.to_numpy() for c in b.columns])
                    n += b.num_rows
                if n > limit:
                    found = [_least(*map(np.concatenate, zip(*found)), order, k, most)]
                    n = len(found[0][0])
                    limit = n + kn.HELD_PAIRS
            if n:
                i, j, d = _least(*map(np.concatenate, zip(*found)), order, k, most)
                yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(i)).cast(qid_type), ids.take(pa.array(j)).cast(id_type),
                                                  pa.array(d, pa.float64())], ["query_id", "id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= held_bytes:
                yield from rank(held)
                held, size = [], 0
        if held:
            yield from rank(held)

    return run


@dataclass(frozen=True)
class CellIndex:
    """Rows by cell below ``path``: ``rows(id, embedding, cell, part)`` and ``cells(cell, n, parts)``."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    metric: str
    dim: int

    @staticmethod
    def build(corpus: DataFrame, path: str, dim: int, metric: str = "cosine", cells: int | None = None,
              sample_limit: int = 100_000, seed: int = 7, id_col: str = "id", vec_col: str = "embedding") -> CellIndex:
        """Index every usable row of ``corpus`` (of length ``dim``, finite, with an id). ``cells`` defaults to
        the square root of the number of rows, at most ``MAX_CELLS``; k-means sees about ``sample_limit`` rows.
        An empty corpus gives an index of one cell and no rows."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = corpus.sparkSession
        rows = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("embedding")).where(
            vx.is_valid_vector("embedding", dim) & F.col("id").isNotNull())
        n = rows.count()
        cells = max(1, min(cells or round(n**0.5), MAX_CELLS, n))
        draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < F.lit(min(1.0, sample_limit / max(1, n)) * (1 << 30))
        vector = vx.l2_normalize("embedding") if metric == "cosine" else F.col("embedding")
        sample = materialize(rows.where(draw).select(array_to_vector(vector).alias("features")))
        centres = np.zeros((1, dim))
        if cells > 1 and not sample.isEmpty():
            model = KMeans(k=cells, seed=seed, maxIter=8, initSteps=2).fit(sample)
            centres = np.array(model.clusterCenters())
        placed = materialize(_by_cell(rows, "id", centres, metric, 1).drop("place"))
        counts = placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
        counts.write.parquet(f"{path}/cells")
        counts = spark.read.parquet(f"{path}/cells")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        (placed.join(F.broadcast(counts.select("cell", "parts")), "cell")  # a row a cell: at most MAX_CELLS
         .select("id", "embedding", "cell", part.alias("part"))
         .repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/rows"))
        return CellIndex(spark, path, centres, metric, dim)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _usable(self, queries: DataFrame) -> DataFrame:
        return queries.select(F.col("query_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
            vx.is_valid_vector("embedding", self.dim) & F.col("id").isNotNull())

    def _queries(self, queries: DataFrame, nprobe: int, vectors: bool = True) -> DataFrame:
        return _by_cell(self._usable(queries), "query_id", self.centres, self.metric, min(nprobe, len(self.centres)), vectors)

    def _search(self, asks: DataFrame, k: int, nprobe: int) -> DataFrame:
        """``asks(id, embedding, bound)`` -> the k nearest in their ``nprobe`` nearest cells, within the bounds."""
        from vellum.session import shared_path, ship_package

        ship_package(self.spark)
        rows = self.rows().select("id", "embedding", "cell")
        qid, rid = asks.schema["id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
        types = kn._arrow_type(asks, "id"), kn._arrow_type(rows, "id")
        folder = shared_path(self.spark, "ann", "queries", unique=True)
        asks.select("id", "embedding", "bound").mapInArrow(
            _pack_probes(self.centres, self.metric, nprobe, types[0]),
            f"ids array<{qid}>, mat binary, bounds binary, cells binary").write.parquet(folder)
        return kn.final_topk(rows.mapInArrow(_probed(folder, self.metric, k, self.dim, len(self.centres), *types, HELD_BYTES),
                                             f"query_id {qid}, id {rid}, distance double"), k)

    def bounds(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, bound)``: the k-th distance in the nearest cell of each query that finds k rows there; no
        row further away is among its k nearest."""
        near = self._search(self._usable(queries).withColumn("bound", F.lit(float("inf"))), k, 1)
        return near.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """``queries(query_id, embedding)`` -> ``(query_id, rank, id, distance)`` among the rows of each
        query's ``nprobe`` nearest cells; exact with as many probes as cells. Query ids are to be unique."""
        if k <= 0 or nprobe <= 0:
            raise ValueError("k and nprobe must be positive")
        bounds = self.bounds(queries, k).withColumnRenamed("query_id", "id")
        asks = self._usable(queries).join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        return self._search(asks, k, min(nprobe, len(self.centres)))

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest of all rows, by the exact search over rows stored by cell."""
        return kn.knn(self.rows(), queries, k, self.metric, dim=self.dim, bounds=self.bounds(queries, k))

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.95, sample_limit: int = 500, seed: int = 11) -> int:
        """The least ``nprobe`` that finds ``target`` of the true neighbours of about ``sample_limit`` queries
        (chosen by a hash of the id)."""
        n = queries.count()
        draw = F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.lit(1 << 30)) < F.lit(min(1.0, sample_limit / max(1, n)) * (1 << 30))
        sample = materialize(queries.where(draw))
        true = self.exact(sample, k).select("query_id", "id").join(self.rows().select("id", "cell"), "id")
        needed = true.join(self._queries(sample, len(self.centres), vectors=False), ["query_id", "cell"])
        counts = needed.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # at most a row a cell
        total, seen = sum(r.n for r in counts), 0
        for r in counts:
            seen += r.n
            if seen >= target * total:
                return r.place + 1
        return len(self.centres)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row ``(n_true, n_found, recall)``: how many of the true ``(query_id, id)`` were found."""
    both = true.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found")).withColumn(
        "recall", F.when(F.col("n_true") > 0, F.col("n_found") / F.col("n_true")).otherwise(F.lit(1.0)))
