"""Exact top-k similarity search of a query table against a corpus table.

Plan shape:

    query rows -> mapInArrow: packed in blocks of at most ``max_block_bytes`` -> shared folder
    one row in ``SEED_RATE`` of the corpus, chosen by a hash of the id, ranked as below
      -> the distance of every query's k-th there: its bound, packed with it
    corpus scan (id, embedding; where-filters pushed to Parquet)
      -> mapInArrow: rows are held up to a bounded size; every query block is read from the shared folder and
         meets them ``QUERY_ROWS`` x ``TILE_ROWS`` pairs at a time. Queries that the triangle inequality
         keeps beyond their bound of a tile's centre and radius skip it. For the others a product in
         single precision, whose error is bounded, shows the few pairs that can be within the bound; only
         these are measured in double precision, and at most k rows a query remain
      -> exchange by query_id (at most about SEED_RATE * k rows a query, however many tasks there are)
      -> row_number() over (partition by query_id order by distance, id) <= k

The corpus is never shuffled and never replicated; the query table passes through neither the driver
nor a broadcast. Tiles follow the order of storage, so rows stored near their like (``operators.ann``)
are skipped most. Ties are broken by id; cosine and inner-product distances are compared at 1e-9, squared
distances at ten significant digits, so that float noise between kernels cannot reorder equal
distances and rows very near to a query keep their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.vectors import METRICS

# Resolution at which distances are compared before the id tie-break: decimals, and for l2 the
# significant digits after the first.
DISTANCE_DECIMALS = 9
# One corpus row in so many bounds the distances that are worth keeping.
SEED_RATE = 64
# Rows that share a centre and radius.
TILE_ROWS = 2048
# Upper bound on one broadcast query block, bytes of float64 payload.
DEFAULT_MAX_BLOCK_BYTES = 64 << 20
# Queries that meet a tile in one product.
QUERY_ROWS = 1024
# Found pairs that are held before they are cut to the k nearest of each query.
HELD_PAIRS = 1 << 17


@dataclass(frozen=True)
class _Block:
    ids: pa.Array  # query ids
    mat: np.ndarray  # (nq, dim) float64, already normalised for cosine
    bound: np.ndarray  # (nq,) no row further away is among the k nearest


@dataclass(frozen=True)
class _Tile:
    at: int  # the first of its rows
    centre: np.ndarray
    radius: float
    size: float  # what the vectors in ``low`` were divided by
    low: np.ndarray  # (dim, n) float32, for l2 about the centre and with a last row of -|x|^2 / 2


@dataclass(frozen=True)
class _Rows:
    ids: pa.Array
    order: np.ndarray  # place of each id in the order of ids
    mat: np.ndarray  # (n, dim) float64, already normalised for cosine
    tiles: list[_Tile]


def resolved(d: np.ndarray, metric: str) -> np.ndarray:
    """Distances at the resolution they are compared at."""
    if metric != "l2":
        return np.round(d, DISTANCE_DECIMALS)
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = 10.0 ** (np.floor(np.log10(d)) - DISTANCE_DECIMALS)
        return np.where(d > 0, np.round(d / unit) * unit, d)


def resolved_column(d: Column, metric: str) -> Column:
    if metric != "l2":
        return F.round(d, DISTANCE_DECIMALS)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(d)) - DISTANCE_DECIMALS)
    return F.when(d > 0, F.round(d / unit) * unit).otherwise(d)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)  # a zero vector is at distance 1 from all


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(axis=0)
    return centre, np.sqrt(np.einsum("ij,ij->i", x - centre, x - centre).max())


def _near(q: np.ndarray, bound: np.ndarray, centre: np.ndarray, radius: float, metric: str) -> np.ndarray:
    if metric == "ip":
        least = 1.0 - (q @ centre + np.sqrt(np.einsum("ij,ij->i", q, q)) * radius)
        most = bound
    else:
        least = np.sqrt(np.einsum("ij,ij->i", q - centre, q - centre)) - radius
        most = np.sqrt(np.maximum(bound * (2.0 if metric == "cosine" else 1.0), 0.0))  # |q - x|^2 = 2 * distance on unit vectors
    return ~(least > most + 1e-6 * (1.0 + np.abs(most) + radius))  # not finite: reachable


def reachable(q: np.ndarray, bound: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Which queries may have a row of the tile ``x`` within their bound, by the tile's centre and radius."""
    return _near(q, bound, *_ball(_unit(x) if metric == "cosine" else x), metric)


def _list_to_matrix(arr: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, dim) float64 matrix of a list<float|double> array and a validity mask (right length)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    lengths = arr.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = lengths == dim
    mat = np.zeros((n, dim), dtype=np.float64)
    if ok.all():
        flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if flat.size == n * dim:
            mat = flat.reshape(n, dim)
            return mat, ok
    offsets = arr.offsets.to_numpy()
    values = arr.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for r in np.nonzero(ok)[0]:
        mat[r] = values[offsets[r] : offsets[r] + dim]
    return mat, ok


def _pair_distances(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs ``(q[i], x[j])`` in double precision; cosine takes unit vectors."""
    if metric not in METRICS:
        raise ValueError(metric)
    d = np.empty(len(i))
    step = max(1, (1 << 20) // max(1, q.shape[1]))
    for at in range(0, len(i), step):
        a, b = q[i[at:at + step]], x[j[at:at + step]]
        if metric == "l2":
            a = b = a - b
        dots = np.einsum("ij,ij->i", a, b)
        d[at:at + step] = dots if metric == "l2" else 1.0 - dots
    return d


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """The distances of all pairs as a matrix."""
    i, j = np.divmod(np.arange(len(q) * len(x)), max(1, len(x)))
    return _pair_distances(q, _unit(x) if metric == "cosine" else x, i, j, metric).reshape(len(q), len(x))


def _places(group: np.ndarray) -> np.ndarray:
    """The place of each item in its run of equal values."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))


def _without_spare_copies(mat: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among k nearest: of equal vectors only the k of smallest ids."""
    keep = np.ones(len(mat), bool)
    mark = np.einsum("ij,j->i", mat, np.sin(np.arange(1.0, mat.shape[1] + 1)))
    by = np.argsort(mark, kind="stable")
    twin = np.zeros(len(mat), bool)
    same = mark[by][1:] == mark[by][:-1]
    twin[by[1:][same]] = twin[by[:-1][same]] = True
    some = np.flatnonzero(twin)
    if len(some):
        whole = np.ascontiguousarray(mat[some]).view(np.dtype((np.void, mat.shape[1] * mat.itemsize))).ravel()
        group = np.unique(whole, return_inverse=True)[1].ravel()
        by = np.lexsort((order[some], group))
        keep[some[by[_places(group[by]) >= k]]] = False
    return np.flatnonzero(keep)


def _tile(x: np.ndarray, at: int, metric: str) -> _Tile:
    centre, radius = _ball(x)
    low = x - centre if metric == "l2" else x
    norms = np.einsum("ij,ij->i", low, low)
    size = np.sqrt(norms.max())
    size = float(size) if size > 0 else 1.0
    low = low / size
    if metric == "l2":
        low = np.concatenate([low, (norms / size / size / -2.0)[:, None]], axis=1)
    return _Tile(at, centre, radius, size, low.T.astype(np.float32))


def corpus_rows(batches: list[pa.RecordBatch], dim: int, metric: str, k: int) -> _Rows:
    """Batches ``(id, embedding)`` as rows to be ranked; rows that cannot be (null id, wrong length, not
    finite) are left out."""
    ids, mats = [], []
    for batch in batches:
        x, ok = _list_to_matrix(batch.column("embedding"), dim)
        keep = ok & np.asarray(batch.column("id").is_valid().to_numpy(zero_copy_only=False)) & np.isfinite(x).all(axis=1)
        ids.append(batch.column("id").filter(pa.array(keep)))
        mats.append(x if keep.all() else x[keep])
    names, mat = pa.concat_arrays(ids), np.concatenate(mats)
    del mats
    order = np.empty(len(names), np.int64)
    order[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    kept = _without_spare_copies(mat, order, k)
    if len(kept) < len(mat):
        names, order, mat = names.take(pa.array(kept)), order[kept], mat[kept]
    if metric == "cosine":
        mat = _unit(mat)
    return _Rows(names, order, mat, [_tile(mat[at:at + TILE_ROWS], at, metric) for at in range(0, len(mat), TILE_ROWS)])


def _screen(q: np.ndarray, bound: np.ndarray, tile: _Tile, metric: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Factors whose single-precision product with ``tile.low`` scores the pairs, each query's least score of
    a row within its bound, and the bound of the product's error that is taken off it."""
    if metric == "l2":  # |q - x|^2 = |q|^2 - 2 (q.x - |x|^2 / 2), about the centre
        q = q - tile.centre
        norms = np.einsum("ij,ij->i", q, q)
        size = np.maximum(np.sqrt(norms), tile.size)
        low = np.concatenate([q / size[:, None], (tile.size / size)[:, None]], axis=1)
        least = (norms - bound * (1.0 + 1e-8)) / (2.0 * size * tile.size)
    else:
        size = np.sqrt(np.einsum("ij,ij->i", q, q))
        size[size == 0] = 1.0
        low = q / size[:, None]
        least = (1.0 - bound - 2.0 * 10.0**-DISTANCE_DECIMALS) / (size * tile.size)
    error = 1.5 * (low.shape[1] + 8) * 2.0**-23  # sums of factors of at most 1 and 1.5, each rounded
    return low.astype(np.float32), np.where(np.isnan(least), -np.inf, least - error), error


def nearest(block: _Block, rows: _Rows, metric: str, k: int, qid_type: pa.DataType, id_type: pa.DataType
            ) -> Iterator[pa.RecordBatch]:
    """Each query's ``k`` nearest of ``rows`` within its bound, ``QUERY_ROWS`` queries a batch."""

    def cut(who: list, what: list, far: list, most: np.ndarray) -> tuple[list, list, list]:
        i, j, d = np.concatenate(who), np.concatenate(what), np.concatenate(far)
        by = np.lexsort((rows.order[j], d, i))
        place = _places(i[by])
        last = by[place == k - 1]
        most[i[last]] = np.minimum(most[i[last]], d[last])
        by = by[place < k]
        return [i[by]], [j[by]], [d[by]]

    for at in range(0, len(block.mat), QUERY_ROWS):
        q, most = block.mat[at:at + QUERY_ROWS], block.bound[at:at + QUERY_ROWS].copy()
        who, what, far, held, limit = [], [], [], 0, HELD_PAIRS
        for tile in rows.tiles:
            own = np.flatnonzero(_near(q, most, tile.centre, tile.radius, metric))
            if not len(own):
                continue
            low, least, error = _screen(q[own], most[own], tile, metric)
            score = low @ tile.low
            free = np.flatnonzero(np.isinf(most[own]))
            if len(free) and score.shape[1] > k:  # no bound yet: not worse than the k-th of the tile
                least[free] = np.partition(score[free], -k, axis=1)[:, -k] - 2.0 * error
            hit = np.flatnonzero(score >= least.astype(np.float32)[:, None])
            i, j = np.divmod(hit, score.shape[1])
            i, j = own[i], j + tile.at
            d = resolved(_pair_distances(q, rows.mat, i, j, metric), metric)
            fine = np.flatnonzero((d <= most[i]) & np.isfinite(d))
            if not len(fine):
                continue
            who.append(i[fine]), what.append(j[fine]), far.append(d[fine])
            held += len(fine)
            if len(free) or held > limit:
                who, what, far = cut(who, what, far, most)
                held = len(who[0])
                limit = held + HELD_PAIRS
        if held:
            (i,), (j,), (d,) = cut(who, what, far, most)
            yield pa.RecordBatch.from_arrays(
                [block.ids.take(pa.array(at + i)).cast(qid_type), rows.ids.take(pa.array(j)).cast(id_type), pa.array(d, pa.float64())],
                names=["query_id", "id", "distance"])


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)


def _pack_queries(metric: str, dim: int, rows_per_block: int, qid_type: pa.DataType):
    """Query rows with their bounds -> blocks ``(ids, mat, bounds)`` of at most ``rows_per_block`` queries, packed by the tasks that
    hold them. Vectors that cannot be ranked (wrong length, null, not finite) are left out; a zero vector
    is at cosine distance 1 from every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mat, ok = _list_to_matrix(batch.column(1), dim)
            ok = ok & np.asarray(batch.column(0).is_valid().to_numpy(zero_copy_only=False)) & np.isfinite(mat).all(axis=1)
            bound = batch.column(2).to_numpy(zero_copy_only=False)
            if metric == "cosine":
                nrm = np.sqrt(np.einsum("ij,ij->i", mat, mat))
                mat = mat / np.where(nrm > 0, nrm, 1.0)[:, None]
            ids, mat, bound = batch.column(0).filter(pa.array(ok)), mat[ok], bound[ok].astype(np.float64)
            for at in range(0, len(mat), rows_per_block):
                some = ids.slice(at, rows_per_block)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.cast(qid_type)),
                     pa.array([np.ascontiguousarray(mat[at:at + rows_per_block]).tobytes()], pa.binary()),
                     pa.array([bound[at:at + rows_per_block].tobytes()], pa.binary())], ["ids", "mat", "bounds"])

    return run


def _read_blocks(folder: str, dim: int, with_cells: bool = False) -> Iterator:
    """The packed query blocks of the shared folder, one after the other; ``with_cells`` with the cells that
    each of their queries probes (``operators.ann``)."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    from vellum.sources.markdown import store_of

    store, base = store_of(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))
    for path in files:
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                for at, (ids, mat, bound) in enumerate(zip(batch.column("ids"), batch.column("mat"), batch.column("bounds"))):
                    block = _Block(ids=ids.values, mat=np.frombuffer(mat.as_py(), np.float64).reshape(len(ids.values), dim),
                                   bound=np.frombuffer(bound.as_py(), np.float64))
                    if with_cells:
                        cells = np.frombuffer(batch.column("cells")[at].as_py(), np.uint16)
                        yield block, cells.reshape(len(block.mat), -1)
                    else:
                        yield block


def _tiled(folder: str, metric: str, k: int, dim: int, qid_type: pa.DataType, id_type: pa.DataType, held_bytes: int):
    """Corpus batches are held up to a bounded size; every query block is read and ranked against what is
    held, so the corpus is scanned once whatever the number of queries."""

    def rank(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = corpus_rows(held, dim, metric, k)
        held.clear()
        for block in _read_blocks(folder, dim):
            yield from nearest(block, rows, metric, k, qid_type, id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= held_bytes:
                yield from rank(held)
                held, size = [], 0
        if held:
            yield from rank(held)

    return run


def knn_candidates(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    *,
    dim: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vec_col: str = "embedding",
    max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Per-task top-k candidates ``(query_id, id, distance)`` for every query; not yet final. ``bounds(query_id,
    bound)``, one row a query id, are distances beyond which a query needs no row, where they are known
    already; else the sample of the corpus gives them."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")
    if k <= 0:
        raise ValueError("k must be positive")
    spark = corpus.sparkSession
    from vellum.session import shared_path, ship_package

    ship_package(spark)
    q = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).alias("qvec")).where(
        F.col("qvec").isNotNull() & (F.size("qvec") == dim))
    qid_type = _arrow_type(q, "query_id")
    c = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")).where(F.size("embedding") == dim)
    id_type = _arrow_type(c, "id")
    qid_sql = q.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qid_sql}, id {c.schema['id'].dataType.simpleString()}, distance double"
    rows_per_block = max(1, max_block_bytes // (dim * 8))

    def packed(rows: DataFrame) -> str:
        # The executors write the query vectors in blocks to the shared folder and read them there, block
        # by block: neither the driver nor a broadcast ever holds the query table.
        folder = shared_path(spark, "knn", "queries", unique=True)
        rows.mapInArrow(_pack_queries(metric, dim, rows_per_block, qid_type),
                        f"ids array<{qid_sql}>, mat binary, bounds binary").write.parquet(folder)
        return folder

    def ranked(rows: DataFrame, folder: str) -> DataFrame:
        return rows.mapInArrow(_tiled(folder, metric, k, dim, qid_type, id_type, max_block_bytes // 4), schema)

    if bounds is None:
        seeds = packed(q.withColumn("bound", F.lit(float("inf"))))
        near = final_topk(ranked(c.where(F.pmod(F.xxhash64("id"), F.lit(SEED_RATE)) == 0), seeds), k)
        bounds = near.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    bounds = bounds.withColumnRenamed("query_id", "seeded")
    bounded = q.join(bounds, q.query_id == bounds.seeded, "left").select(
        "query_id", "qvec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return ranked(c, packed(bounded))


def final_topk(cands: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, distance)`` keeping the k best per query under (distance, id)."""
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        cands.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")
    )


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    *,
    dim: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vec_col: str = "embedding",
    where: Column | None = None,
    max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Exact batch top-k: ``(query_id, rank, id, distance)``; ``where`` filters the corpus first. Given ``bounds``
    are to hold for what it leaves."""
    if where is not None:
        corpus = corpus.where(where)
    cands = knn_candidates(
        corpus, queries, k, metric, dim=dim, id_col=id_col, vec_col=vec_col, query_id_col=query_id_col,
        query_vec_col=query_vec_col, max_block_bytes=max_block_bytes, bounds=bounds,
    )
    return final_topk(cands, k)


def knn_expression(
    corpus: DataFrame, query_vector: list[float], k: int = 5, metric: str = "cosine", *, id_col: str = "id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Single-vector top-k with the JVM distance expression (the semantic yardstick):
    ``(rank, id, distance)`` via ``TakeOrderedAndProject``."""
    from vellum.functions.vectors import distance

    q = F.array(*[F.lit(float(v)) for v in query_vector])
    scored = corpus.select(F.col(id_col).alias("id"), distance(F.col(vec_col), q, metric).alias("distance")).where(
        F.col("distance").isNotNull()
    )
    scored = scored.withColumn("distance", resolved_column(F.col("distance"), metric))
    top = scored.orderBy("distance", "id").limit(k)
    w = Window.orderBy("distance", "id")
    return top.select(F.row_number().over(w).cast("int").alias("rank"), "id", "distance")
