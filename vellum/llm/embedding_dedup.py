"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one node with a count. In each pass every node gets 62 signs of random projections
as one key; the nodes are sorted by it, lexicographically, and each is compared with its ``window``
next neighbours. Pairs with cosine (in doubles) of ``threshold`` or more link; the links of all passes
are united.

Nodes that share the first ``depth`` signs of a pass are a block, and all pairs of a block are compared:
one of up to ``window`` + 1 nodes lies whole in one partition and its windows hold all its pairs; a
larger one, as a dense region gives, is cut into tiles of bounded size, and pairs of tiles are separate
work. So a pair meets in a pass whenever it shares the first ``depth`` signs, however many other nodes
do. Two vectors right at the threshold share a sign with probability p = 1 - angle / pi, and passes are
added until some pass has them in one block with probability ``recall``; this does not depend on how
the vectors are spread. ``depth`` is log2(nodes / window) or more: the blocks of trial passes are
counted at several depths, and the one with the least work over all its passes is taken.

The passes move no vectors in doubles: keys are sorted out first, and only two bytes a component (each
vector scaled to its largest component and rounded) travel to the windows and tiles. The rounding can
change a cosine by a bound that follows from the codes' lengths. Pairs above the threshold by more than
it link at once; those within it that are not joined yet are few, and are compared in doubles.

A class larger than the window has links that no window holds. They are found exactly: all members of
each class are compared in tiles of bounded size, pairs of tiles being separate work, and only counts
leave them, so the direct links within a class are complete whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import connected_components, local_roots, materialise, prepare

SIGNS = 62
#: Passes counted to choose the depth, and what a row costs in a pass besides its comparisons, in comparisons.
TRIALS, ROW = 2, 512
FULL = 32767  # the code of a vector's largest component


def depth_for(n: int, window: int) -> int:
    """Signs that leave a window of rows to a block, were the rows spread evenly."""
    return min(SIGNS, math.ceil(math.log2(max(1.0, n / window))))


def passes_at(depth: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has shared its first ``depth`` signs with probability
    ``recall``."""
    met = (1 - math.acos(threshold) / math.pi) ** depth
    return max(2, math.ceil(math.log(1 - recall) / math.log1p(-met))) if met < 1 else 2


def passes_for(n: int, window: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``, at the least depth."""
    return passes_at(depth_for(n, window), threshold, recall)


def crowding(keyed: DataFrame, depths: list[int], window: int) -> dict[int, float]:
    """Depth -> pairs within the blocks of more than ``window`` + 1 rows; rows of ``(pass, dim, key)``."""
    last = max(depths)
    fine = keyed.groupBy("pass", "dim", F.shiftright("key", SIGNS - last).alias("fine")).agg(F.count("*").alias("n"))
    at = fine.select("pass", "dim", "n", "fine", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    blocks = at.groupBy("pass", "dim", "depth", F.expr(f"shiftright(fine, {last} - depth)").alias("prefix")).agg(
        F.sum("n").cast("double").alias("n"))
    pairs = blocks.where(F.col("n") > window + 1).groupBy("depth").agg(F.sum(F.col("n") * F.col("n") / 2))
    return dict(map(tuple, pairs.collect()))  # a row a depth


def depth_of_least_work(n: int, window: int, threshold: float, recall: float, crowd: dict[int, float], depths: list[int]) -> int:
    """The depth with the fewest comparisons over all its passes; ``crowd`` has the pairs in large
    blocks of one pass."""
    return min(depths, key=lambda d: passes_at(d, threshold, recall) * (n * (window + ROW) + crowd.get(d, 0.0)))


def unit_rows(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def as_code(x: np.ndarray) -> bytes:
    """A vector whose largest component is 1 (or -1), rounded to two bytes a component."""
    return np.rint(x * FULL).astype("<i2").tobytes()


def unit_codes(codes: list[bytes]) -> tuple[np.ndarray, float]:
    """Unit rows of codes, and a bound of the change that rounding made to the cosine of any two. Each
    component is off by half a step at most, so a row by sqrt(dim) / 2, and unit vectors are no farther
    apart than that over the shorter length."""
    x = np.frombuffer(b"".join(codes), "<i2").reshape(len(codes), -1).astype(float)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    off = math.sqrt(x.shape[1]) / 2
    return x / length[:, None], 2 * off / (length.min() - off) + 1e-12


def forest(node: np.ndarray, a: list, b: list, cosine: list, threshold: float, slack: float) -> tuple:
    """``(u, v, sure)``: a spanning forest of the pairs ``a``, ``b`` that link whatever the rounding did, and
    the pairs left open that it does not join."""
    a, b, cosine = np.concatenate(a), np.concatenate(b), np.concatenate(cosine)
    sure = cosine >= threshold + slack
    root = local_roots(len(node), a[sure], b[sure])
    own = np.flatnonzero(root != np.arange(len(node)))
    a, b = a[~sure], b[~sure]
    apart = root[a] != root[b]
    a, b = a[apart], b[apart]
    return (np.concatenate((node[own], node[a])), np.concatenate((node[root[own]], node[b])),
            np.arange(len(own) + len(a)) < len(own))


def in_tiles(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Each row with its ``tile`` out of ``tiles``, once for every pair ``low <= high`` of tiles it is in."""
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return rows.select(*group, *columns, "tile", other.alias("with")).select(
        *group, F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", *columns)


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95, window: int = 128, recall: float = 0.995,
                         tile: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row: ``n_links`` other rows linked directly,
    ``component_id`` the smallest id reachable over links, itself included, ``kept`` whether it is the
    row's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing (0, their
    own id, kept); vectors of different length do not link. Repeated rows link with each other. A row
    without an id never names a component; it is kept only if its component has no id at all. Other
    columns are not read. An empty table gives no rows."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(good, F.col("v")))
    nodes = (rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
             .withColumn("node", F.monotonically_increasing_id()))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scaled by the largest component, so that no square over- or underflows."""
        for batch in batches:
            data, code = [], []
            for v in batch.column(3).to_pylist():
                x = np.array(v, "<f8")
                x = x / np.abs(x).max()
                data.append(x.tobytes())
                code.append(as_code(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary()), pa.array(code, pa.binary())],
                                             ["node", "first_id", "copies", "data", "code"])

    # Node numbers are fixed once they are written.
    nodes = materialise(nodes, "vectors-nodes")
    packed = materialise(nodes.select("node", "first_id", "copies", "v").mapInArrow(
        as_bytes, "node long, first_id long, copies long, data binary, code binary"), "vectors-packed")
    n_nodes = packed.count()
    least = depth_for(n_nodes, window)
    depths = list(range(least, min(SIGNS, least + 24) + 1, 2))

    def keys(passes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                sizes = np.array([len(d) // 8 for d in data])
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    unit = unit_rows([data[i] for i in at.tolist()])
                    for p in range(passes):
                        planes = np.random.default_rng([11, dim, p]).standard_normal((dim, SIGNS))
                        key = (unit @ planes > 0) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p] * len(at), pa.int32()), pa.array([dim] * len(at), pa.int32()), pa.array(key),
                             pa.array(node[at])], ["pass", "dim", "key", "node"])

        return packed.select("node", "data").mapInArrow(run, "pass int, dim int, key long, node long")

    crowd = {d: pairs / TRIALS for d, pairs in crowding(keys(TRIALS), depths, window).items()}
    depth = depth_of_least_work(n_nodes, window, threshold, recall, crowd, depths)
    block = ["pass", "dim", "prefix"]
    keyed = keys(passes_at(depth, threshold, recall)).withColumn("prefix", F.shiftright("key", SIGNS - depth))
    keyed = materialise(keyed, "vectors-keys")
    large = materialise(keyed.groupBy(*block).agg(F.count("*").alias("size")).where(F.col("size") > window + 1), "vectors-large")
    # Keys alone are sorted out and written; the codes join them on the way to the windows and tiles.
    placed = materialise(keyed.join(large, block, "left"), "vectors-placed")
    codes = packed.select("node", "code")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows -> the links inside windows."""
        held: list[tuple] = []

        def links(run: list[tuple]) -> pa.RecordBatch:
            unit, slack = unit_codes([d for _, _, _, d in run])
            node = np.array([n for _, _, n, _ in run])
            a, b, cosine = [], [], []
            for i in range(0, len(run), 512):
                block = unit[i:i + 512] @ unit[i:i + 512 + window].T
                x, y = np.nonzero(block >= threshold - slack)
                ok = (y > x) & (y - x <= window)
                x, y = x[ok], y[ok]
                a.append(x + i)
                b.append(y + i)
                cosine.append(block[x, y])
            return pa.RecordBatch.from_arrays(list(map(pa.array, forest(node, a, b, cosine, threshold, slack))),
                                              ["u", "v", "sure"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                if held and held[-1][:2] != row[:2]:
                    yield links(held)
                    held = []
                held.append(row)
                if len(held) >= 1 << 14:  # the last window of rows stays for the next run
                    yield links(held)
                    held = held[-window:]
        if held:
            yield links(held)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        """The links of two tiles with each other (of one tile: among themselves)."""
        node = group.node.to_numpy()
        at, other = np.flatnonzero(group.tile == group.low), np.flatnonzero(group.tile == group.high)
        unit, slack = unit_codes(group.code.tolist())
        cosine = unit[at] @ unit[other].T
        x, y = np.nonzero(cosine >= threshold - slack)
        u, v, sure = forest(node, [at[x]], [other[y]], [cosine[x, y]], threshold, slack)
        return pd.DataFrame({"u": u, "v": v, "sure": sure})

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that link by their cosine in doubles."""
        for batch in batches:
            data = [batch.column(i).to_pylist() for i in (2, 3)]
            sizes = np.array([len(d) for d in data[0]])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                one, other = (unit_rows([d[i] for i in at.tolist()]) for d in data)
                yield batch.select([0, 1]).take(pa.array(at[np.einsum("ij,ij->i", one, other) >= threshold]))

    # Blocks that fit a window are never cut: their rows are equal in all columns of the range.
    is_large = F.col("size").isNotNull()
    ordered = (placed.join(codes, "node")
               .withColumn("cut_key", F.when(is_large, F.col("key"))).withColumn("cut_node", F.when(is_large, F.col("node")))
               .repartitionByRange(*block, "cut_key", "cut_node").sortWithinPartitions("pass", "dim", "key", "node"))
    near = ordered.select("pass", "dim", "key", "node", "code").mapInArrow(windows, "u long, v long, sure boolean")
    tiled = placed.where(is_large).withColumn("tiles", F.ceil(F.col("size") / F.lit(tile)).cast("int"))
    tiled = in_tiles(tiled, block, ["node"]).join(codes, "node")
    crowded = tiled.groupBy(*block, "low", "high").applyInPandas(meet, "u long, v long, sure boolean")
    found = materialise(near.unionByName(crowded), "vectors-found")
    ends = packed.select("node", "data")
    still = (found.where("not sure").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
             .join(ends.toDF("u", "a"), "u").join(ends.toDF("v", "b"), "v"))
    edges = found.where("sure").select("u", "v").unionByName(
        still.select("u", "v", "a", "b").mapInArrow(exactly, "u long, v long"))
    roots = materialise(connected_components(edges, "vectors-cc"), "vectors-roots")

    # All direct links inside each class, tile against tile.
    member = materialise(roots.join(packed.drop("code"), "node"), "vectors-members")
    sizes = materialise(member.groupBy("root").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"),
                                                   F.min("first_id").alias("component_id")), "vectors-classes")
    placed = in_tiles(member.join(sizes, "root"), ["root"], ["node", "copies", "data"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        """Links of the members of two tiles with each other (of one tile: among themselves)."""
        low, high = group.low.iat[0], group.high.iat[0]
        a = group[group.tile == low]
        b = a if low == high else group[group.tile == high]
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": []}).astype("int64")
        ua = unit_rows(a.data.tolist())
        ub = ua if b is a else unit_rows(b.data.tolist())
        linked = ua @ ub.T >= threshold
        if b is a:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"node": a.node.to_numpy(), "links": linked @ a.copies.to_numpy()})
        return pd.DataFrame({"node": np.concatenate((a.node, b.node)), "links": np.concatenate(
            (linked @ b.copies.to_numpy(), linked.T @ a.copies.to_numpy()))})

    direct = (placed.groupBy("root", "low", "high").applyInPandas(count, "node long, links long")
              .groupBy("node").agg(F.sum("links").alias("links")))
    named = member.select("node", "root").join(sizes.select("root", "component_id"), "root").select("node", "component_id")
    per_node = (nodes.join(direct, "node", "left").join(named, "node", "left")
                .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component_id", "first_id").alias("component_id")))
    per_node = materialise(per_node, "vectors-result")
    linked = rows.where("v is not null").join(per_node, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(alone).withColumn("kept", kept)
