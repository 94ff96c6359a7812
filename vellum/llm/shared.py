"""Helpers the operators share: materialised steps in the shared folder, connected components, and
bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import ensure_checkpoint_dir, shared_path, ship_package


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the Python workers and the shared folder known."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``df`` has (in any case) already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: lineage is cut, a lost
    executor loses nothing, and a later join sees plain scans whose skewed partitions AQE can split."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", name, unique=True)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` values sum to about ``max_bytes`` (one row at
    least), so that per-slice work arrays stay bounded whatever the batch size."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n + 16
    if start < batch.num_rows:
        yield batch.slice(start)


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 50) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, root)`` for every node of an edge; ``root`` is the smallest
    node reachable. Alternates large-star and small-star steps (every node is tied to the smallest
    neighbour seen); each round is written out, so the plan does not grow, and minima are written
    apart, so that a node with very many neighbours is a join whose partitions can be split.
    Null, self and repeated edges are ignored; no edges give an empty result."""
    e = materialise(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")

    def signature(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    last = signature(e)
    for i in range(max_rounds):
        if not last[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        low = materialise(both.groupBy("x").agg(F.min("y").alias("m"))
                          .select("x", F.least("x", "m").alias("m")), f"{name}-low{i}")
        large = materialise(both.join(low, "x").where("y > x and y <> m")
                            .select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large{i}")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small{i}")
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")).distinct())
        e = materialise(small, f"{name}-round{i}")
        now = signature(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(n: int, a, b):
    """Smallest index reachable for each of ``n`` items linked by index arrays ``a``, ``b`` (numpy
    label propagation with pointer jumping)."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
