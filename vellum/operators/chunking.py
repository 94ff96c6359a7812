"""Documents -> overlapping chunks (T1) with the per-chunk metadata of T2/T4/T7."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx


def chunk_documents(
    docs: DataFrame,
    text_col: str = "text",
    size: int = tx.DEFAULT_CHUNK_SIZE,
    overlap: int = tx.DEFAULT_CHUNK_OVERLAP,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per window: ``keep`` columns + ``chunk_index INT, total_chunks INT, chunk STRING``.

    Narrow (no shuffle): ``posexplode_outer`` over an array built by ``transform(sequence(...))``.
    Documents are skewed in length, so callers that do heavy per-chunk work afterwards should
    ``repartition`` the output (see ``plans.ingest``).
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != "chunk"]
    # The windows are a column of their own before they are counted and exploded: an expression used
    # twice in one select would be evaluated again above the explode, once per chunk. (There is
    # always a window; the outer form spares the filter Spark would put below for empty arrays.)
    cut = docs.select(*keep, tx.chunk_array(F.col(text_col), size, overlap).alias("_windows"))
    counted = cut.select(*keep, F.size("_windows").cast("int").alias("total_chunks"), "_windows")
    return counted.select(*keep, "total_chunks", F.posexplode_outer("_windows").alias("chunk_index", "chunk")).select(*keep, F.col("chunk_index").cast("int").alias("chunk_index"), "total_chunks", "chunk")
