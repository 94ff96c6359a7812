"""Incremental import (S6): new markdown files in a folder -> chunks -> vectors -> appended to a
collection, with Structured Streaming.

A file source of Spark skips names that start with ``.`` or ``_`` and empty files. Here the stream reads
a log of files instead: each run lists the folder level by level as Spark jobs (``list_files``), appends
the files that the log does not have yet, and the stream (trigger ``availableNow``) takes the log's new
rows from its checkpoint on; tasks read the files they name. So every file is imported once, whatever
its name, size or age. Each micro-batch goes through the same import plan as a batch import and is
appended with ``add_documents`` semantics: chunk ids are content ids and rows whose id already exists are
skipped, so a micro-batch replayed after a failure (at-least-once ``foreachBatch``) does not duplicate
anything; a run that ended before its stream did leaves its files in the log for the next one.

A micro-batch takes ``FILES_PER_BATCH`` files at most. What they held and the rows made of it are written
once each, compressed, and deleted when the batch is in the store, so what the import needs beside the
store does not grow with the folder; only ids are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import embed as em
from vellum.operators.collection import add_documents
from vellum.plans.ingest import ingest_documents
from vellum.sources import fs
from vellum.sources.markdown import decoded, list_files, read_files
from vellum.sources.snapshot import CollectionStore

LOG_SCHEMA = "path string, modification_time timestamp"
FILES_PER_BATCH = 250_000


def log_new_files(spark: SparkSession, root: str, log: str, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Append the markdown files below ``root`` that ``log`` does not have; nothing is written if there are
    none. A log file, the unit of a micro-batch, names ``files_per_batch`` files at most."""
    files = list_files(spark, root)
    if fs.exists(spark, log):
        files = files.join(spark.read.schema(LOG_SCHEMA).parquet(log).select("path"), "path", "left_anti")
    files = em.materialize(files.select("path", "modification_time"))
    n = files.count()
    if n:
        parts = min(64, -(-n // files_per_batch))
        files.repartition(parts).write.mode("append").option("maxRecordsPerFile", files_per_batch).parquet(log)


def file_stream(spark: SparkSession, log: str) -> DataFrame:
    """The rows of the log as a stream; each log file is a micro-batch."""
    reader = spark.readStream.schema(LOG_SCHEMA).option("maxFileAge", "36500d")
    return reader.option("maxFilesPerTrigger", "1").parquet(log)


def run_incremental_import(spark: SparkSession, root: str, store: CollectionStore, checkpoint: str,
                           encoder: em.Encoder | None = None, chunk_size: int = 500, chunk_overlap: int = 50,
                           files_per_batch: int | None = None) -> dict:
    """Import every file not yet seen; returns counts before/after, per-batch additions and the number of
    files that are not UTF-8 or were gone, whose ``(stage, key, reason)`` rows are kept below
    ``<checkpoint>/rejects``. The log of files is ``<checkpoint>/files``; ``files_per_batch`` defaults to
    ``FILES_PER_BATCH``."""
    encoder = encoder or em.HashEncoder(store.dimension)
    before = store.read().count()
    added: list[int] = []
    rejected: list[int] = []
    log = f"{checkpoint}/files"
    log_new_files(spark, root, log, files_per_batch or FILES_PER_BATCH)
    if not fs.exists(spark, log):  # the folder has no markdown file yet
        return {"before": before, "after": before, "batches": [], "rejected": 0}

    def batch(files: DataFrame, epoch_id: int) -> None:
        own = f"{checkpoint}/batch"  # one batch runs at a time; one that failed is written anew

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{own}/{name}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{own}/{name}")

        docs, bad = decoded(written(read_files(files, root), "read"))
        bad = em.materialize(bad.select("stage", "key", "reason"))
        rejected.append(bad.count())
        if rejected[-1]:  # one folder per batch: a replayed batch writes the same rows again
            bad.write.mode("overwrite").parquet(f"{checkpoint}/rejects/batch={epoch_id}")
        rows, _ = ingest_documents(docs, encoder, chunk_size, chunk_overlap)
        rows = written(rows, "rows")
        current = store.read() if store.segments() else rows.limit(0)
        new_rows = add_documents(current, rows, store.dimension).added
        added.append(0 if new_rows.isEmpty() else store.segment(store.append(new_rows)).count())
        fs.delete(spark, own)

    q = (file_stream(spark, log).writeStream.foreachBatch(batch)
         .option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start())
    q.awaitTermination()
    return {"before": before, "after": store.read().count(), "batches": added, "rejected": sum(rejected)}
