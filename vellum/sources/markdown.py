"""Markdown corpus scans (S1-S3).

The scan is complete by default: folders are listed level by level, each level a Spark job over the
folders that the one before found, so that neither the driver nor one task lists a whole tree; tasks
read the files, through the file system of the root's scheme, with names that start with ``.`` or ``_``
and empty files too; a missing root is an error. ``strict=False`` reads with Spark's ``binaryFile`` source instead, for stores that only Spark
reaches: its listing skips such names, and the source drops zero-length files.

Bytes that are not valid UTF-8 make the file a reject (``try_validate_utf8``), not a failed job;
``\\r\\n`` and ``\\r`` become ``\\n`` (universal newlines).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Markdown extensions, compared lower-cased.
MARKDOWN_PATTERN = "\\.(md|markdown)$"
# Names that Hadoop gives to schemes pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
MAX_DEPTH = 256  # folders below one another; more means a link that leads back


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's scheme and the folder's path in it."""
    if "://" in root:
        scheme, rest = root.split("://", 1)
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:"))


def _decode(content) -> tuple:
    text = F.try_validate_utf8(content.cast("string"))
    return text, F.regexp_replace(text, "\\r\\n?", "\n")


def list_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``(path, modification_time, length)`` of every markdown file below ``root`` (no content)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "modificationTime", "length")
    )
    return files.where(F.lower("path").rlike(MARKDOWN_PATTERN)).select(
        "path", F.col("modificationTime").alias("modification_time"), "length")


def scan_markdown(spark: SparkSession, root: str, strict: bool = True, partitions: int | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """Returns ``(documents, rejects)``; documents ``(source_file, modification_time, text)``. A file to which
    the store gives no date has the time of the scan."""
    if strict:
        raw = read_files(list_files(spark, root, partitions), root, partitions)
    else:
        raw = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .where(F.lower("path").rlike(MARKDOWN_PATTERN))
            .select("path", F.col("modificationTime").alias("modification_time"), "content")
        )
    return decoded(raw)


def decoded(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw(path, modification_time, content)`` -> ``(documents, rejects)``. Files that are not UTF-8 are
    rejects, and so are those that were gone when they were to be read (null content)."""
    raw_text, text = _decode(F.col("content"))
    docs_all = raw.select(
        F.regexp_replace("path", "^file:", "").alias("source_file"), "modification_time",
        text.alias("text"), F.when(F.col("content").isNull(), F.lit("missing_file"))
        .when(raw_text.isNull(), F.lit("invalid_utf8")).alias("_bad"))
    docs = docs_all.where(F.col("_bad").isNull()).drop("_bad")
    rejects = docs_all.where(F.col("_bad").isNotNull()).select(
        F.lit("scan").alias("stage"), F.col("source_file").alias("key"), F.col("_bad").alias("reason"),
        F.lit(None).cast("string").alias("payload"))
    return docs, rejects


def list_files(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """``(path, modification_time)`` of every markdown file below ``root``, hidden, '_' and empty ones too;
    paths are those of the root's store. The driver names the root and no entry below it: every round
    lists the folders of one level in tasks and keeps what it found in the shared folder."""
    from vellum.operators.embed import materialize

    store, base = store_of(root)
    if store.get_file_info(base).type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    most = partitions or spark.sparkContext.defaultParallelism * 4

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = store_of(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = own.get_file_info(fs.FileSelector(folder))
                for at in range(0, len(found), 10_000):
                    some = [(e.path, e.type == fs.FileType.Directory, e.mtime_ns and e.mtime_ns // 1000) for e in found[at:at + 10_000]]
                    paths, dirs, times = zip(*some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(paths, pa.string()), pa.array(dirs, pa.bool_()), pa.array(times, pa.timestamp("us", tz="UTC"))],
                        ["path", "is_dir", "modification_time"])

    folders, levels = spark.createDataFrame([(base,)], "path string"), []
    for _ in range(MAX_DEPTH):
        found = materialize(folders.mapInArrow(entries, "path string, is_dir boolean, modification_time timestamp"))
        levels.append(found.where(~F.col("is_dir") & F.lower("path").rlike(MARKDOWN_PATTERN)))
        n = found.where("is_dir").count()
        if not n:
            break
        folders = found.where("is_dir").select("path").repartition(min(n, most))
    else:
        raise ValueError(f"more than {MAX_DEPTH} folders below one another under {root}")
    files = levels[0]
    for more in levels[1:]:
        files = files.union(more)
    return files.select("path", F.coalesce("modification_time", F.current_timestamp()).alias("modification_time"))


def read_files(files: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """``files(path, modification_time)`` as ``list_files`` gives them -> ``(path, modification_time, content)``,
    read by tasks; the path has the root's scheme, and the content of a file that is gone is null."""
    _, base = store_of(root)
    remote = "://" in root and not root.startswith("file:")
    scheme, rest = root.split("://", 1) if remote else ("", "")
    prefix = f"{scheme}://{rest.split('/', 1)[0] if base.startswith('/') else ''}" if remote else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = store_of(root)

        def content(path: str) -> bytes | None:
            try:
                with own.open_input_stream(path) as f:
                    return f.read()
            except FileNotFoundError:
                return None

        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                paths = some.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([prefix + path for path in paths], pa.string()), some.column(1),
                     pa.array([content(path) for path in paths], pa.binary())],
                    names=["path", "modification_time", "content"])

    spread = files.repartition(partitions or files.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(read, "path string, modification_time timestamp, content binary")
