"""Embedding cache table (S9): a Parquet table bucketed by key, appended by each run.

Rows: ``cache_key = md5(model ':' text)``, ``model``, ``text_hash = md5(text)``, ``embedding``, ``ts``.
Layout under the cache's folder::

    v000001/    files of the live table, each of one bucket of ``cache_key``
    _CURRENT    live version and number of buckets (fixed for the cache's life)

The session's catalog holds the table as an external one over the live folder, so the bucketing outlives
the session that wrote it, and a lookup joins on the key without moving the cache: only the texts asked for
are shuffled, to the cache's buckets. Appends add files (no rewrite). Rows whose vector is empty are misses
(``operators.embed.cache_lookup``), and so are the entries of a file that cannot be read. Keys that
concurrent appends repeat are harmless: lookups take one vector per key, and ``compact`` keeps the newest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.embed import CACHE_SCHEMA
from vellum.sources import fs

COLUMNS = ["cache_key", "model", "text_hash", "embedding", "ts"]
BUCKETS = 32


class EmbeddingCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """``buckets`` counts for a new cache only; choose it so that a bucket fits a task."""
        self.spark, self.path, self._new_buckets = spark, path.rstrip("/"), buckets

    def _current(self) -> tuple[str, int] | None:
        text = fs.read_text(self.spark, f"{self.path}/_CURRENT")
        return (text.split()[0], int(text.split()[1])) if text else None

    def _table(self, version: str, buckets: int) -> str:
        folder = f"{self.path}/{version}"
        name = f"vellum_cache_{hashlib.md5(folder.encode()).hexdigest()}"
        quoted = folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({CACHE_SCHEMA}) USING parquet OPTIONS (ignoreCorruptFiles 'true') "
                       f"CLUSTERED BY (cache_key) INTO {buckets} BUCKETS LOCATION '{quoted}'")
        return name

    def read(self) -> DataFrame:
        live = self._current()
        if live is None:
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        name = self._table(*live)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _write(self, entries: DataFrame, version: str, buckets: int) -> None:
        name = self._table(version, buckets)
        # Rows of one bucket meet in one task, so that an append adds at most one file a bucket.
        entries.select(*COLUMNS).repartition(buckets, "cache_key").write.insertInto(name)

    def append(self, entries: DataFrame) -> None:
        live = self._current()
        version, buckets = live or ("v000001", self._new_buckets)
        self._write(entries, version, buckets)
        if live is None:
            fs.write_text(self.spark, f"{self.path}/_CURRENT", f"{version} {buckets}")

    def compact(self) -> None:
        """Rewrite the cache with one row a key, its newest vector that is not empty, and make that live. The
        aggregation runs inside the buckets. Entries without a vector end; appends that run meanwhile are lost
        to the new version (their texts are encoded again)."""
        live = self._current()
        if live is None:
            return
        version = f"v{int(live[0][1:]) + 1:06d}"
        row = F.struct(*[c for c in COLUMNS if c != "cache_key"])
        newest = self.read().where(F.size("embedding") > 0).groupBy("cache_key").agg(F.max_by(row, "ts").alias("r"))
        self._write(newest.select("cache_key", "r.*"), version, live[1])
        fs.write_text(self.spark, f"{self.path}/_CURRENT", f"{version} {live[1]}")
