"""Embedding stage (J3): the encoder contract, batch encoding with retry and per-row fallback,
a second-model fallback on the failed subset, a read-through cache keyed by md5(model:text),
dimension validation and discovery.

Encoders plug in through :class:`Encoder`. Two ship with the package:

* :class:`HashEncoder` - deterministic bag-of-words hash vectors computed in the JVM plus one
  vectorised Arrow step (test double with an SQL oracle).
* :class:`BatchEncoder` - wraps any Python ``encode_batch(list[str]) -> list[list[float]]``
  (a local model, an inference client) as an Arrow UDF; the model is built once per Python
  worker by a factory, texts are sent in batches, a failing batch is retried and then split into
  rows, and every row carries ``status`` / ``attempts`` instead of raising.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import hashing
from vellum.functions import vectors as vx

# ---------------------------------------------------------------------------------------------
# Encode batch size, attempts per call and delay between attempts.
DEFAULT_BATCH_SIZE = 32
DEFAULT_MAX_RETRIES = 3
DEFAULT_RETRY_DELAY = 1.0
# ---------------------------------------------------------------------------------------------

EMBED_RESULT = "struct<embedding:array<float>,status:string,attempts:int>"


class Encoder:
    """Contract: a name, a dimension and a Column transform text -> ARRAY<FLOAT> result struct."""

    name: str
    dim: int

    def result(self, text: Column) -> Column:
        """STRUCT<embedding ARRAY<FLOAT>, status STRING, attempts INT>."""
        raise NotImplementedError


class HashEncoder(Encoder):
    def __init__(self, dim: int = 256, name: str | None = None):
        self.dim = dim
        self.name = name or f"hash-{dim}"

    def vector(self, text: Column) -> Column:
        return hashing.hash_embedding(text, self.dim)

    def result(self, text: Column) -> Column:
        v = self.vector(text)
        return F.struct(
            v.alias("embedding"),
            F.when(v.isNull(), F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
            F.lit(1).alias("attempts"),
        )


_MODELS: dict[tuple[str, str], Callable[[list[str]], list[list[float]]]] = {}


def worker_model(name: str, version: str, factory: Callable) -> Callable:
    """The model of this Python worker, loaded at its first use. Called by import, so the dictionary is
    the worker's own and not a copy sent with each task."""
    if (name, version) not in _MODELS:
        _MODELS[name, version] = factory()
    return _MODELS[name, version]


class BatchEncoder(Encoder):
    """A Python model behind an Arrow UDF. ``factory()`` returns ``encode_batch``; it runs once per
    Python worker process and the result is reused by every batch that worker sees."""

    def __init__(
        self,
        name: str,
        dim: int,
        factory: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
        batch_size: int = DEFAULT_BATCH_SIZE,
        max_retries: int = DEFAULT_MAX_RETRIES,
        retry_delay: float = DEFAULT_RETRY_DELAY,
    ):
        self.name, self.dim, self.factory = name, dim, factory
        self.version = uuid.uuid4().hex  # models of one name do not mix
        self.batch_size, self.max_retries, self.retry_delay = batch_size, max_retries, retry_delay

    def _udf(self):
        name, dim, factory, version = self.name, self.dim, self.factory, self.version
        batch_size, max_retries, delay = self.batch_size, self.max_retries, self.retry_delay

        def call(fn, texts):
            last = None
            for attempt in range(1, max_retries + 1):
                try:
                    out = fn(texts)
                    if len(out) != len(texts):
                        raise ValueError("encoder returned a different number of vectors")
                    return out, attempt, None
                except Exception as e:  # noqa: BLE001 - any model failure is retried
                    last = e
                    if attempt < max_retries and delay > 0:
                        time.sleep(delay)
            return None, max_retries, last

        @F.arrow_udf(EMBED_RESULT)
        def encode(texts: pa.Array) -> pa.Array:
            fn = worker_model(name, version, factory)
            values = texts.to_pylist()
            emb: list = [None] * len(values)
            status: list = ["failed"] * len(values)
            attempts: list = [0] * len(values)
            for s in range(0, len(values), batch_size):
                idx = [i for i in range(s, min(s + batch_size, len(values))) if values[i] is not None]
                if not idx:
                    continue
                out, n, _ = call(fn, [values[i] for i in idx])
                if out is None:
                    # Batch failed on every attempt: fall back to one text at a time.
                    for i in idx:
                        one, m, _ = call(fn, [values[i]])
                        attempts[i] = n + m
                        if one is not None:
                            emb[i] = np.asarray(one[0], np.float32)
                            status[i] = "ok"
                    continue
                for j, i in enumerate(idx):
                    emb[i] = np.asarray(out[j], np.float32)
                    status[i], attempts[i] = "ok", n
            for i, v in enumerate(emb):
                if v is not None and (len(v) == 0 or len(v) != dim):
                    status[i] = "empty_vector" if len(v) == 0 else "bad_dimension"
            return pa.StructArray.from_arrays(
                [pa.array(emb, type=pa.list_(pa.float32())), pa.array(status, type=pa.string()),
                 pa.array(attempts, type=pa.int32())],
                names=["embedding", "status", "attempts"],
            )

        return encode.asNondeterministic()

    def result(self, text: Column) -> Column:
        return self._udf()(text)


def python_hash_encoder(dim: int = 256, name: str | None = None) -> BatchEncoder:
    """The hash encoder written as a Python model (same vectors as :class:`HashEncoder`)."""

    def factory():
        from functools import lru_cache

        import regex

        splitter = regex.compile(r"[^\p{L}\p{N}_]+")

        @lru_cache(maxsize=1 << 16)  # words come again; long ones are not held
        def bucket_of_word(tok: str) -> int:
            return hashing.bucket_of(tok, dim)

        def encode_batch(texts: list[str]) -> list[np.ndarray]:
            out = []
            for t in texts:
                at = [bucket_of_word(tok) if len(tok) <= 64 else hashing.bucket_of(tok, dim)
                      for tok in splitter.split(t.lower()) if tok]
                v = np.bincount(np.array(at, np.int64), minlength=dim).astype(np.float64)
                n = np.sqrt((v * v).sum())
                out.append((v / n if n > 0 else v).astype(np.float32))
            return out

        return encode_batch

    return BatchEncoder(name or f"hash-{dim}", dim, factory, retry_delay=0.0)


def failing_encoder(base: BatchEncoder, fails: Callable[[str], bool], name: str | None = None) -> BatchEncoder:
    """``base`` except that any call containing a text for which ``fails(text)`` raises."""
    base_factory = base.factory

    def factory():
        inner = base_factory()

        def encode_batch(texts):
            if any(fails(t) for t in texts):
                raise RuntimeError("encoder unavailable for this input")
            return inner(texts)

        return encode_batch

    return BatchEncoder(name or f"{base.name}-flaky", base.dim, factory, base.batch_size, base.max_retries, 0.0)


# --- choice by name (E11) -------------------------------------------------------------------------

_ENCODERS: dict[str, Encoder] = {"hash": HashEncoder()}


def register_encoder(name: str, encoder: Encoder) -> None:
    """Make ``encoder`` known under ``name``, for jobs that are given names."""
    _ENCODERS[name] = encoder


def encoder_named(encoder: Encoder | str | None) -> Encoder | None:
    """An encoder itself, or the one registered under a name; an unknown name raises."""
    if not isinstance(encoder, str):
        return encoder
    if encoder not in _ENCODERS:
        raise ValueError(f"unknown encoder {encoder!r}; registered: {sorted(_ENCODERS)}")
    return _ENCODERS[encoder]


def embed(df: DataFrame, encoder: Encoder, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """Adds ``out_col``, ``embed_status``, ``embed_attempts``, ``embed_model``."""
    r = encoder.result(F.col(text_col))
    return (
        df.withColumn("_er", r)
        .withColumn(out_col, F.col("_er.embedding"))
        .withColumn("embed_status", F.col("_er.status"))
        .withColumn("embed_attempts", F.col("_er.attempts"))
        .withColumn("embed_model", F.lit(encoder.name))
        .drop("_er")
    )


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder (encoders may call
    services; their output must not be recomputed when it is read twice or a task is retried)."""
    from vellum.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def embed_with_fallback(
    df: DataFrame, primary: Encoder, fallback: Encoder | None, text_col: str = "text", out_col: str = "embedding",
    dim: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Primary encoder first; rows it fails go to ``fallback``. Returns ``(ok, rejects)``; rows still
    without a valid vector of ``dim`` (default: the primary's) end in ``rejects``."""
    dim = dim or primary.dim
    first = materialize(embed(df, primary, text_col, out_col))
    done = first.where(F.col("embed_status") == "ok")
    failed = first.where(F.col("embed_status") != "ok")
    if fallback is not None:
        retried = materialize(embed(failed.drop(out_col, "embed_status", "embed_attempts", "embed_model"), fallback,
                                    text_col, out_col))
        allrows = done.unionByName(retried)
    else:
        allrows = first
    valid = (F.col("embed_status") == "ok") & vx.is_valid_vector(F.col(out_col), dim)
    ok = allrows.where(valid)
    rejects = allrows.where(~valid).withColumn(
        "reason", F.coalesce(F.when(F.col("embed_status") != "ok", F.col("embed_status")),
                             vx.invalid_reason(F.col(out_col), dim))
    )
    return ok, rejects


# --- cache (E6, E9, S9) ---------------------------------------------------------------------------

CACHE_SCHEMA = "cache_key string, model string, text_hash string, embedding array<float>, ts timestamp"


def cache_key(model: str | Column, text: Column) -> Column:
    m = F.lit(model) if isinstance(model, str) else model
    return F.md5(F.concat_ws(":", m, text))


def cache_lookup(df: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``df`` + ``cache_key`` + ``cached`` (ARRAY<FLOAT> or NULL). Empty cached vectors are misses.
    Joins on the fixed-width md5 key; each distinct key is looked up once."""
    keyed = df.withColumn("cache_key", cache_key(model, F.col(text_col)))
    entries = (
        cache.where((F.col("model") == model) & (F.size("embedding") > 0))
        .groupBy("cache_key").agg(F.first("embedding", ignorenulls=True).alias("cached"))
    )
    return keyed.join(entries, "cache_key", "left")


def cached_embed(
    df: DataFrame, encoder: Encoder, cache: DataFrame, text_col: str = "text", out_col: str = "embedding",
    fallback: Encoder | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read-through cache. Returns ``(rows with out_col, embed_source and embed_model, new cache entries)``.

    Only distinct missing texts are encoded, by ``encoder`` and, where it fails, by ``fallback``; results
    are joined back on the key (so row order and duplicates of the input do not matter). Vectors of the
    fallback are not kept: the encoder gets the text again next time."""
    # Rows and keys are read twice below, for the misses and for the result; how they came to be may be costly.
    df = materialize(df)
    looked = cache_lookup(df, cache, encoder.name, text_col)
    # What the cache lacks is found by keys alone; vectors are joined to the rows only once.
    asked = df.where(F.col(text_col).isNotNull()).select(
        cache_key(encoder.name, F.col(text_col)).alias("cache_key"), F.col(text_col).alias("_t"))
    held = cache.where((F.col("model") == encoder.name) & (F.size("embedding") > 0)).select("cache_key")
    misses = asked.join(held, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    ok, _ = embed_with_fallback(misses, encoder, fallback, "_t", "_computed")
    new_entries = ok.where(F.col("embed_model") == encoder.name).select(
        "cache_key", F.lit(encoder.name).alias("model"), F.md5("_t").alias("text_hash"),
        F.col("_computed").alias("embedding"), F.current_timestamp().alias("ts"),
    )
    out = looked.join(ok.select("cache_key", "_computed", F.col("embed_model").alias("_model")), "cache_key", "left").select(
        *[c for c in looked.columns if c != "cached"],
        F.coalesce("cached", "_computed").alias(out_col),
        F.when(F.col("cached").isNotNull(), F.lit("cache")).when(F.col("_computed").isNotNull(), F.lit("computed"))
        .otherwise(F.lit("failed")).alias("embed_source"),
        F.when(F.col("cached").isNotNull(), F.lit(encoder.name)).otherwise(F.col("_model")).alias("embed_model"),
    )
    return out, new_entries


def embedding_dimension(df: DataFrame, col: str = "embedding") -> int | None:
    """Length of the first non-empty vector (E8); ``None`` for an empty table."""
    row = df.select(F.size(col).alias("n")).where(F.col("n") > 0).limit(1).first()
    return None if row is None else int(row["n"])
