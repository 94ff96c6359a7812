"""Deterministic bag-of-words hash encoder (a test double for a real embedding model).

Lower-case, split on non-word characters, drop empty tokens; each token goes to bucket
``int(first 8 hex digits of md5(token), 16) mod dim``. The vector is the per-bucket token count,
L2-normalised. Tokenising is a JVM expression (one string a text goes to Python); a vectorised Arrow UDF hashes each
distinct token of a batch once and counts with one ``bincount`` per batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import WORD_CHARS


# Plain word characters one by one: Java looks these up in a table and tries the properties for others only.
PLAIN_WORD = "".join(chr(cp) for cp in range(128) if chr(cp).isalnum()) + "_"


def tokens(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), f"[^{WORD_CHARS}]+"), lambda w: w != "")


def joined_tokens(text: Column) -> Column:
    """The tokens of ``tokens`` in one string with a space between them, and maybe one at either end."""
    return F.regexp_replace(F.lower(text), f"[^{PLAIN_WORD}{WORD_CHARS}]++", " ")


def token_bucket(token: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def bucket_of(token: str, dim: int) -> int:
    """``token_bucket`` of one token in Python."""
    return int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:4], "big") % dim


def buckets_of(tokens: list[bytes], dim: int) -> np.ndarray:
    """``bucket_of`` of many tokens in UTF-8."""
    return np.frombuffer(b"".join([hashlib.md5(t).digest()[:4] for t in tokens]), ">u4").astype(np.int64) % dim


def buckets(text: Column | str, dim: int) -> Column:
    """ARRAY<INT> of bucket ids, one per token (duplicates kept)."""
    return F.transform(tokens(text), lambda w: token_bucket(w, dim))


def _densify(dim: int):
    @F.arrow_udf("array<float>")
    def densify(bk: pa.Array) -> pa.Array:
        # bk: the tokens of each text, joined. Count (row, bucket) pairs with one bincount, then L2-normalise rows.
        if isinstance(bk, pa.ChunkedArray):
            bk = bk.combine_chunks()
        n = len(bk)
        if n == 0:
            return pa.array([], type=pa.list_(pa.float32()))
        parts = pc.split_pattern(bk.fill_null("") if bk.null_count else bk, " ")
        words = parts.flatten().dictionary_encode()
        # Empty strings, left by a space at an end, are no tokens: they go to a bucket of their own, left out below.
        distinct = words.dictionary
        bucket = buckets_of(distinct.cast(pa.large_binary()).to_pylist(), dim)
        bucket[pc.equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)] = dim
        flat = bucket[words.indices.to_numpy(zero_copy_only=False)]
        rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(parts.offsets.to_numpy()))
        counts = np.bincount(rows * (dim + 1) + flat, minlength=n * (dim + 1)).reshape(n, dim + 1)[:, :dim].astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1))
        dense = np.divide(counts, norms[:, None], out=np.zeros_like(counts), where=norms[:, None] > 0)
        values = pa.array(dense.astype(np.float32).ravel(), type=pa.float32())
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), values)
        if bk.null_count:
            out = pa.ListArray.from_arrays(out.offsets, out.values, mask=bk.is_null())
        return out

    return densify


def hash_embedding(text: Column | str, dim: int = 256) -> Column:
    """ARRAY<FLOAT> hash-encoder vector of ``text`` (all-zero when it has no tokens)."""
    t = F.col(text) if isinstance(text, str) else text
    return _densify(dim)(joined_tokens(t))


def sparse_weights(df, id_col: str, text: Column, dim: int):
    """Long form ``(id, bucket, weight)`` of the hash vectors, non-zero buckets only, computed with
    JVM expressions and one aggregation (partial counts before the shuffle on ``(id, bucket)``).
    Weights are rounded to float32 exactly as the dense vectors are."""
    from pyspark.sql import Window

    b = df.select(F.col(id_col).alias("_id"), F.explode(buckets(text, dim)).alias("bucket"))
    cnt = b.groupBy("_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("_id")))
    return cnt.select(F.col("_id").alias(id_col), "bucket",
                      (F.col("n") / norm).cast("float").alias("weight"))
