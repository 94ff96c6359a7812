"""Import job (J1-J3 + S5): documents -> chunks with metadata -> vectors -> collection rows.

Narrow until the embed step: the scan, the chunk ``posexplode`` and every metadata expression
run in the scan's tasks. Documents are skewed in length, so before an expensive encoder the
chunks can be rebalanced with one round-robin ``repartition`` (``rebalance``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions import vectors as vx
from vellum.operators import embed as em
from vellum.operators.chunking import chunk_documents
from vellum.operators.collection import add_documents, one_row_join
from vellum.sources.cache import EmbeddingCache
from vellum.sources.snapshot import CollectionStore

COLLECTION_COLUMNS = ["id", "text", "embedding", "source_file", "doc_title", "chunk_index", "total_chunks",
                      "creation_date", "tags", "metadata"]


def chunk_id(source_file, chunk_index, chunk) -> F.Column:
    """Deterministic content id: re-importing an unchanged file yields the same ids (D15)."""
    return F.md5(F.concat_ws(":", source_file, chunk_index.cast("string"), chunk))


def chunk_corpus(docs: DataFrame, size: int = tx.DEFAULT_CHUNK_SIZE, overlap: int = tx.DEFAULT_CHUNK_OVERLAP,
                 tags_scope: str = "chunk") -> DataFrame:
    """``docs(source_file, text[, modification_time])`` -> chunk rows with promoted metadata.

    Title is computed on the whole document. Tags follow the source's per-chunk reading by default
    (frontmatter tags only reach the first chunk); ``tags_scope='document'`` gives every chunk the
    document's tags."""
    if tags_scope not in ("chunk", "document"):
        raise ValueError("tags_scope must be 'chunk' or 'document'")
    mtime = F.col("modification_time") if "modification_time" in docs.columns else F.lit(None).cast("timestamp")
    base = docs.select(
        "source_file", "text", mtime.alias("creation_date"),
        tx.doc_title(F.col("text"), F.col("source_file")).alias("doc_title"),
        *([tx.extract_tags(F.col("text")).alias("doc_tags")] if tags_scope == "document" else []),
    )
    keep = ["source_file", "creation_date", "doc_title"] + (["doc_tags"] if tags_scope == "document" else [])
    ch = chunk_documents(base, "text", size, overlap, keep=keep)
    tags = F.col("doc_tags") if tags_scope == "document" else tx.extract_tags(F.col("chunk"))
    return ch.select(
        chunk_id(F.col("source_file"), F.col("chunk_index"), F.col("chunk")).alias("id"),
        F.col("chunk").alias("text"), "source_file", "doc_title", "chunk_index", "total_chunks", "creation_date",
        tags.alias("tags"),
    )


def encoder_input(text_col: str = "text", task: str = "document") -> F.Column:
    """Cleaned text with the task prefix, as sent to the encoder (documents are cleaned, queries not)."""
    t = tx.preprocess_text(F.col(text_col)) if task == "document" else F.col(text_col)
    return tx.task_prefix(t, task)


def metadata_object() -> F.Column:
    """VARIANT object of the promoted metadata (lists stay lists; timestamps as ISO text)."""
    return F.to_variant_object(F.struct(
        "source_file", "doc_title", "chunk_index", "total_chunks",
        F.date_format("creation_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("creation_date"),
        "tags",
    ))


def _rejects(bad: DataFrame, reason) -> DataFrame:
    return bad.select(F.lit("embed").alias("stage"), F.col("id").alias("key"), reason.alias("reason"),
                      F.col("text").alias("payload"))


def embed_chunks(chunks: DataFrame, encoder: em.Encoder | str, fallback: em.Encoder | str | None = None,
                 rebalance: int | None = None, cache: EmbeddingCache | None = None,
                 postprocess_dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors for chunk rows -> ``(collection rows, rejects)``.

    The whole job: cleaned text with its prefix -> cache -> encoder -> fallback for what it failed ->
    post-processing to ``postprocess_dim`` values -> rejects. Encoders are given themselves or by their
    registered name. The hash encoder alone runs in place; everything else is written once, so no
    model is called again when rows and rejects are both read. New vectors are added to ``cache``."""
    encoder, fallback = em.encoder_named(encoder), em.encoder_named(fallback)
    src = chunks.repartition(rebalance) if rebalance else chunks
    src = src.withColumn("_input", encoder_input("text"))
    if cache is not None:
        looked, new = em.cached_embed(src, encoder, cache.read(), "_input", fallback=fallback)
        done = em.materialize(looked)  # before the new entries are part of the cache
        cache.append(new)
        valid = vx.is_valid_vector("embedding", encoder.dim)
        reason = F.when(F.col("embedding").isNull(), F.lit("failed")).otherwise(vx.invalid_reason("embedding", encoder.dim))
        rows, rejects = done.where(valid), _rejects(done.where(~valid), reason)
    elif isinstance(encoder, em.HashEncoder) and fallback is None:
        # Cleaned text is never null and always has a hash vector: nothing to reject, and a filter here would
        # be pushed down as a second cleaning of every chunk.
        rows = src.withColumn("embedding", encoder.vector(F.col("_input")))
        rejects = _rejects(chunks.limit(0), F.lit("failed"))
    else:
        rows, bad = em.embed_with_fallback(src, encoder, fallback, "_input", "embedding")
        rejects = _rejects(bad, F.col("reason"))
    if postprocess_dim:
        rows = rows.withColumn("embedding", vx.postprocess("embedding", postprocess_dim).cast("array<float>"))
    return rows.withColumn("metadata", metadata_object()).select(*COLLECTION_COLUMNS), rejects


def ingest_documents(docs: DataFrame, encoder: em.Encoder | str, size: int = tx.DEFAULT_CHUNK_SIZE,
                     overlap: int = tx.DEFAULT_CHUNK_OVERLAP, tags_scope: str = "chunk",
                     fallback: em.Encoder | str | None = None, rebalance: int | None = None,
                     cache: EmbeddingCache | None = None,
                     postprocess_dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs(source_file, text[, modification_time])`` -> ``(collection rows, rejects)``."""
    return embed_chunks(chunk_corpus(docs, size, overlap, tags_scope), encoder, fallback, rebalance, cache, postprocess_dim)


def import_documents(store: CollectionStore, docs: DataFrame, encoder: em.Encoder | str, **job) -> DataFrame:
    """Import ``docs`` into ``store`` (ids that it has are left alone) and return one row of counts:
    documents, chunks, embedded, rejected, written, mean chunk length. ``job`` goes to ``ingest_documents``."""
    rows, rejects = ingest_documents(docs, encoder, **job)
    if isinstance(em.encoder_named(encoder), em.HashEncoder) and not job.get("fallback") and job.get("cache") is None:
        rows = em.materialize(rows)  # computed in place; those of every other job are written already
    current = store.read() if store.segments() else rows.limit(0)
    segment = store.append(add_documents(current, rows, store.dimension).added)
    chunks = rows.select("source_file", "text").withColumn("ok", F.lit(1)).unionByName(
        rejects.select(F.lit(None).cast("string").alias("source_file"), F.col("payload").alias("text"), F.lit(0).alias("ok")))
    counts = chunks.agg(F.count("*").alias("n_chunks"), F.sum("ok").alias("n_embedded"),
                        F.sum(1 - F.col("ok")).alias("n_rejected"),
                        F.round(F.avg(F.length("text")), 4).alias("avg_chunk_chars"))
    files = docs.agg(F.countDistinct("source_file").alias("n_documents"))
    written = store.segment(segment).agg(F.count("*").alias("n_written"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("n_documents", "n_chunks", "n_embedded", "n_rejected", "n_written")]
    return one_row_join(files, counts, written).select(*zero, "avg_chunk_chars")
