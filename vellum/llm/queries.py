"""The registered queries of the operators: each applies its operator, with production parameters, to
its whole table. ``SQL`` has DuckDB text where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import (
    embedding_dedup,
    line_dedup,
    merkle,
    packing,
    pii,
    quality,
    sentencepiece_rounds,
    simhash,
    spelling,
    token_counts,
    token_files,
    topk,
    toxicity,
)


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; the files are installed beside the libraries on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir), shingle=3, max_bits=2)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = packing.token_lengths(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"))
    return packing.pack(lengths, capacities=(1024, 2048, 4096))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), min_sites=3, removed_col="n_removed").select(
        "doc_id", "n_removed", "text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(embeddings(spark, sf_dir), k=10, every=100)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_rounds.round_trip(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.toxicity(documents(spark, sf_dir), labels)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(embeddings(spark, sf_dir), threshold=0.95)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir), min_length=7, min_count=2, ratio=10, struck=31)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.quality_rules(documents(spark, sf_dir), labels)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_topk": op5_topk,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_token_files": op9_token_files,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_merkle": op11_merkle,
    "op12_spelling": op12_spelling,
    "op13_quality": op13_quality,
}

SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_topk": topk.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_spelling": spelling.oracle_sql(),
}
