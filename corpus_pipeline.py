"""The corpus pipeline: five stages over ``documents``, each one operator of ``vellum.llm``.

Toxic documents go; boilerplate lines go; one document of each near-duplicate group stays; personal data
is masked; what is left is packed into training sequences. A stage works on all rows that the stage
before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import line_dedup, packing, pii, simhash, toxicity
from vellum.llm.queries import tokenizer_file
from vellum.llm.shared import materialise, prepare


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier accepts; it learns from ``labels`` and the documents given."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.drop_toxic(docs, labels)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on three sources or more are left only at their first occurrence."""
    return line_dedup.dedup_lines(docs, min_sites=3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest id."""
    return simhash.keep_first(docs, shingle=3, max_bits=2)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the name of their kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their training sequence and place in it."""
    lengths = packing.token_lengths(docs, tokenizer_file("byte_bpe_50k.tiktoken"))
    return packing.pack(lengths, capacities=(1024, 2048, 4096))


STAGES = [
    ("toxicity", clean_documents),
    ("line_dedup", clean_lines),
    ("simhash", near_duplicates),
    ("pii", mask_personal_data),
    ("packing", packed),
]

# Trained scores, fingerprints and best-fit packing have no SQL form; tests hold the stages and run()
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each stage is written and reread for the next."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
