"""Derived inputs: the driver's tables reshaped into what each operator consumes.

Every derivation here is a plain projection of a whole table (no row subsets). The oracle SQL in
``vellum.plans.oracle`` builds the same columns with the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True) -> DataFrame:
    """Read a driver table. When the scan yields fewer splits than the cluster has cores (one big
    row group, as in the test files), spread the rows with one round-robin exchange so per-row text
    work is parallel; a table that already has enough splits is read as is (no exchange)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if balance:
        return balanced(df)
    return df


def balanced(df: DataFrame) -> DataFrame:
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as markdown: ``(doc_id, source_file, lang, source, n_chars, content)``.

    en: frontmatter tags + '# <source> <doc_id>' header + text + inline '#<lang>'
    fr: text + inline '#<lang>'                     (title from the first line)
    de: 'tags: []' frontmatter + an empty '#  ' header + text  (empty title, one empty tag)
    es: frontmatter without tags + text             (title from the first line: '---')
    """
    d = table(spark, sf_dir, "documents")
    nl = F.lit("\n")
    en = F.concat(F.lit("---\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\n---\n# "), "source", F.lit(" "),
                  F.col("doc_id").cast("string"), nl, "text", F.lit(" #"), "lang")
    fr = F.concat("text", F.lit(" #"), "lang")
    de = F.concat(F.lit("---\ntags: []\n---\n#  \n"), "text")
    es = F.concat(F.lit("---\ntitle: x\n---\n"), "text")
    content = (F.when(F.col("lang") == "en", en).when(F.col("lang") == "fr", fr)
               .when(F.col("lang") == "de", de).otherwise(es))
    source_file = F.concat(F.lit("/corpus/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", source_file.alias("source_file"), "lang", "source", "n_chars", content.alias("content"))


def dirty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat("text", F.lit("..  $#@")).alias("text"))


def prefixed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish rows already carry a query prefix."""
    d = table(spark, sf_dir, "documents")
    t = F.when(F.col("lang") == "es", F.concat(F.lit("search_query: "), "text")).otherwise(F.col("text"))
    return d.select("doc_id", t.alias("text"))


def draft_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with one reflection token appended per turn: ``(conv_id, turn, role, response)``."""
    c = table(spark, sf_dir, "conversations")
    sel = (F.col("conv_id") * 7 + F.col("turn")) % 5
    token = (F.when(sel == 0, F.lit("[Retrieval]")).when(sel == 1, F.lit("[No Retrieval]"))
             .when(sel == 2, F.lit("[Continue to Use Evidence]")).when(sel == 3, F.lit(""))
             .otherwise(F.lit("[No Retrieval][Utility:3]")))
    return c.select("conv_id", "turn", "role", F.concat("text", token).alias("response"))


def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a collection: ``(id, text, embedding, label, metadata)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" label "),
                 F.col("label").cast("string")).alias("text"),
        "embedding",
        "label",
    )


def meta_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector collection with VARIANT metadata of four scalar types and a JSON-text list:
    zone (str) and weight (int) from the size of a component, score (float), flag (bool), and axes
    (JSON list as text) naming the components that are positive."""
    e = table(spark, sf_dir, "embeddings")
    lab = F.col("label")
    height = F.element_at("embedding", 3)
    axes = F.array_compact(F.array(*[F.when(F.element_at("embedding", 5 + i) > 0, F.lit(name)) for i, name in enumerate("xyz")]))
    meta = F.to_variant_object(F.struct(
        F.when(height > 0.05, "north").when(height < -0.05, "south").otherwise("level").alias("zone"),
        F.floor(F.abs(F.element_at("embedding", 4).cast("double")) * 20).cast("bigint").alias("weight"),
        F.round(F.element_at("embedding", 1).cast("double"), 4).alias("score"),
        (F.element_at("embedding", 2) > 0).alias("flag"),
        F.to_json(axes).alias("axes"),
    ))
    return e.select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" label "), lab.cast("string")).alias("text"),
        "embedding", "label", meta.alias("metadata"),
    )


def bad_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with label 3 cut to 3 values, label 7 missing, label 5 with a NaN first value, label 2 with
    an infinite one (of either sign)."""
    e = table(spark, sf_dir, "embeddings")
    emb = (F.when(F.col("label") == 3, F.slice("embedding", 1, 3))
           .when(F.col("label") == 7, F.lit(None).cast("array<float>"))
           .when(F.col("label") == 5, F.concat(F.array(F.lit(float("nan")).cast("float")),
                                                F.slice("embedding", 2, 1 << 20)))
           .when(F.col("label") == 2, F.concat(F.array(F.when(F.col("vec_id") % 2 == 0, float("inf")).otherwise(
               float("-inf")).cast("float")), F.slice("embedding", 2, 1 << 20)))
           .otherwise(F.col("embedding")))
    return e.select("vec_id", "label", emb.alias("embedding"))


def markdown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """markdown_docs in the shape the import job reads: ``(source_file, text)``."""
    return markdown_docs(spark, sf_dir).select("source_file", F.col("content").alias("text"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def file_name(source_file, source) -> F.Column:
    """The name a document gets on disk: hidden for src1, with '_' for src2, else its own."""
    mark = F.when(source == "src1", ".").when(source == "src2", "_").otherwise("")
    return F.concat(mark, F.regexp_extract(source_file, "([^/]*)$", 1))


# Time of change of the file of document 0; each next one is a minute younger, all far in the past.
FIRST_DATE = 1_577_836_800


def write_markdown_files(spark: SparkSession, sf_dir: str, root: str, where: str | None = None) -> str:
    """Write markdown_docs as one ``.md`` file per document below ``root`` (``<source>/<file_name>``), from
    the executors; ``root`` must be on a file system the executors share. Some names start with ``.`` or
    ``_``; beside each English document stand an empty file ``empty_<id>.md`` and a file ``bad_<id>.md`` that
    is not UTF-8. On a local store the times of change follow from the ids."""
    md = markdown_docs(spark, sf_dir)
    if where:
        md = md.where(where)

    def write(rows):
        import os

        from pyarrow import fs

        from vellum.sources.markdown import store_of

        store, base = store_of(root)
        made = set()
        for r in rows:
            d = f"{base}/{r['source']}"
            if d not in made:
                store.create_dir(d, recursive=True)
                made.add(d)
            odd = [(f"empty_{r['doc_id']}.md", b""), (f"bad_{r['doc_id']}.md", b"\xff\xfe")] if r["lang"] == "en" else []
            for name, content in [(r["name"], r["content"].encode("utf-8")), *odd]:
                with store.open_output_stream(f"{d}/{name}") as f:
                    f.write(content)
                if isinstance(store, fs.LocalFileSystem):
                    os.utime(f"{d}/{name}", (FIRST_DATE + 60 * r["doc_id"],) * 2)

    name = file_name(F.col("source_file"), F.col("source"))
    md.select("doc_id", "source", "lang", name.alias("name"), "content").foreachPartition(write)
    return root
