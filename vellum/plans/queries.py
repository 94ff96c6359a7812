"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per inventory item.

Each reads whole driver tables (or data Spark derives from them); outputs use plain scalar / string
columns with explicit names so the DuckDB oracle (``vellum.plans.oracle``) can be compared
column by column. Floating outputs are rounded to 4 decimals (+0.0 folds -0.0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import knn as knn_ops
from vellum.operators.chunking import chunk_documents
from vellum.plans import inputs

EMB_DIM = 64  # length of the driver's embedding vectors


def r4(c) -> F.Column:
    return (F.round(c, 4) + F.lit(0.0)).cast("double")


# --- text (J2) ------------------------------------------------------------------------------------


def q_chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents").select("doc_id", "text")
    ch = chunk_documents(docs, "text", 500, 50, keep=["doc_id"])
    return ch.select("doc_id", "chunk_index", "total_chunks", F.col("chunk").alias("text"))


CHUNK_SETTINGS = ((100, 20), (200, 50), (500, 50), (1000, 100))


def q_chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents").select("doc_id", "text")
    parts = []
    for size, overlap in CHUNK_SETTINGS:
        ch = chunk_documents(docs, "text", size, overlap, keep=["doc_id"])
        parts.append(ch.select(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), "doc_id",
                               F.length("chunk").alias("n")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("chunk_size", "chunk_overlap").agg(
        F.countDistinct("doc_id").alias("n_docs"),
        F.count("*").alias("n_chunks"),
        F.sum("n").alias("total_chars"),
        F.max("n").cast("bigint").alias("max_chunk_chars"),
    )


def q_doc_titles(spark: SparkSession, sf: str) -> DataFrame:
    md = inputs.markdown_docs(spark, sf)
    return md.select("doc_id", tx.doc_title("content", "source_file").alias("title"))


def q_extract_tags(spark: SparkSession, sf: str) -> DataFrame:
    md = inputs.markdown_docs(spark, sf)
    tags = tx.extract_tags("content")
    return md.select("doc_id", F.array_join(tags, "|").alias("tags"), F.size(tags).cast("int").alias("n_tags"))


def q_preprocess_text(spark: SparkSession, sf: str) -> DataFrame:
    d = inputs.dirty_docs(spark, sf)
    return d.select("doc_id", tx.preprocess_text("text").alias("clean"))


def q_task_prefix(spark: SparkSession, sf: str) -> DataFrame:
    d = inputs.prefixed_docs(spark, sf)
    return d.select("doc_id", tx.task_prefix("text", "document").alias("encoder_input"))


def q_text_preview(spark: SparkSession, sf: str) -> DataFrame:
    d = inputs.table(spark, sf, "documents")
    return d.select(
        "doc_id",
        tx.preview("text", 100).alias("preview"),
        tx.excerpt("text", 300).alias("excerpt_300"),
        tx.excerpt("text", 200).alias("excerpt_200"),
    )


# --- similarity search (J5) -----------------------------------------------------------------------


def _all_vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _knn_view(res: DataFrame) -> DataFrame:
    return res.select("query_id", "rank", "id", r4(F.col("distance")).alias("distance"))


def _knn_metric(metric: str, k: int = 5):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        coll = inputs.vector_collection(spark, sf)
        res = knn_ops.knn(coll, _all_vector_queries(spark, sf), k, metric, dim=EMB_DIM)
        return _knn_view(res)

    return run


def q_knn_l2_near(spark: SparkSession, sf: str) -> DataFrame:
    """The collection with three copies of each vector 1e-6, 2e-6 and 3e-6 away: the nearest first."""
    near = inputs.table(spark, sf, "embeddings").withColumn("step", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    v = F.col("embedding").cast("array<double>")
    moved = F.concat(F.array(F.element_at(v, 1) + F.col("step") * 1e-6), F.slice(v, 2, EMB_DIM))
    name = F.concat_ws(" ", F.lit("near"), "vec_id", "step")
    coll = inputs.vector_collection(spark, sf).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    corpus = coll.unionByName(near.select(name.alias("id"), moved.alias("embedding")))
    res = knn_ops.knn(corpus, _all_vector_queries(spark, sf), 4, "l2", dim=EMB_DIM)
    return res.select("query_id", "rank", "id")


def q_knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    corpus = inputs.table(spark, sf, "embeddings")
    res = knn_ops.knn(corpus, _all_vector_queries(spark, sf), 10, "cosine", dim=EMB_DIM, id_col="vec_id")
    return _knn_view(res)


# --- hash-encoded text search over the markdown chunk collection ----------------------------------

HASH_DIM = 256


def chunk_collection(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.embed import HashEncoder
    from vellum.plans.ingest import ingest_documents

    rows, _ = ingest_documents(inputs.markdown_corpus(spark, sf), HashEncoder(HASH_DIM))
    return rows


_STORED: dict[tuple, str] = {}


def stored_collection(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk collection as a store holds it: the documents are imported once in an application (again
    if the table has changed), and every search reads the stored rows."""
    from vellum.session import shared_path
    from vellum.sources import fs
    from vellum.sources.snapshot import CollectionStore

    docs = f"{sf.rstrip('/')}/documents.parquet"
    key = (spark.sparkContext.applicationId, docs, *fs.stamp(spark, docs))
    if key not in _STORED:
        root = shared_path(spark, "collections", unique=True)
        CollectionStore(spark, root, "chunks", HASH_DIM).commit(chunk_collection(spark, sf))
        _STORED[key] = root
    return CollectionStore(spark, _STORED[key], "chunks", create_if_missing=False).read()


def _text_search(spark: SparkSession, sf: str, k: int = 5, include=("distances",)) -> DataFrame:
    from vellum.operators.embed import HashEncoder
    from vellum.plans import search

    hits, _ = search.query_by_texts(stored_collection(spark, sf), inputs.benchmark_queries(spark, sf),
                                    HashEncoder(HASH_DIM), k, include=include)
    return hits


def q_query_with_model(spark: SparkSession, sf: str) -> DataFrame:
    """Every question through a Python model that refuses some of them: its best chunk, or the reason why
    it has none."""
    from vellum.operators.embed import failing_encoder, python_hash_encoder
    from vellum.plans import search

    encoder = failing_encoder(python_hash_encoder(HASH_DIM), fails_primary, name="questions")
    hits, status = search.query_by_texts(stored_collection(spark, sf), inputs.benchmark_queries(spark, sf), encoder, 1,
                                         include=("distances",))
    return status.join(hits, "query_id", "left").select("query_id", "status", "reason", "id", r4(F.col("distance")).alias("distance"))


def q_query_by_text(spark: SparkSession, sf: str) -> DataFrame:
    return _knn_view(_text_search(spark, sf))


def q_search_result_view(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.plans import search

    res = search.result_view(_text_search(spark, sf, include=search.INCLUDE_ALL))
    return res.select("query_id", "rank", "id", r4(F.col("similarity")).alias("similarity"), "title", "source",
                      "tags", "excerpt")


def q_knn_include(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.plans import search

    coll = inputs.vector_collection(spark, sf)
    res = search.query_similar(coll, _all_vector_queries(spark, sf), 5, "cosine", dim=EMB_DIM,
                               include=("documents", "metadatas"))
    return res.select("query_id", "rank", "id", "text", "label")


KNN_WHERE = {"$and": [{"label": {"$gte": 2}}, {"label": {"$lte": 6}}]}
KNN_WHERE_DOCUMENT = {"$not_contains": "label 4"}


def q_knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.plans import search

    coll = inputs.vector_collection(spark, sf)
    res = search.query_similar(coll, _all_vector_queries(spark, sf), 5, "cosine", dim=EMB_DIM, where=KNN_WHERE,
                               where_document=KNN_WHERE_DOCUMENT, include=("distances",))
    return _knn_view(res)


WHERE_CASES = {
    "eq_str": {"zone": "north"},
    "eq_int": {"weight": 2},
    "ne": {"zone": {"$ne": "south"}},
    "gt": {"score": {"$gt": 0.1}},
    "gte": {"weight": {"$gte": 3}},
    "lt": {"score": {"$lt": -0.1}},
    "lte": {"weight": {"$lte": 1}},
    "in": {"zone": {"$in": ["south", "level"]}},
    "nin": {"weight": {"$nin": [0, 4]}},
    "and": {"$and": [{"zone": "north"}, {"flag": True}]},
    "or": {"$or": [{"weight": 0}, {"score": {"$gt": 0.2}}]},
    "promoted": {"label": {"$in": [1, 2, 3]}},
    "int_on_float": {"score": {"$gt": 0}},
    "mixed_in": {"weight": {"$in": [1, 0.5, "2"]}},
    "text_on_int": {"weight": "2"},
    "int_on_bool": {"flag": 1},
    "dotted_key": {"no.such": 1},
    "absent_key": {"no_such_key": 1},
    "empty": {},
}


def _count_cases(df: DataFrame, preds: dict) -> DataFrame:
    """One scan: a conditional count per case, then unpivoted to ``(case_name, n_rows)``."""
    agg = df.agg(*[F.sum(F.when(F.lit(True) if p is None else p, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias(n)
                   for n, p in preds.items()])
    return agg.unpivot([], list(preds), "case_name", "n_rows")


def q_where_operators(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.functions.filters import compile_where

    coll = inputs.meta_collection(spark, sf)
    return _count_cases(coll, {n: compile_where(w, coll.columns) for n, w in WHERE_CASES.items()})


WHERE_DOCUMENT_CASES = {
    "contains": {"$contains": "the"},
    "not_contains": {"$not_contains": "le"},
    "and": {"$and": [{"$contains": "eau"}, {"$not_contains": "the"}]},
    "or": {"$or": [{"$contains": "und"}, {"$contains": "que"}]},
}


def q_where_document(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.functions.filters import compile_where_document

    d = inputs.table(spark, sf, "documents")
    return _count_cases(d, {n: compile_where_document(w) for n, w in WHERE_DOCUMENT_CASES.items()})


def q_knn_lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate search of every vector among all: recall of the ten nearest against exact search."""
    from vellum.operators.ann import CellIndex, recall
    from vellum.session import shared_path

    corpus = inputs.table(spark, sf, "embeddings")
    queries = _all_vector_queries(spark, sf)
    index = CellIndex.build(corpus, shared_path(spark, "ann", unique=True), EMB_DIM, "cosine", id_col="vec_id")
    found = index.search(queries, 10, index.probes_for(queries, 10, target=0.95))
    return recall(found, index.exact(queries, 10)).select(
        F.lit(10).alias("k"), "n_true", (F.col("recall") >= 0.9).alias("reached"))


# --- embedding (J3) -------------------------------------------------------------------------------


def q_embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.embed import HashEncoder
    from vellum.plans.ingest import encoder_input

    from vellum.functions.hashing import sparse_weights

    d = inputs.table(spark, sf, "documents")
    e = sparse_weights(d, "doc_id", encoder_input("text"), HashEncoder(HASH_DIM).dim)
    return e.select("doc_id", F.col("bucket").cast("int").alias("bucket"),
                    (F.round(F.col("weight").cast("double"), 6) + F.lit(0.0)).alias("weight"))


def q_embedding_postprocess(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.functions.vectors import postprocess

    e = inputs.table(spark, sf, "embeddings")
    p = e.select("vec_id", postprocess("embedding", 64).alias("v"))
    return p.select("vec_id", F.posexplode("v").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("int").alias("pos"), (F.round("x", 6) + F.lit(0.0)).alias("value"))


def q_validate_dimension(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.functions.vectors import invalid_reason, is_valid_vector

    b = inputs.bad_vectors(spark, sf)
    return b.select("vec_id", is_valid_vector("embedding", EMB_DIM).alias("is_valid"),
                    F.coalesce(invalid_reason("embedding", EMB_DIM), F.lit("ok")).alias("reason"))


def _checksum(v) -> F.Column:
    """sum(x_i * i) over 1-based positions, rounded to 4 decimals."""
    c = F.col(v) if isinstance(v, str) else v
    s = F.aggregate(F.transform(c, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return r4(s)


def _hash_chunks(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    from vellum.plans.ingest import chunk_corpus, encoder_input

    return chunk_corpus(inputs.markdown_corpus(spark, sf) if docs is None else docs).withColumn("_input", encoder_input("text"))


def q_embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.embed import embed, python_hash_encoder

    ch = _hash_chunks(spark, sf)
    out = embed(ch, python_hash_encoder(HASH_DIM), "_input")
    return out.select("id", "embed_status", F.size("embedding").cast("int").alias("dims"),
                      _checksum("embedding").alias("checksum"))


def fails_primary(text: str) -> bool:
    import hashlib

    return hashlib.md5(text.encode("utf-8")).hexdigest()[0] in "01"


def q_embed_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.embed import HashEncoder, embed_with_fallback, failing_encoder, python_hash_encoder

    ch = _hash_chunks(spark, sf)
    primary = failing_encoder(python_hash_encoder(HASH_DIM), fails_primary, name="primary")
    ok, rejects = embed_with_fallback(ch, primary, HashEncoder(HASH_DIM, name="fallback"), "_input")
    return ok.select("id", "embed_model", _checksum("embedding").alias("checksum"))


CACHE_MODEL = f"hash-{HASH_DIM}"


def _seed_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache entries for the chunk texts of English and French documents."""
    from vellum.operators.embed import HashEncoder, cache_key

    # Documents are picked before they are cut and cleaned: by file name, as chunks know no language.
    picked = inputs.markdown_docs(spark, sf).where(F.col("lang").isin("en", "fr")).select("source_file")
    ch = _hash_chunks(spark, sf, inputs.markdown_corpus(spark, sf).join(picked, "source_file", "left_semi"))
    ent = ch.select(F.col("_input").alias("t")).distinct()
    return ent.select(cache_key(CACHE_MODEL, F.col("t")).alias("cache_key"), F.lit(CACHE_MODEL).alias("model"),
                      F.md5("t").alias("text_hash"), HashEncoder(HASH_DIM).vector(F.col("t")).alias("embedding"),
                      F.current_timestamp().alias("ts"))


def q_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.embed import cache_lookup
    from vellum.session import shared_path
    from vellum.sources.cache import EmbeddingCache

    cache = EmbeddingCache(spark, shared_path(spark, "cache", unique=True))
    cache.append(_seed_cache(spark, sf))
    res = cache_lookup(_hash_chunks(spark, sf), cache.read(), CACHE_MODEL, "_input")
    return res.select("id", "cache_key", F.col("cached").isNotNull().alias("hit"))


def q_cache_populate(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.embed import HashEncoder, cached_embed
    from vellum.sources.cache import EmbeddingCache
    from vellum.session import shared_path

    cache = EmbeddingCache(spark, shared_path(spark, "cache", unique=True))
    cache.append(_seed_cache(spark, sf))
    out, new_entries = cached_embed(_hash_chunks(spark, sf), HashEncoder(HASH_DIM), cache.read(), "_input")
    cache.append(new_entries)
    return cache.read().select("cache_key", "model", "text_hash", F.size("embedding").cast("int").alias("dims"),
                               _checksum("embedding").alias("checksum"))


# --- collection upkeep (J4) -----------------------------------------------------------------------


def _meta_cols() -> list:
    m = F.col("metadata")
    return [
        F.try_variant_get(m, "$.zone", "string").alias("zone"),
        F.try_variant_get(m, "$.weight", "bigint").alias("weight"),
    ]


def _store(spark: SparkSession, name: str, dim: int = EMB_DIM):
    from vellum.session import shared_path
    from vellum.sources.snapshot import CollectionStore

    return CollectionStore(spark, shared_path(spark, "collections", unique=True), name, dim, "cosine")


def q_collection_open(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.sources.snapshot import CollectionStore

    store = _store(spark, "test_collection")
    store.commit(inputs.meta_collection(spark, sf))
    reopened = CollectionStore(spark, store.path.rsplit("/", 1)[0], "test_collection", create_if_missing=False)
    return reopened.read().select("id", "label", F.lit(reopened.dimension).alias("dimension"),
                                  F.lit(reopened.metric).alias("metric"))


def q_add_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Collection of labels < 5, then an add of every vector in which labels 3/5/7 are invalid."""
    from vellum.operators.collection import add_documents

    coll = inputs.meta_collection(spark, sf)
    current = coll.where(F.col("label") < 5)
    bad = inputs.bad_vectors(spark, sf).select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("bad_emb"))
    new = coll.join(bad, "id").withColumn("embedding", F.col("bad_emb")).drop("bad_emb")
    res = add_documents(current, new, EMB_DIM)
    return res.collection.select("id", "label", F.size("embedding").cast("int").alias("dims"))


def q_get_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.collection import get_by_ids

    coll = inputs.meta_collection(spark, sf)
    e = inputs.table(spark, sf, "embeddings")
    ids = e.select(F.when(F.col("label").isin(1, 2), F.concat(F.lit("vec_"), F.col("vec_id").cast("string")))
                   .otherwise(F.concat(F.lit("missing_"), F.col("vec_id").cast("string"))).alias("id"))
    return get_by_ids(coll, ids).select("id", "text", "label", *_meta_cols())


def q_delete_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.collection import delete_by_ids

    coll = inputs.meta_collection(spark, sf)
    e = inputs.table(spark, sf, "embeddings")
    ids = e.select(F.when(F.col("label") == 0, F.concat(F.lit("vec_"), F.col("vec_id").cast("string")))
                   .otherwise(F.concat(F.lit("ghost_"), F.col("vec_id").cast("string"))).alias("id"))
    once = delete_by_ids(coll, ids)
    twice = delete_by_ids(once, ids)
    return twice.select("id", "label")


def _updates(coll: DataFrame) -> DataFrame:
    """The updates of ``update_merge``, from one scan."""
    lab, second = F.col("label"), F.col("seq") == 2
    rows = coll.where(lab.isin(4, 6, 8)).withColumn("seq", F.explode(F.when(lab == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(
        F.when(lab == 6, F.concat(F.lit("ghost_"), F.col("id"))).otherwise(F.col("id")).alias("id"),
        F.when(second, F.concat(F.lit("updated again "), F.col("id"))).when(lab == 4, F.concat(F.lit("updated "), F.col("id"))).alias("text"),
        F.when(lab == 8, F.parse_json(F.lit("{}")))
        .when(second, F.to_variant_object(F.struct((lab + 100).cast("bigint").alias("label"))))
        .otherwise(F.to_variant_object(F.struct(F.lit("updated").alias("zone"),
                                                (lab * 10).cast("bigint").alias("new_field")))).alias("metadata"),
        "seq")


def q_update_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The same updates on a stored collection, which writes the changed rows only; then label 0 is deleted,
    some of its rows are added anew, and the segments are compacted into one."""
    from vellum.session import shared_path
    from vellum.sources.snapshot import CollectionStore

    coll = inputs.meta_collection(spark, sf)
    store = CollectionStore(spark, shared_path(spark, "segments", unique=True), "vectors", EMB_DIM)
    store.commit(coll)
    store.update(_updates(coll))
    store.delete(coll.where("label = 0").select("id"))
    store.append(coll.where("label = 0 and embedding[1] > 0"))
    segments = len(store.segments())
    live = store.read().select("id", "text", "label", "metadata")
    before = live.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "text", "label").cast("decimal(38,0)")).alias("h")).first()
    store.compact()
    after = store.read()
    same = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "text", "label").cast("decimal(38,0)")).alias("h")).first() == before
    return after.select("id", "text", "label", F.try_variant_get("metadata", "$.new_field", "bigint").alias("new_field"),
                        F.lit(segments).alias("segments"), F.lit(same).alias("same_after_compaction"))


def q_lookup_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's first id, and one that is not there, from a stored collection after updates and deletes:
    only the files that can hold them are opened."""
    from vellum.session import shared_path
    from vellum.sources.snapshot import CollectionStore

    coll = inputs.meta_collection(spark, sf)
    store = CollectionStore(spark, shared_path(spark, "lookup", unique=True), "vectors", EMB_DIM)
    store.commit(coll, partitions=16, cluster=True)
    store.update(_updates(coll))
    store.delete(coll.where("label = 0").select("id"))
    first = inputs.table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id")).collect()
    return store.lookup([*[f"vec_{r.vec_id}" for r in first], "nobody"]).select(
        "id", "text", "label", F.try_variant_get("metadata", "$.new_field", "bigint").alias("new_field"))


def q_update_merge(spark: SparkSession, sf: str) -> DataFrame:
    """label 4: new text + metadata {zone, new_field} merged, then a second update that gives the text and
    the promoted label anew; label 8: metadata {} replaces; label 6: updates aimed at unknown ids (not applied)."""
    from vellum.operators.collection import update_documents

    coll = inputs.meta_collection(spark, sf)
    lab = F.col("label")
    out, status = update_documents(coll, _updates(coll), EMB_DIM)
    m = F.col("metadata")
    applied = status.groupBy("id").agg(F.count_if("updated").alias("n_applied"))
    return out.join(applied, "id", "left").select(
        "id", "text", "label", *_meta_cols(), F.try_variant_get(m, "$.new_field", "bigint").alias("new_field"),
        F.size(m.cast("map<string,variant>")).cast("int").alias("n_keys"),
        F.coalesce("n_applied", F.lit(0)).cast("int").alias("n_applied"))


def q_collection_count(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.collection import count_rows

    return count_rows(inputs.meta_collection(spark, sf))


def q_list_ids(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.collection import list_ids

    return list_ids(inputs.meta_collection(spark, sf))


def q_peek(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.collection import peek

    return peek(inputs.meta_collection(spark, sf)).select("id", "text", *_meta_cols())


def q_metadata_profile(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.collection import metadata_profile

    return metadata_profile(inputs.meta_collection(spark, sf))


def q_metadata_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """events as metadata: props (dict) and tags (list) are stored as JSON text, then decoded."""
    from pyspark.sql import types as T

    from vellum.functions import metadata as md

    ev = inputs.table(spark, sf, "events")
    st = F.struct(
        "event_type", "value", F.from_json("props", "k bigint").alias("props"),
        F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("tags"))
    schema = T.StructType([
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StructType([T.StructField("k", T.LongType())])),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ])
    stored = ev.select("event_id", md.encode(st, schema).alias("metadata"))
    back = stored.select("event_id", md.decode(F.col("metadata")).alias("m"),
                         F.try_variant_get("metadata", "$.props", "string").alias("stored_props"))
    return back.select(
        "event_id", "stored_props",
        F.try_variant_get("m", "$.props.k", "bigint").alias("props_k"),
        F.try_variant_get("m", "$.tags[1]", "string").alias("tag_user"),
        F.try_variant_get("m", "$.event_type", "string").alias("event_type"),
        F.try_variant_get("m", "$.value", "double").alias("value"),
    )


def q_collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.collection import collection_stats

    return collection_stats(inputs.meta_collection(spark, sf), "test_collection")


def q_verify_population(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.collection import verify_population

    return verify_population(stored_collection(spark, sf))


def q_backup_restore(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.session import shared_path

    store = _store(spark, "test_collection")
    store.commit(inputs.meta_collection(spark, sf))
    path = store.backup(shared_path(spark, "backups", unique=True))
    target = _store(spark, "restored")
    target.restore(path)
    r = target.read()
    return r.select("id", "text", "label", *_meta_cols(), _checksum("embedding").alias("checksum"))


def q_import_summary(spark: SparkSession, sf: str) -> DataFrame:
    """An import whose model refuses some chunks, into a store that holds the English documents already."""
    from vellum.operators.embed import failing_encoder, python_hash_encoder
    from vellum.plans.ingest import import_documents

    encoder = failing_encoder(python_hash_encoder(HASH_DIM), fails_primary, name="import")
    store = _store(spark, "imported", HASH_DIM)
    english = inputs.markdown_docs(spark, sf).where(F.col("lang") == "en")
    import_documents(store, english.select("source_file", F.col("content").alias("text")), encoder)
    return import_documents(store, inputs.markdown_corpus(spark, sf), encoder)


def q_ingest_composed(spark: SparkSession, sf: str) -> DataFrame:
    """The whole embed job by names: cache, a model that refuses some chunks, fallback, post-processing."""
    from vellum.operators.embed import HashEncoder, failing_encoder, python_hash_encoder, register_encoder
    from vellum.plans.ingest import ingest_documents
    from vellum.session import shared_path
    from vellum.sources.cache import EmbeddingCache

    register_encoder("model", failing_encoder(python_hash_encoder(HASH_DIM), fails_primary, name=CACHE_MODEL))
    register_encoder("spare", HashEncoder(HASH_DIM, name="spare"))
    cache = EmbeddingCache(spark, shared_path(spark, "cache", unique=True))
    cache.append(_seed_cache(spark, sf))
    rows, _ = ingest_documents(inputs.markdown_corpus(spark, sf), "model", fallback="spare", cache=cache, postprocess_dim=64)
    return rows.select("id", F.size("embedding").cast("int").alias("dims"), _checksum("embedding").alias("checksum"))


# --- retrieval decision and context assembly (J6) -------------------------------------------------


def q_reflection_tokens(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.functions.tokens import reflection_tokens

    d = inputs.draft_responses(spark, sf)
    return d.select("conv_id", "turn", *[v.alias(k) for k, v in reflection_tokens("response").items()])


def q_retrieval_decision(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.context import decide

    return decide(inputs.draft_responses(spark, sf), mode="token").select(
        "conv_id", "turn", "has_prior_evidence", "should_retrieve")


def q_prior_evidence(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.context import prior_evidence

    return prior_evidence(inputs.draft_responses(spark, sf), mode="decided").select(
        "conv_id", "turn", "has_prior_evidence")


def _retrieved(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Top-k chunks (with text) for every benchmark question."""
    return _text_search(spark, sf, k, include=("documents", "distances"))


def q_retrieve_context(spark: SparkSession, sf: str) -> DataFrame:
    # At most k hits per question; a question without hits keeps its row with none.
    hits = _retrieved(spark, sf).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", F.length("text").alias("n")))).alias("hits"))
    asked = inputs.benchmark_queries(spark, sf).select("query_id").join(hits, "query_id", "left")
    hit = F.coalesce("hits", F.array().cast("array<struct<rank:int,id:string,n:int>>"))
    return asked.select(
        "query_id", F.size(hit).cast("int").alias("n_contexts"),
        F.array_join(F.transform(hit, lambda h: h["id"]), "|").alias("context_ids"),
        F.aggregate(hit, F.lit(0).cast("bigint"), lambda a, h: a + h["n"]).alias("context_chars"))


def q_route_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn: decide from its draft response, retrieve for the ones that need it, route."""
    from vellum.operators.context import decide, gather_contexts, route
    from vellum.operators.embed import HashEncoder
    from vellum.plans import search

    d = decide(inputs.draft_responses(spark, sf), mode="token").where(F.col("role") == "user")
    conv = inputs.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    need = d.where("should_retrieve").join(conv, ["conv_id", "turn"]).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text")
    top, _ = search.query_by_texts(stored_collection(spark, sf), need, HashEncoder(HASH_DIM), include=("distances",))
    ctx = gather_contexts(top, text_col="id")
    keyed = d.withColumn("query_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return route(keyed, ctx, ["query_id"]).select("conv_id", "turn", "should_retrieve", "route", "n_contexts")


def q_context_prompt(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.functions.prompts import context_prompt
    from vellum.operators.context import gather_contexts

    ctx = gather_contexts(_retrieved(spark, sf))
    q = inputs.benchmark_queries(spark, sf)
    return q.join(ctx, "query_id", "left").select("query_id", context_prompt("contexts", "text").alias("prompt"))


def q_instruction_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as instructions; the following assistant turn, when there is one, as the paragraph."""
    from vellum.functions.prompts import instruction_prompt
    from vellum.operators.context import segmented_next

    c = inputs.table(spark, sf, "conversations")
    nxt = segmented_next(c, "conv_id", "turn", ["role", "text"])
    para = F.when(F.col("next_role") == "assistant", F.col("next_text"))
    return nxt.where(F.col("role") == "user").select("conv_id", "turn", instruction_prompt("text", para).alias("prompt"))


CONTEXT_BUDGET = 2000


def _prioritized(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.context import prioritize_contexts

    ranked = _retrieved(spark, sf, 10).withColumn("dkey", F.round("distance", knn_ops.DISTANCE_DECIMALS))
    return prioritize_contexts(ranked, CONTEXT_BUDGET, score_col="dkey")


def q_prioritize_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return _prioritized(spark, sf).select("query_id", "id", "priority", F.col("used_chars").cast("bigint"))


def q_fuse_context(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.context import fuse

    q = inputs.benchmark_queries(spark, sf).withColumnRenamed("text", "question")
    return fuse(_prioritized(spark, sf), q)


# --- markdown files, batch and incremental import (S1-S3, S6) --------------------------------------


def _corpus_dir(spark: SparkSession, sf: str, where: str | None = None, root: str | None = None) -> str:
    from vellum.session import shared_path

    root = root or shared_path(spark, "corpus", unique=True)
    return inputs.write_markdown_files(spark, sf, root, where)


def q_scan_markdown(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.functions.text import basename
    from vellum.sources.markdown import scan_markdown

    docs, _ = scan_markdown(spark, _corpus_dir(spark, sf))
    return docs.select(basename("source_file").alias("file"), F.length("text").cast("bigint").alias("n_chars"),
                       F.md5("text").alias("text_md5"), F.unix_seconds("modification_time").alias("modified"))


def _collection_view(rows: DataFrame) -> DataFrame:
    from vellum.functions.text import basename

    return rows.select(basename("source_file").alias("file"), "chunk_index", "total_chunks", "doc_title",
                       F.array_join("tags", "|").alias("tags"), "text")


def q_ingest_corpus(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.operators.embed import HashEncoder
    from vellum.plans.ingest import ingest_documents
    from vellum.sources.markdown import scan_markdown

    docs, _ = scan_markdown(spark, _corpus_dir(spark, sf))
    rows, _ = ingest_documents(docs, HashEncoder(HASH_DIM))
    return _collection_view(rows)


def q_incremental_import(spark: SparkSession, sf: str) -> DataFrame:
    """Import en/fr files, then add de/es files to the folder and run again: only new files are
    read; a third run with nothing new adds nothing. Names that start with ``.`` or ``_``, empty files,
    files that are not UTF-8 and old files are among them."""
    from vellum.session import shared_path
    from vellum.sources.snapshot import CollectionStore
    from vellum.streaming.incremental import run_incremental_import

    base = shared_path(spark, "incremental", unique=True)
    root, ckpt = f"{base}/corpus", f"{base}/checkpoint"
    store = CollectionStore(spark, f"{base}/collections", "notes", HASH_DIM)
    _corpus_dir(spark, sf, "lang IN ('en', 'fr')", root)
    run_incremental_import(spark, root, store, ckpt)
    _corpus_dir(spark, sf, "lang NOT IN ('en', 'fr')", root)
    run_incremental_import(spark, root, store, ckpt)
    again = run_incremental_import(spark, root, store, ckpt)
    if again["before"] != again["after"]:
        raise AssertionError(f"re-import changed the collection: {again}")
    return _collection_view(store.read())


QUERIES = {
    "chunk_documents": q_chunk_documents,
    "chunk_counts": q_chunk_counts,
    "doc_titles": q_doc_titles,
    "extract_tags": q_extract_tags,
    "preprocess_text": q_preprocess_text,
    "task_prefix": q_task_prefix,
    "text_preview": q_text_preview,
    "knn_cosine": _knn_metric("cosine"),
    "knn_l2": _knn_metric("l2"),
    "knn_l2_near": q_knn_l2_near,
    "knn_ip": _knn_metric("ip"),
    "knn_batch": q_knn_batch,
    "knn_lsh_recall": q_knn_lsh_recall,
    "query_by_text": q_query_by_text,
    "search_result_view": q_search_result_view,
    "query_with_model": q_query_with_model,
    "knn_include": q_knn_include,
    "knn_filtered": q_knn_filtered,
    "where_operators": q_where_operators,
    "where_document": q_where_document,
    "embed_hash": q_embed_hash,
    "embedding_postprocess": q_embedding_postprocess,
    "validate_dimension": q_validate_dimension,
    "embed_chunks": q_embed_chunks,
    "embed_with_fallback": q_embed_with_fallback,
    "cache_lookup": q_cache_lookup,
    "cache_populate": q_cache_populate,
    "collection_open": q_collection_open,
    "add_documents": q_add_documents,
    "get_by_ids": q_get_by_ids,
    "delete_by_ids": q_delete_by_ids,
    "update_merge": q_update_merge,
    "update_segments": q_update_segments,
    "lookup_stored": q_lookup_stored,
    "collection_count": q_collection_count,
    "list_ids": q_list_ids,
    "peek": q_peek,
    "metadata_profile": q_metadata_profile,
    "metadata_roundtrip": q_metadata_roundtrip,
    "collection_stats": q_collection_stats,
    "verify_population": q_verify_population,
    "backup_restore": q_backup_restore,
    "import_summary": q_import_summary,
    "ingest_composed": q_ingest_composed,
    "reflection_tokens": q_reflection_tokens,
    "retrieval_decision": q_retrieval_decision,
    "prior_evidence": q_prior_evidence,
    "retrieve_context": q_retrieve_context,
    "route_queries": q_route_queries,
    "context_prompt": q_context_prompt,
    "instruction_prompt": q_instruction_prompt,
    "prioritize_contexts": q_prioritize_contexts,
    "fuse_context": q_fuse_context,
    "scan_markdown": q_scan_markdown,
    "ingest_corpus": q_ingest_corpus,
    "incremental_import": q_incremental_import,
}
