"""Encoder contract: retries, batch -> row fallback, second-model fallback, cache (F6)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import embed as em


def _flaky_factory(fail_first: int):
    state = {"n": 0}

    def factory():
        def encode_batch(texts):
            state["n"] += 1
            if state["n"] <= fail_first:
                raise RuntimeError("transient")
            return [[float(len(t)), 1.0] for t in texts]

        return encode_batch

    return factory


def test_retry_then_success(spark):
    enc = em.BatchEncoder("flaky-retry", 2, _flaky_factory(2), retry_delay=0.0)
    df = spark.createDataFrame([("abc",)], "text string").coalesce(1)
    r = em.embed(df, enc).first()
    assert r.embed_status == "ok" and r.embed_attempts == 3 and list(r.embedding) == [3.0, 1.0]


def _make_picky():
    def factory():
        def encode_batch(texts):
            if len(texts) > 1 or "bad" in texts[0]:
                raise RuntimeError("no batches, no bad texts")
            return [[1.0, 2.0]]

        return encode_batch

    return factory


def test_batch_failure_falls_back_to_rows(spark):
    enc = em.BatchEncoder("picky", 2, _make_picky(), retry_delay=0.0)
    df = spark.createDataFrame([("good one",), ("bad one",), ("good two",)], "text string").coalesce(1)
    rows = {r.text: r.embed_status for r in em.embed(df, enc).collect()}
    assert rows == {"good one": "ok", "bad one": "failed", "good two": "ok"}


def test_fallback_encoder_and_rejects(spark):
    primary = em.BatchEncoder("picky2", 2, _make_picky(), retry_delay=0.0)
    fallback = em.BatchEncoder("const", 2, lambda: (lambda ts: [[0.5, 0.5] for _ in ts]), retry_delay=0.0)
    df = spark.createDataFrame([("good",), ("bad",)], "text string").coalesce(1)
    ok, rejects = em.embed_with_fallback(df, primary, fallback)
    got = {r.text: r.embed_model for r in ok.collect()}
    assert got == {"good": "picky2", "bad": "const"} and rejects.count() == 0
    ok2, rejects2 = em.embed_with_fallback(df, primary, None)
    assert [r.text for r in ok2.collect()] == ["good"] and [r.reason for r in rejects2.collect()] == ["failed"]


def test_python_and_jvm_hash_encoders_agree(spark):
    texts = ["Hello world, hello Spark!", "Ça va? Très bien — merci.", "", "x_y z 123"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    jvm = em.HashEncoder(64)
    py = em.python_hash_encoder(64)
    a = df.select("text", jvm.vector(F.col("text")).alias("v")).collect()
    b = {r.text: r.embedding for r in em.embed(df, py).collect()}
    for r in a:
        assert np.allclose(r.v, b[r.text])


def test_cache_read_through(spark):
    enc = em.HashEncoder(16)
    df = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha")], "k int, text string")
    empty = spark.createDataFrame([], em.CACHE_SCHEMA)
    out, new = em.cached_embed(df, enc, empty)
    assert sorted(r.embed_source for r in out.collect()) == ["computed"] * 3
    assert new.count() == 2  # each distinct text encoded once
    out2, new2 = em.cached_embed(df, enc, new)
    assert sorted(r.embed_source for r in out2.collect()) == ["cache"] * 3 and new2.count() == 0
    # an empty cached vector is a miss
    broken = new.withColumn("embedding", F.array().cast("array<float>"))
    out3, _ = em.cached_embed(df, enc, broken)
    assert {r.embed_source for r in out3.collect()} == {"computed"}


def test_dimension_discovery(spark):
    df = spark.createDataFrame([([],), ([1.0, 2.0, 3.0],)], "embedding array<float>")
    assert em.embedding_dimension(df) == 3


def test_encoders_by_name():
    em.register_encoder("tiny", em.HashEncoder(8))
    assert em.encoder_named("tiny").dim == 8 and em.encoder_named(None) is None
    with pytest.raises(ValueError):
        em.encoder_named("never registered")


def _counted(path):
    """A model that writes a line for every text it is given and refuses those with 'sour'."""
    def factory():
        def encode_batch(texts):
            if any("sour" in t for t in texts):
                raise RuntimeError("refused")
            with open(path, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[float(len(t)), 1.0, 0.0, 2.0] for t in texts]

        return encode_batch

    return factory


def test_lookup_does_not_move_the_cache(spark, scratch):
    """The cache lies in buckets of the key: only the texts are shuffled to it, also in a new session's reader."""
    from vellum.sources.cache import EmbeddingCache

    def entries(ids, value, day):
        return spark.range(*ids).select(
            em.cache_key("m", F.concat(F.lit("text "), F.col("id"))).alias("cache_key"), F.lit("m").alias("model"),
            F.md5(F.concat(F.lit("text "), F.col("id"))).alias("text_hash"),
            F.array(F.lit(value).cast("float")).alias("embedding"), F.lit(f"2024-01-0{day}").cast("timestamp").alias("ts"))

    cache = EmbeddingCache(spark, scratch + "/it's a cache", buckets=4)
    assert cache.read().count() == 0
    cache.compact()
    cache.append(entries((0, 300), 1.0, 1))
    cache.append(entries((200, 400), 2.0, 2))
    cache.append(entries((390, 420), 0.0, 3).withColumn("embedding", F.array().cast("array<float>")))
    again = EmbeddingCache(spark, scratch + "/it's a cache")
    texts = spark.range(500).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked = em.cache_lookup(texts, again.read(), "m")
        plan = looked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
        assert {r.id for r in looked.where("cached IS NOT NULL").collect()} == set(range(400))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert again.read().count() == 530
    again.compact()
    assert cache.read().count() == 400
    got = {r.id: r.cached for r in em.cache_lookup(texts, cache.read(), "m").collect()}
    assert got == {i: [1.0] if i < 200 else [2.0] if i < 400 else None for i in range(500)}


def test_a_cache_file_that_cannot_be_read_is_a_miss(spark, scratch):
    from pathlib import Path

    from vellum.sources.cache import EmbeddingCache

    cache = EmbeddingCache(spark, scratch + "/broken", buckets=2)
    texts = spark.range(40).select(F.concat(F.lit("t"), F.col("id")).alias("text"))
    _, new = em.cached_embed(texts, em.HashEncoder(8), cache.read())
    cache.append(new)
    files = sorted(Path(scratch + "/broken/v000001").glob("*.parquet"))
    assert len(files) == 2
    files[0].write_bytes(b"not a file of the cache")
    left = cache.read().count()
    assert 0 < left < 40
    out, new = em.cached_embed(texts, em.HashEncoder(8), cache.read())
    assert out.where("embedding IS NULL").count() == 0 and new.count() == 40 - left


def test_whole_embed_job(spark, scratch, tmp_path):
    """Cache, model, fallback, post-processing and rejects in one job; no text is encoded twice."""
    from vellum.plans.ingest import ingest_documents
    from vellum.sources.cache import EmbeddingCache

    log = tmp_path / "calls"
    model = em.BatchEncoder("counted", 4, _counted(str(log)), max_retries=1, retry_delay=0.0)
    spare = em.BatchEncoder("spare", 4, lambda: (lambda ts: [[1.0, 2.0, 3.0, 4.0] if "very" in t else [] for t in ts]), retry_delay=0.0)
    docs = spark.createDataFrame([("a.md", "sweet plum"), ("b.md", "sweet plum"), ("c.md", "very sour plum"), ("d.md", "sour")],
                                 "source_file string, text string")
    cache = EmbeddingCache(spark, scratch + "/cache")
    rows, rejects = ingest_documents(docs, model, fallback=spare, cache=cache)
    got = {r.source_file: r.embedding for r in rows.collect()}
    assert set(got) == {"a.md", "b.md", "c.md"} and got["c.md"] == [1.0, 2.0, 3.0, 4.0]
    assert [(r.stage, r.reason) for r in rejects.collect()] == [("embed", "failed")]
    assert len(log.read_text().splitlines()) == 1 and cache.read().count() == 1  # the fallback's vector is not kept
    again, _ = ingest_documents(docs, model, fallback=spare, cache=cache)
    assert again.count() == 3 and len(log.read_text().splitlines()) == 1


def test_search_with_a_model(spark):
    """Search takes a Python model; a question it refuses, or without an id, gets a status row and no hits."""
    from vellum.plans import search

    model = em.failing_encoder(em.python_hash_encoder(32), lambda t: "forbidden" in t)
    coll = spark.createDataFrame([("x", "green apple"), ("y", "old stone bridge")], "id string, text string")
    coll = em.embed(coll, em.python_hash_encoder(32), "text").select("id", "text", "embedding")
    asked = spark.createDataFrame([(1, "stone bridge"), (2, "forbidden"), (3, "apple"), (None, "apple")], "query_id int, text string")
    hits, status = search.query_by_texts(coll, asked, model, 1, include=("documents",))
    assert {r.query_id: r.id for r in hits.collect()} == {1: "y", 3: "x"}
    assert {r.query_id: (r.status, r.reason) for r in status.collect()} == {
        1: ("ok", None), 2: ("error", "failed"), 3: ("ok", None), None: ("error", "missing_id")}


def test_import_counts(spark, scratch):
    from vellum.plans.ingest import import_documents
    from vellum.sources.snapshot import CollectionStore

    store = CollectionStore(spark, scratch, "notes", 16)
    model = em.failing_encoder(em.python_hash_encoder(16), lambda t: "sour" in t)
    docs = spark.createDataFrame([("a.md", "x" * 900), ("b.md", "sour"), ("c.md", "fine")], "source_file string, text string")
    first = import_documents(store, docs, model).first()
    assert (first.n_documents, first.n_chunks, first.n_embedded, first.n_rejected, first.n_written) == (3, 4, 3, 1, 3)
    more = import_documents(store, docs.limit(0), model).first()
    assert (more.n_documents, more.n_chunks, more.n_written) == (0, 0, 0) and store.read().count() == 3
    assert import_documents(store, docs, model).first().n_written == 0


def test_hash_vectors_hash_a_token_once_a_batch(spark):
    """Buckets of the Arrow step are those of the JVM expression, which the vectors no longer run for every token."""
    from vellum.functions import hashing

    words = ["the", "été", "straße", "日本", "x_1", "42"]
    rows = spark.createDataFrame([(" ".join(words * 3),), ("",), (None,)], "t string")
    jvm = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.token_bucket(F.col("w"), 64).alias("b"))
    assert {r.w: r.b for r in jvm.collect()} == {w: hashing.bucket_of(w, 64) for w in words}
    vectors = rows.select("t", hashing.hash_embedding("t", 64).alias("v"))
    assert "md5" not in vectors._jdf.queryExecution().optimizedPlan().toString().lower()
    full, empty, null = [r.v for r in vectors.collect()]
    assert {i for i, x in enumerate(full) if x} == {hashing.bucket_of(w, 64) for w in words}
    assert not any(empty) and null is None


def test_tokens_go_to_python_as_one_string(spark):
    from vellum.functions import hashing

    texts = ["", " ", "a", "--a b_c--", "Été straße 日本\n\t42 x", "ΑΣ İx", "...!", " z\x1cq\x85", "é \U0001d54f", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(hashing.tokens("t").alias("a"), hashing.joined_tokens(F.col("t")).alias("j"),
                      hashing.hash_embedding("t", 64).alias("v")).collect()
    for r in got:
        if r.a is None:
            assert r.j is None and r.v is None
            continue
        assert r.a == [w for w in r.j.split(" ") if w]
        counts = np.bincount([hashing.bucket_of(w, 64) for w in r.a], minlength=64) if r.a else np.zeros(64)
        assert np.allclose(r.v, counts / max(1e-300, np.sqrt((counts * counts).sum())))


def test_rows_to_embed_are_computed_once(spark):
    """The texts are looked up and the missing ones encoded from one run of what made them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(t):
        seen.add(1)
        return t * 2

    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string").where("t is not null").select(
        made("t").alias("text"))
    out, new = em.cached_embed(rows, em.HashEncoder(8), spark.createDataFrame([], em.CACHE_SCHEMA))
    assert out.count() == 3 and new.count() == 2
    assert seen.value == 3


def test_import_writes_model_vectors_once(spark, scratch, monkeypatch):
    from vellum.plans.ingest import import_documents
    from vellum.sources.snapshot import CollectionStore

    written, write = [], em.materialize
    monkeypatch.setattr(em, "materialize", lambda df: written.append(df.columns) or write(df))
    store = CollectionStore(spark, scratch, "notes", 16)
    docs = spark.createDataFrame([("a.md", "x" * 900), ("b.md", "sour")], "source_file string, text string")
    model = em.failing_encoder(em.python_hash_encoder(16), lambda t: "sour" in t)
    assert import_documents(store, docs, model).first().n_written == 2
    assert len([c for c in written if "embedding" in c]) == 1


def test_valid_vectors(spark):
    from vellum.functions import vectors as vx

    inf, nan = float("inf"), float("nan")
    rows = [([1.0, 2.0], True), ([1.0], False), ([1.0, None], False), ([nan, 1.0], False), ([1.0, inf], False),
            ([-inf, None], False), (None, False), ([], False)]
    got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v array<float>").select(
        "i", vx.is_valid_vector("v", 2).alias("ok")).collect()
    assert {r.i: r.ok for r in got} == {i: ok for i, (_, ok) in enumerate(rows)}
