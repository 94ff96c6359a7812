"""Post-processing, validation, distances and the kNN kernel (fixture F6, F1)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import vectors as vx
from vellum.operators import knn as kn


def _np_post(raw, dim):
    x = np.asarray(raw, dtype=np.float64)
    y = (x - x.mean()) / np.sqrt(x.var() + 1e-5)
    y = y[:dim]
    return y / max(np.linalg.norm(y), 1e-12)


@pytest.mark.parametrize("dim", [512, 256])
def test_postprocess_unit_norm(spark, dim):
    rng = np.random.default_rng(0)
    raws = [rng.normal(size=768).astype(np.float32).tolist() for _ in range(3)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "k int, raw array<float>")
    rows = df.select("k", vx.postprocess("raw", dim).alias("v")).orderBy("k").collect()
    for r, raw in zip(rows, raws):
        assert len(r.v) == dim
        assert abs(np.linalg.norm(r.v) - 1) < 1e-6
        assert np.allclose(r.v, _np_post(raw, dim), atol=1e-12)


def test_postprocess_bad_dim():
    with pytest.raises(ValueError):
        vx.postprocess(F.col("raw"), 100)


def test_postprocess_constant_vector(spark):
    df = spark.createDataFrame([([0.1] * 768,)], "raw array<float>")
    v = df.select(vx.postprocess("raw", 512).alias("v")).first().v
    assert len(v) == 512 and all(np.isfinite(v))


def test_validation(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0, 1.0]),
                                (5, [1.0, float("-inf"), 1.0])], "k int, v array<float>")
    rows = {r.k: (r.ok, r.why) for r in df.select("k", vx.is_valid_vector("v", 3).alias("ok"),
                                                  vx.invalid_reason("v", 3).alias("why")).collect()}
    assert rows == {1: (True, None), 2: (False, "dimension_mismatch:1"), 3: (False, "missing_embedding"),
                    4: (False, "nan_in_embedding"), 5: (False, "infinity_in_embedding")}


def _vectors(n=150, dim=128, seed=1):
    rng = np.random.default_rng(seed)
    return rng.random((n, dim)).astype(np.float32)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_kernel_matches_expression(spark, metric):
    x = _vectors()
    corpus = spark.createDataFrame([(f"doc_{i}", x[i].tolist()) for i in range(len(x))], "id string, embedding array<float>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 150, 15)], "query_id int, embedding array<float>")
    res = kn.knn(corpus, queries, 3, metric, dim=128).collect()
    for qid in range(0, 150, 15):
        got = [(r.id, round(r.distance, 9)) for r in sorted((r for r in res if r.query_id == qid), key=lambda r: r.rank)]
        exp = kn.knn_expression(corpus, x[qid].tolist(), 3, metric).orderBy("rank").collect()
        assert [g[0] for g in got] == [e.id for e in exp]
        assert np.allclose([g[1] for g in got], [e.distance for e in exp], atol=1e-9)
        if metric != "ip":
            assert got[0][0] == f"doc_{qid}"  # a stored vector finds itself first


def test_kernel_ties_break_by_id(spark):
    v = [1.0, 0.0, 0.0]
    corpus = spark.createDataFrame([(f"d{i}", v) for i in (5, 3, 9, 1)] + [("far", [0.0, 1.0, 0.0])],
                                   "id string, embedding array<float>")
    q = spark.createDataFrame([(0, v)], "query_id int, embedding array<float>")
    got = [r.id for r in kn.knn(corpus, q, 3, "cosine", dim=3).orderBy("rank").collect()]
    assert got == ["d1", "d3", "d5"]


def test_kernel_blocks_and_fewer_rows_than_k(spark):
    x = _vectors(20, 8)
    corpus = spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "query_id int, embedding array<float>")
    # a budget of 5 query rows per block forces several broadcast blocks
    res = kn.knn(corpus, queries, 10, "l2", dim=8, max_block_bytes=5 * 8 * 8).collect()
    assert len(res) == 20 * 4


def test_zero_vectors_are_at_distance_one(spark):
    """A zero row or query has no direction: cosine 0 with all, so no row is lost while k is not reached."""
    corpus = spark.createDataFrame([("z", [0.0, 0.0]), ("a", [1.0, 0.0]), ("o", [-1.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 0.0])], "query_id int, embedding array<float>")
    got = kn.knn(corpus, q, 5, "cosine", dim=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, "a"), (0, "z"), (0, "o"), (1, "a"), (1, "o"), (1, "z")]
    assert got[1].distance == 1.0 and {r.distance for r in got[3:]} == {1.0}
    one = kn.knn_expression(corpus, [1.0, 1.0], 5).orderBy("rank").collect()
    assert [r.id for r in one] == ["a", "z", "o"] and one[1].distance == 1.0


def test_many_rows_of_one_query_id_in_small_blocks(spark):
    """Blocks are cut by rows, so one id may hold any number of them; the corpus is mapped once."""
    corpus = spark.createDataFrame([(i, [float(np.sin(i * j + 1)) for j in range(8)]) for i in range(50)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [float(j + 1) for j in range(8)])] * 400 + [(8, [0.0] * 8), (9, [1.0])],
                                    "query_id long, embedding array<float>")
    cands = kn.knn_candidates(corpus, queries, 3, "cosine", dim=8, max_block_bytes=5 * 8 * 8)
    assert cands._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    best = {r.id for r in kn.knn(corpus, queries.limit(1), 3, "cosine", dim=8).collect()}
    assert {r.id for r in cands.orderBy("distance").collect()} >= best


def test_l2_keeps_its_digits_far_from_the_origin():
    x = np.full((3, 4), 1e6)
    x[0, 0] += 1e-4
    x[1, 0] += 5e-4
    assert np.allclose(kn._distances(np.full((1, 4), 1e6), x, "l2"), [[1e-8, 2.5e-7, 0]], rtol=1e-4, atol=0)


def test_import_cleans_a_chunk_once(spark):
    """The optimised plan has the cleaning's replacements as often as one cleaning has them."""
    from vellum.operators.embed import HashEncoder
    from vellum.plans.ingest import encoder_input, ingest_documents

    docs = spark.createDataFrame([("/a.md", "some text")], "source_file string, text string")

    def cleanings(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("empty_document")

    once = cleanings(docs.select(encoder_input("text").alias("x")))
    rows, rejects = ingest_documents(docs, HashEncoder(64))
    assert cleanings(rows) == once > 0 and rejects.count() == 0
