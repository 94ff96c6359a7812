"""Bounds of the exact search and the inverted-file index, against NumPy."""

import numpy as np
import pytest

from vellum.operators import ann
from vellum.operators import knn as kn


def clustered(n=3000, dim=16, groups=30, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    at = np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))  # a third of all rows in one group
    return centres[at] + rng.normal(size=(n, dim)) * 0.3, at


def distances(q, x, metric):
    if metric == "l2":
        return ((q[:, None] - x[None])**2).sum(axis=2)
    if metric == "cosine":
        q, x = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, x))
    return 1 - q @ x.T


def frame(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


def nearest(q, x, k, metric):
    d = distances(q, x, metric)
    return {(i, int(j)) for i, row in enumerate(d) for j in np.lexsort((np.arange(len(row)), np.round(row, 9)))[:k]}


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_reachable_never_drops_a_neighbour_and_skips_far_tiles(metric):
    x, at = clustered()
    q = x[:40] + 0.01
    qn = q / np.linalg.norm(q, axis=1, keepdims=True) if metric == "cosine" else q
    d = distances(q, x, metric)
    bound = np.sort(d, axis=1)[:, 9]
    skipped = total = 0
    for g in range(30):
        own = np.flatnonzero(at == g)
        can = kn.reachable(qn, bound, x[own], metric)
        need = (d[:, own] <= bound[:, None]).any(axis=1)
        assert (can | ~need).all()
        skipped += (~can).sum()
        total += len(can)
    assert skipped > (0.1 if metric == "ip" else 0.8) * total


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_seeded_search_is_exact(spark, metric, monkeypatch):
    x, _ = clustered(2000)
    x[5], x[6] = x[7], x[7]
    monkeypatch.setattr(kn, "SEED_RATE", 4)
    got = kn.knn(frame(spark, x, "id").repartition(6), frame(spark, x[:50], "query_id"), 7, metric, dim=16).collect()
    assert {(r.query_id, r.id) for r in got} == nearest(x[:50], x, 7, metric)


def test_candidates_do_not_grow_with_tasks(spark):
    """With bounds from the sample, what goes to the exchange depends on the rows, not on the tasks."""
    x = np.random.default_rng(1).normal(size=(20_000, 8))
    rows, q = frame(spark, x, "id"), frame(spark, x[:20], "query_id")
    few, many = (kn.knn_candidates(rows.repartition(n), q, 5, "l2", dim=8).count() for n in (2, 64))
    assert many <= 20 * 5 * kn.SEED_RATE * 3 and few <= many


def test_near_rows_keep_their_order_under_l2(spark):
    rows = [("a", [1.0 + 3e-6, 0.5]), ("b", [1.0 + 1e-6, 0.5]), ("c", [1.0, 0.5]), ("d", [1.0 - 1e-6, 0.5])]
    corpus = spark.createDataFrame(rows, "id string, embedding array<double>")
    query = spark.createDataFrame([(1, [1.0, 0.5])], "query_id int, embedding array<double>")
    got = [r.id for r in kn.knn(corpus, query, 4, "l2", dim=2).orderBy("rank").collect()]
    assert got == ["c", "b", "d", "a"] or got == ["c", "d", "b", "a"]  # equal but for the last digits of the sums
    assert [r.id for r in kn.knn_expression(corpus, [1.0, 0.5], 4, "l2").orderBy("rank").collect()][-1] == "a"


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_index(spark, scratch, metric, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    monkeypatch.setattr(ann, "PART_QUERIES", 16)
    x, _ = clustered(1500)
    corpus = frame(spark, x, "id").union(spark.createDataFrame(
        [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (None, [1.0] * 16)],
        "id long, embedding array<double>"))
    index = ann.CellIndex.build(corpus, f"{scratch}/ix", 16, metric, cells=20)
    assert sorted(r.id for r in index.rows().collect()) == list(range(1500))
    queries = frame(spark, x[:60], "query_id")
    true = nearest(x[:60], x, 5, metric)
    everywhere = index.search(queries, 5, 20).collect()
    assert {(r.query_id, r.id) for r in everywhere} == true
    assert {(r.query_id, r.id) for r in index.exact(queries, 5).collect()} == true
    probes = index.probes_for(queries, 5, 0.95)
    found = index.search(queries, 5, probes)
    assert 1 <= probes <= 20 and ann.recall(found, index.exact(queries, 5)).first().recall >= 0.9


def test_index_of_no_rows(spark, scratch):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    index = ann.CellIndex.build(none, f"{scratch}/none", 4, "l2")
    queries = spark.createDataFrame([(1, [1.0] * 4)], "query_id long, embedding array<double>")
    assert index.search(queries, 3, 2).count() == 0 and index.exact(queries, 3).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_screening_loses_no_neighbour_and_measures_few_pairs(metric, monkeypatch):
    """Single precision only sorts pairs out: rows of very different lengths, far from the origin or 1e-7 apart
    are ranked as in double precision, and few pairs of all are measured in it."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    plain = rng.normal(size=(3000, 16))
    odd = [plain * 10.0**rng.uniform(-3, 3, size=(3000, 1)), plain + 1e3, np.repeat(plain[:1000], 3, axis=0) + 1e-7 * plain,
           np.r_[plain, np.zeros((5, 16))]]
    measured = []
    whole = kn._pair_distances
    monkeypatch.setattr(kn, "_pair_distances", lambda q, x, i, j, m: measured.append(len(i)) or whole(q, x, i, j, m))
    for x in [plain, *odd]:
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 16, pa.int32()), pa.array(x.ravel()))
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), vectors], ["id", "embedding"])
        rows = kn.corpus_rows([batch], 16, metric, 5)
        q = rows.mat[:200]
        d = kn.resolved(whole(q, rows.mat, *np.divmod(np.arange(200 * len(x)), len(x)), metric), metric).reshape(200, len(x))
        true = np.argsort(d, axis=1, kind="stable")[:, :5]
        for bound in (np.full(200, np.inf), np.sort(d, axis=1)[:, 4]):
            measured.clear()
            block = kn._Block(pa.array(np.arange(200)), q, bound)
            got = pa.Table.from_batches(list(kn.nearest(block, rows, metric, 5, pa.int64(), pa.int64()))).to_pydict()
            assert set(zip(got["query_id"], got["id"])) == {(i, int(j)) for i, row in enumerate(true) for j in row}
            assert x is not plain or sum(measured) < 0.02 * d.size


def test_equal_vectors_are_held_k_times():
    import pyarrow as pa

    x = np.r_[np.ones((50, 4)), np.eye(4)]
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 4, pa.int32()), pa.array(x.ravel()))
    ids = pa.array([f"d{i:02d}" for i in reversed(range(54))])
    rows = kn.corpus_rows([pa.RecordBatch.from_arrays([ids, vectors], ["id", "embedding"])], 4, "l2", 3)
    assert sorted(rows.ids.to_pylist()) == ["d00", "d01", "d02", "d03", "d04", "d05", "d06"]


def test_rows_are_dealt_to_cells_in_small_batches(monkeypatch):
    """However many cells a row goes to, a batch of copies holds at most ``BATCH_VALUES`` numbers."""
    import pyarrow as pa

    monkeypatch.setattr(ann, "BATCH_VALUES", 1 << 10)
    x, centres = np.random.default_rng(2).normal(size=(300, 8)), np.random.default_rng(3).normal(size=(40, 8))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(301) * 8, pa.int32()), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), vectors], ["id", "embedding"])
    true = np.argsort(((x[:, None] - centres[None])**2).sum(axis=2), axis=1)
    for with_vectors, width in ((True, 8), (False, 1)):
        dealt = list(ann._dealt("query_id", centres, "l2", 20, with_vectors)(iter([batch])))
        assert max(b.num_rows for b in dealt) * width <= 1 << 10
        got = pa.Table.from_batches(dealt)
        assert got.column_names == ["query_id", *(["embedding"] if with_vectors else []), "cell", "place"]
        assert got.column("cell").to_pylist() == true[:, :20].ravel().tolist()


def test_queries_are_packed_once_however_many_cells_they_probe(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ann, "BATCH_VALUES", 1 << 10)
    x, centres = np.random.default_rng(2).normal(size=(300, 8)), np.random.default_rng(3).normal(size=(40, 8))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(301) * 8, pa.int32()), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), vectors, pa.array(np.full(300, np.inf))], ["id", "embedding", "bound"])
    true = np.argsort(((x[:, None] - centres[None])**2).sum(axis=2), axis=1)
    packed = list(ann._pack_probes(centres, "l2", 30, pa.int64())(iter([batch])))
    assert [i for b in packed for i in b.column("ids")[0].as_py()] == list(range(300))
    assert sum(len(b.column("mat")[0].as_py()) for b in packed) == 300 * 8 * 8
    cells = np.concatenate([np.frombuffer(b.column("cells")[0].as_py(), np.uint16).reshape(-1, 30) for b in packed])
    assert (cells == true[:, :30]).all() and max(len(b.column("ids")[0]) for b in packed) * 40 <= 1 << 10


def test_search_shuffles_neither_rows_nor_queries(spark, scratch, monkeypatch):
    """Vectors stay where they are stored or packed; what a search sends on is at most k rows a query of all that
    a task holds, and equal distances in several cells go to the smaller ids."""
    monkeypatch.setattr(ann, "HELD_BYTES", 40_000)
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=(3000, 16)), np.eye(16), np.eye(16)]
    index = ann.CellIndex.build(frame(spark, x, "id"), f"{scratch}/still", 16, "l2", cells=30)
    q = np.r_[np.zeros((1, 16)), x[:200]]
    sent = []
    whole = kn.final_topk
    monkeypatch.setattr(kn, "final_topk", lambda c, k: sent.append(c) or whole(c, k))
    found = index.search(frame(spark, q, "query_id"), 5, 30)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and not [at for at in plan.splitlines() if "Exchange" in at and "query_id" not in at]
    assert {(r.query_id, r.id) for r in found.collect()} == nearest(q, x, 5, "l2")
    assert sent[-1].count() < 201 * 5 * 30 / 2
