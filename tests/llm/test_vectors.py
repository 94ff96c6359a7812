"""Vector operators against brute force: invalid vectors, ties, repeated rows, hot classes."""

import numpy as np
import pytest

from vellum.llm import embedding_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, data string, node long, score long"
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7]


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 8))
    base[n // 3: 2 * n // 3] = base[0] + rng.normal(size=(2 * n // 3 - n // 3, 8)) * 0.15  # a hot class
    base[-20:] = base[5]  # copies
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(n + i, v) for i, v in enumerate(ODD)] + [(None, rows[5][1]), (n + 10, [1.0, 2.0]), (3, rows[3][1])]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows_of(900, 0)], SCHEMA).repartition(5)


def usable(v, zero=True):
    return bool(v) and None not in v and np.isfinite(v).all() and (zero or any(v))


def test_top_k(vectors, spark):
    rows = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows_of(900, 0) if i is not None and usable(v)]
    got = topk.top_k(vectors).orderBy("query_id", "rank").collect()
    want = []
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        vec = min((v for i, v in rows if i == q), key=lambda v: v.astype("<i8").tobytes())
        scores = sorted((-int(v @ vec), i) for i, v in rows if i != q and len(v) == len(vec))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == want
    assert topk.top_k(vectors.limit(0)).count() == 0 and topk.top_k(vectors.where("vec_id % 100 <> 0")).count() == 0


def test_blocks_are_pruned_and_ties_kept():
    ids = np.arange(1024)
    data = np.zeros((1024, 4), "<i8")
    data[:, 0] = np.repeat([5, 9, 7, 1], 256)
    shard = topk.Shard(4, ids.tobytes(), data.tobytes())
    row, vec, score, kth = shard.search(np.array([-1]), np.array([[1, 0, 0, 0]]), np.array([-np.inf]), 10)
    assert vec.tolist() == list(range(256, 266)) and set(score) == {9} and kth.tolist() == [9]
    assert shard.search(np.array([-1]), np.array([[1, 0, 0, 0]]), np.array([10.0]), 10)[0].size == 0


@pytest.mark.parametrize("tile", [64, 1024])
def test_embedding_duplicates(vectors, tile):
    rows = rows_of(900, 0)
    ok = [k for k, (_, v) in enumerate(rows) if usable(v, zero=False)]
    link = np.zeros((len(rows), len(rows)), bool)
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(rows[k][1]) for k in ok}
    for a in ok:
        for b in ok:
            link[a, b] = a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    root = np.arange(len(rows))
    while True:
        new = np.array([min(root[k], root[link[k]].min(initial=len(rows))) for k in range(len(rows))])
        if np.array_equal(new, root):
            break
        root = new
    want = []
    for k, (i, _) in enumerate(rows):
        name = min((rows[j][0] for j in np.flatnonzero(root == root[k]) if rows[j][0] is not None), default=None)
        want.append((-1 if i is None else i, int(link[k].sum()), name, i == name if i is not None else name is None))
    got = embedding_dedup.embedding_duplicates(vectors, window=16, tile=tile).collect()
    have = [(-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in got]
    assert sorted(have) == sorted(want)
    assert embedding_dedup.embedding_duplicates(vectors.limit(0)).count() == 0


def test_codes_bound_their_error():
    """No cosine of codes is farther from the true one than the stated slack, whatever the vectors' lengths."""
    rng = np.random.default_rng(3)
    for dim in (1, 2, 64, 500):
        x = rng.normal(size=(300, dim)) * 10.0 ** rng.integers(-3, 4, size=(300, 1))
        x[1::2] = x[::2] + rng.normal(size=(150, dim)) * np.abs(x[::2]).max(axis=1, keepdims=True) * 0.1
        unit = embedding_dedup.unit_rows([v.tobytes() for v in x])
        code, slack = embedding_dedup.unit_codes([embedding_dedup.as_code(v / np.abs(v).max()) for v in x])
        assert np.abs(code @ code.T - unit @ unit.T).max() <= slack < 1e-3


def test_pairs_within_the_rounding_are_compared_in_doubles(spark):
    """Pairs just over and just under the threshold, closer to it than the codes can tell, beside vectors of
    another length."""
    rows, want = [], {}
    for k, gap in enumerate([1e-7, -1e-7, 1e-9, -1e-9, 1e-6, -1e-6] * 20):
        a, b = np.zeros(260), np.zeros(260)
        a[2 * k] = 1.0
        b[2 * k], b[2 * k + 1] = 0.95 + gap, np.sqrt(1 - (0.95 + gap) ** 2)
        rows += [(2 * k, a.tolist()), (2 * k + 1, b.tolist())]
        want[2 * k] = want[2 * k + 1] = int(gap > 0)
    odd = [0.95 + 1e-8, float(np.sqrt(1 - (0.95 + 1e-8) ** 2))]
    rows += [(900, [1.0, 0.0]), (901, odd)]
    want[900] = want[901] = 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_duplicates(df).collect()}
    assert got == want


def test_passes_follow_the_number_of_nodes():
    assert embedding_dedup.passes_for(100, 128, 0.95, 0.99) == 2
    assert embedding_dedup.passes_for(10**6, 128, 0.95, 0.99) < embedding_dedup.passes_for(10**9, 128, 0.95, 0.99)


def test_pairs_in_a_dense_cone_meet(spark):
    """A third of the rows at cosine 0.9 to each other, with single pairs at 0.955 planted in the cone:
    far more rows than a window share the first signs there, and the pairs must meet all the same."""
    rng = np.random.default_rng(7)

    def directions(n, *across):
        """Unit vectors at right angles to each of ``across`` (which are so to each other)."""
        x = rng.normal(size=(n, 128))
        for u in across:
            x -= (x * u).sum(axis=1, keepdims=True) * u
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    base = directions(2400)
    axis = directions(1)
    own = directions(800, axis)
    own[1:200:2] = 0.55 * own[:200:2] + np.sqrt(1 - 0.55**2) * directions(100, axis, own[:200:2])
    base[:800] = np.sqrt(0.9) * axis + np.sqrt(0.1) * own  # rows 2k and 2k + 1 < 200 at 0.9 + 0.1 * 0.55
    link = np.triu(base @ base.T >= 0.95, 1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.embedding_duplicates(rows.repartition(4), window=16).collect()}
    a, b = np.nonzero(link)
    assert len(a) >= 100 and len(got) == 2400
    met = sum(got[x].component_id == got[y].component_id for x, y in zip(a.tolist(), b.tolist()))
    assert met >= 0.99 * len(a), (met, len(a))
