import numpy as np

from grantlens.llm import neardup as N
from grantlens.llm import neighbours as A


def clusters(n=900, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24))
    for i in range(n // 3, n):
        x[i] = x[rng.integers(0, i)] + rng.normal(size=24) * rng.choice([0, 0.02, 0.15, 0.25, 0.35])
    return x.astype(np.float32)


EDGE = [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 24, 1), (5003, [float("nan")] * 24, 1), (5004, [1.0, None], 1), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (5007, [1.0, 2.0], None)]


def frame(spark, x, labels):
    rows = [(i, v.tolist(), int(labels[i])) for i, v in enumerate(x)] + EDGE
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 home", "'c' cell")


def test_near_copies_against_brute_force(spark, monkeypatch):
    x = clusters()
    labels = np.arange(len(x)) % 2 * (np.arange(len(x)) % 5 == 0)
    for rows, block in ((2000, 1024), (60, 32)):
        monkeypatch.setattr(N, "CELL_ROWS", rows)
        monkeypatch.setattr(N, "BLOCK_ROWS", block)
        monkeypatch.setattr(N, "REACH", float("inf"))
        monkeypatch.setattr(N.cells, "__defaults__", (N.COSINE, float("inf")))
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        links = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
        np.fill_diagonal(links, False)
        tree = N.forest(links)
        want = {i: (int(links[i].sum()), int(tree[i]), i == tree[i]) for i in range(len(x))}
        want |= {i: (0, i, True) for i in (5000, 5001, 5002, 5003, 5004, 5007)} | {5005: (1, 5005, True), 5006: (1, 5005, False), None: (0, None, False)}
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.linked_vectors(frame(spark, x, labels)).collect()}
        assert got == want
    assert N.linked_vectors(frame(spark, x, labels).limit(0)).count() == 0


def test_neighbours_recall_order_and_edges(spark, monkeypatch):
    monkeypatch.setattr(A, "LEAF_ROWS", 50)
    x = clusters()
    got = {}
    for r in A.near_hundredths(frame(spark, x, np.zeros(len(x)))).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    assert set(got) == set(range(0, 900, 100))
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
    assert hits >= 81
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in A.near_hundredths(few).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert A.near_hundredths(few.limit(0)).count() == 0


def test_near_copies_along_the_leading_axes(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 100)
    monkeypatch.setattr(N, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(6)
    spread = np.arange(1, 129) ** -0.75
    x = rng.normal(size=(2400, 128)) * spread
    x[1200:] = x[:1200] + rng.normal(size=(1200, 128)) * spread * 0.36
    x = x.astype(np.float32)
    labels = (np.arange(2400) % 1200 % 4 == 0).astype(int)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    tree = N.forest(links)
    rows = spark.createDataFrame([(i, v.tolist(), int(labels[i])) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in N.linked_vectors(rows).collect()}
    assert links.sum() > 500 and got == {i: (int(links[i].sum()), int(tree[i])) for i in range(len(x))}


def test_doubles_and_other_lengths(spark):
    """Doubles that floats can't tell apart, and queries of every length."""
    eps = 1e-12
    rows = [(i, [1.0 + i * eps, 2.0, 3.0], 1) for i in range(9)] + [(100, [1.0, 0.0], 1), (101, [1.0, 0.5], 1), (102, [4.0, 0.0], 2), (200, [5.0], 1), (300, [1.0 + 2.4 * eps, 2.0, 3.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in A.near_hundredths(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 100, 300}
    for q, found in got.items():
        own = dict((i, np.array(v)) for i, v, _ in rows)
        same = sorted((float(np.sqrt(((own[i] - own[q]) ** 2).sum())), i) for i in own if i != q and len(own[i]) == len(own[q]))[:10]
        assert found == [(i, d) for d, i in same]
    assert [i for i, _ in got[300]][:2] == [2, 3]
    links = {r.vec_id: (r.n_links, r.component_id) for r in N.linked_vectors(frame).collect()}
    assert links[8] == (8, 0) and links[100] == (0, 100) and links[102] == (0, 102) and links[200] == (0, 200) and links[300] == (0, 300)
    whole = spark.createDataFrame([(0, [1, 2]), (1, [2, 2]), (100, [1, 1])], "vec_id long, embedding array<int>").selectExpr("*", "1 label")
    assert [(r.query_id, r.vec_id) for r in A.near_hundredths(whole).orderBy("query_id", "rank").collect()] == [(0, 1), (0, 100), (100, 0), (100, 1)]
    assert N.linked_vectors(whole).count() == 3
