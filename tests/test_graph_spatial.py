import numpy as np
import pytest
from gridlark.operators import graph as G
from gridlark.operators import spatial as P
from pyspark.sql import functions as F

rng = np.random.default_rng(0)
X = rng.normal(size=(60, 4))
M = np.round(rng.random((8, 8)) * (rng.random((8, 8)) < 0.4), 3)


def coo(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>").repartition(3).cache()


def test_sparse(spark):
    a = coo(spark, M)
    assert np.allclose(dense(G.matmul(a, G.transpose(a)), (8, 8)), M @ M.T)
    assert np.allclose(dense(G.add(a, a), (8, 8)), 2 * M)
    assert np.allclose(dense(G.kron(a, a, (8, 8)), (64, 64)), np.kron(M, M))
    assert G.norm(a) == pytest.approx(np.linalg.norm(M)) and G.norm(a, 1) == pytest.approx(np.abs(M).sum(0).max())
    s = M @ M.T + np.eye(8)
    x = {r.j: r.x for r in G.conjugate_gradient(coo(spark, s), spark.createDataFrame([(i, float(i)) for i in range(8)], "i long, v double"), 8).collect()}
    assert np.allclose([x[i] for i in range(8)], np.linalg.solve(s, np.arange(8.0)))
    assert G.power_iteration(coo(spark, s), 8)[0] == pytest.approx(np.linalg.eigvalsh(s)[-1], rel=1e-5)


def test_graph(spark):
    w = [(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 5.0), (4, 5, 1.0), (3, 0, 7.0)]
    e = spark.createDataFrame(w, "src long, dst long, w double")
    assert {r.v: r.component for r in G.connected_components(e, spark.createDataFrame([(9,)], "v long")).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 9: 9}
    d = {(r.source, r.v): r.distance for r in G.shortest_paths(e, spark.createDataFrame([(0,), (3,)], "v long")).collect()}
    assert d == {(0, 0): 0, (0, 1): 3, (0, 2): 1, (0, 3): 8, (3, 3): 0, (3, 0): 7, (3, 2): 8, (3, 1): 10}
    with pytest.raises(ValueError):
        G.shortest_paths(spark.createDataFrame([(0, 1, -1.0), (1, 0, -1.0)], "src long, dst long, w double"), spark.createDataFrame([(0,)], "v long"))
    assert {(r.v, r.depth) for r in G.breadth_first(e, 0).collect()} == {(0, 0), (1, 1), (2, 1), (3, 1)}
    assert sorted((r.src, r.dst) for r in G.minimum_spanning_tree(e).collect()) == [(0, 2), (1, 3), (2, 1), (4, 5)]
    lap = dense(G.laplacian(e), (6, 6))
    assert np.allclose(lap.sum(0), 0) and lap[0, 0] == 12 and lap[0, 1] == -4
    assert G.triangle_count(e) == 2
    rank = {r.v: r["rank"] for r in G.pagerank(e).collect()}
    assert sum(rank.values()) == pytest.approx(1)


def test_mdp(spark):
    p = rng.random((5, 3, 5))
    p /= p.sum(-1, keepdims=True)
    r = rng.random((5, 3))
    t = spark.createDataFrame([(s, a, q, float(p[s, a, q])) for s in range(5) for a in range(3) for q in range(5)], "s int, a int, s2 int, p double")
    rew = spark.createDataFrame([(s, a, float(r[s, a])) for s in range(5) for a in range(3)], "s int, a int, r double")
    v = np.zeros(5)
    for _ in range(400):
        q = r + 0.7 * p @ v
        v = q.max(1)
    got = {x.s: (x.value, x.action) for x in G.value_iteration(t, rew, 0.7, tol=1e-7).collect()}
    assert np.allclose([got[s][0] for s in range(5)], v, atol=1e-6) and [got[s][1] for s in range(5)] == q.argmax(1).tolist()


def test_distances(spark, points):
    two = spark.createDataFrame([(X[0].tolist(), X[1].tolist(), [1.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0])], "a array<double>, b array<double>, t array<double>, u array<double>")
    d = lambda m, a="a", b="b": two.select(P.METRICS[m](F.col(a), F.col(b))).first()[0]
    a, b = X[0], X[1]
    assert d("euclidean") == pytest.approx(np.linalg.norm(a - b)) and d("cityblock") == pytest.approx(abs(a - b).sum()) and d("chebyshev") == pytest.approx(abs(a - b).max())
    assert d("cosine") == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) and d("correlation") == pytest.approx(1 - np.corrcoef(a, b)[0, 1])
    assert d("canberra") == pytest.approx((abs(a - b) / (abs(a) + abs(b))).sum()) and d("jaccard", "t", "u") == pytest.approx(1 / 3) and d("dice", "t", "u") == pytest.approx(1 / 5) and d("hamming", "t", "u") == 0.25
    assert two.select(P.minkowski(F.col("a"), F.col("b"), 3.0)).first()[0] == pytest.approx((abs(a - b) ** 3).sum() ** (1 / 3))
    assert P.pdist(points, "x").count() == 60 * 59 // 2
    dist = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    for block in (20_000, 17):
        near = P.knn(points, points, "x", 3, block=block).collect()
        assert sorted((r.i, r.j) for r in near) == sorted((i, int(j)) for i in range(60) for j in np.argsort(dist[i], kind="stable")[:3])


def test_clusters(points):
    book, _ = P.kmeans(points, "x", X[:3])
    c = X[:3]
    for _ in range(100):
        near = ((X[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([X[near == k].mean(0) for k in range(3)])
    assert np.allclose(book, c, atol=1e-3)
    values, vectors = P.pca(points, "x", 2)
    assert np.allclose(values, np.linalg.eigvalsh(np.cov(X.T))[::-1][:2]) and np.allclose(abs((vectors @ vectors.T)), np.eye(2), atol=1e-9)
    assert np.allclose(P.gram(points, "x"), X.T @ X)
    z = P.linkage(X[:12], "single")
    assert np.all(np.diff(z[:, 2]) >= 0) and z[-1, 3] == 12 and len(set(P.fcluster(z, 4, "maxclust"))) == 4
    flat = points.select("id", *(F.element_at("x", k + 1).alias(f"c{k}") for k in range(4)))
    assert np.allclose(P.lstsq(flat, ["c0", "c1"], "c2"), np.linalg.lstsq(np.c_[np.ones(60), X[:, :2]], X[:, 2], rcond=None)[0])
    hull = P.convex_hull(flat, "c0", "c1")
    area = 0.5 * sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1]))
    assert area > 0 and all(any(np.allclose(h, p) for p in X[:, :2]) for h in hull)


def test_more_decisions_and_systems(spark):
    p = rng.random((4, 2, 4))
    p /= p.sum(-1, keepdims=True)
    r = rng.random((4, 2))
    t = spark.createDataFrame([(s, a, q, float(p[s, a, q])) for s in range(4) for a in range(2) for q in range(4)], "s int, a int, s2 int, p double")
    rew = spark.createDataFrame([(s, a, float(r[s, a])) for s in range(4) for a in range(2)], "s int, a int, r double")
    v = np.zeros(4)
    for _ in range(100):
        v = (r + 0.4 * p @ v).max(1)
    got = {x.s: x for x in G.policy_iteration(t, rew, 0.4).collect()}
    assert np.allclose([got[s].value for s in range(4)], v, atol=1e-6) and [got[s].action for s in range(4)] == (r + 0.4 * p @ v).argmax(1).tolist()
    w = np.zeros(4)
    for _ in range(3):
        w = (r + p @ w).max(1)
    assert np.allclose([x.value for x in G.finite_horizon(t, rew, 3).where("t = 0").orderBy("s").collect()], w)
    policy = spark.createDataFrame([(s, 0) for s in range(4)], "s int, a int")
    runs = spark.range(600).select(F.col("id").alias("run"), F.lit(0).alias("s"))
    first = [x.s for x in G.simulate(t, policy, runs, 1, key=3).where("t = 1").collect()]
    assert len(first) == 600 and np.allclose(np.bincount(first, minlength=4) / 600, p[0, 0], atol=0.08)
    a = rng.random((9, 4))
    x = {q.j: q.x for q in G.lsqr(coo(spark, a), spark.createDataFrame([(i, float(i)) for i in range(9)], "i long, v double"), 4).collect()}
    assert np.allclose([x[k] for k in range(4)], np.linalg.lstsq(a, np.arange(9.0), rcond=None)[0], atol=1e-6)
    assert G.depth_first(spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "src long, dst long"), 0) == [0, 1, 3, 2]
