import numpy as np
import pytest
from gridlark.functions import random as R
from gridlark.operators import graph as G
from pyspark.sql import functions as F

rng = np.random.default_rng(3)


def coo(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")


def test_solvers(spark):
    m = rng.random((9, 9)) * (rng.random((9, 9)) < 0.5) + 4 * np.eye(9)
    b = spark.createDataFrame([(i, float(i)) for i in range(9)], "i long, v double")
    x = {r.j: r.x for r in G.bicgstab(coo(spark, m), b, 9).collect()}
    assert np.allclose([x[i] for i in range(9)], np.linalg.solve(m, np.arange(9.0)))
    low = np.tril(m)
    for t, lower in ((low, True), (low.T, False)):
        x = {r.j: r.x for r in G.spsolve_triangular(coo(spark, t), b, 9, lower).collect()}
        assert np.allclose([x[i] for i in range(9)], np.linalg.solve(t, np.arange(9.0)))
    with pytest.raises(ValueError):
        G.spsolve_triangular(coo(spark, np.tril(m, -1)), b, 9)
    with pytest.raises(RuntimeError):
        G.bicgstab(coo(spark, m), b, 9, most=1)


def test_eigenvalues(spark):
    m = rng.normal(size=(8, 8))
    s = m + m.T
    values, vectors = G.eigsh(coo(spark, s), 8, 2, "LA")
    want, vec = np.linalg.eigh(s)
    assert np.allclose(values, want[-2:])
    got = np.zeros((2, 8))
    for r in vectors.collect():
        got[r.which, r.j] = r.x
    assert np.allclose(np.abs(got @ vec[:, -2:]), np.eye(2), atol=1e-7)
    assert np.allclose(G.svds(coo(spark, m[:, :4]), (8, 4), 2), np.linalg.svd(m[:, :4], compute_uv=False)[:2])


def test_random_vectors(spark):
    d = spark.range(4000).select("id", R.multivariate_normal(1, [1.0, -2.0], [[2.0, 0.8], [0.8, 1.0]], F.col("id")).alias("n"), R.dirichlet(50, [2, 1, 3], F.col("id")).alias("d"), R.multinomial(90, 10, [0.2, 0.5, 0.3], F.col("id")).alias("m"), R.permuted(F.array(*map(F.lit, range(5))), 7, F.col("id")).alias("p"))
    rows = d.collect()
    n, s, m, p = (np.array([list(r[c]) for r in rows], float) for c in "ndmp")
    assert np.allclose(n.mean(0), [1, -2], atol=0.12) and np.allclose(np.cov(n.T), [[2, 0.8], [0.8, 1]], atol=0.15)
    assert np.allclose(s.sum(1), 1) and np.allclose(s.mean(0), [1 / 3, 1 / 6, 1 / 2], atol=0.02)
    assert (m.sum(1) == 10).all() and np.allclose(m.mean(0), [2, 5, 3], atol=0.15)
    assert (np.sort(p, 1) == np.arange(5)).all() and np.allclose(p.mean(0), 2, atol=0.12)
    assert [list(r) for r in d.orderBy("id").limit(3).collect()] == [list(r) for r in d.repartition(5).orderBy("id").limit(3).collect()]
    assert [r.x for r in R.vectors(spark, "dirichlet", 2, [1.0, 2.0], seed=5).orderBy("id").collect()] == np.random.default_rng(5).dirichlet([1.0, 2.0], size=2).tolist()
    g = R.Generator(4)
    saved = R.state(g)
    assert g.random(3).tolist() == R.restored(saved).random(3).tolist()
