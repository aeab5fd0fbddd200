"""Distances of all pairs and neighbours by blocks: every pair once, in tiles of bounded size, the same as pair by pair."""

import tracemalloc

import numpy as np
import pytest
from gridlark.operators import spatial as P
from pyspark.sql import functions as F

rng = np.random.default_rng(5)
X = np.r_[rng.normal(size=(560, 5)), np.ones((40, 5))]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, x array<double>")


@pytest.mark.parametrize("metric", sorted(P.TILES))
def test_tiles_give_every_pair_once(points, metric, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 130)
    monkeypatch.setattr(P, "TILE", (7, 50))
    got = P.pdist(points, "x", metric)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "MapInArrow" in plan
    rows = got.collect()
    assert len(rows) == len({(r.i, r.j) for r in rows}) == 600 * 599 // 2 and all(r.i < r.j for r in rows)
    two = points.where("id % 50 = 3")
    pair = two.select(F.col("id").alias("i"), F.col("x").alias("a")).crossJoin(points.select(F.col("id").alias("j"), F.col("x").alias("b")))
    want = {(r.i, r.j): r.d for r in pair.select("i", "j", P.METRICS[metric](F.col("a"), F.col("b")).alias("d")).collect()}
    assert all(r.d == pytest.approx(want[r.i, r.j], abs=1e-12) for r in rows if (r.i, r.j) in want)
    assert {(r.i, r.j): pytest.approx(r.d, abs=1e-12) for r in P.cdist(two, points, "x", metric).collect()} == want


def test_odd_points(spark):
    rows = [("a", [1.0, 2.0]), ("b", None), ("c", [1.0, None]), ("d", [1.0]), ("e", [float("nan"), 0.0]), ("f", [4.0, 6.0]), ("g", [3.0])]
    odd = spark.createDataFrame(rows, "id string, x array<double>")
    got = {(r.i, r.j): r.d for r in P.pdist(odd, "x").collect()}
    assert len(got) == 21 and got["a", "f"] == 5.0 and got["d", "g"] == 2.0 and np.isnan(got["a", "e"])
    assert sum(d is None for d in got.values()) == 21 - 4
    assert P.pdist(odd.where("false"), "x").count() == 0 and P.knn(odd.where("false"), odd.where("false"), "x", 2).count() == 0
    strange = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, float("inf"), 1, 5])], "id long, x array<double>")
    assert sorted((r.i, r.j) for r in P.knn(strange.where("id = 2"), strange, "x", 3).collect()) == [(2, 0), (2, 2), (2, 3)]


def test_neighbours_need_no_cube_of_differences():
    """Queries by points by coordinates were held at once for points under two million numbers: five thousand MB."""
    q = rng.normal(size=(300, 64))
    p = rng.normal(size=(20_000, 64))
    tracemalloc.start()
    i, j, d = P._nearest(q, p, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(i) == 1500
    one = np.sqrt(((p - q[7]) ** 2).sum(1))
    assert j[35:40].tolist() == np.argsort(one, kind="stable")[:5].tolist()


def test_neighbours_with_ties(points):
    dist = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    want = sorted((i, int(j)) for i in range(600) for j in np.argsort(dist[i], kind="stable")[:4])
    for block in (20_000, 90):
        assert sorted((r.i, r.j) for r in P.knn(points, points, "x", 4, block=block).collect()) == want
