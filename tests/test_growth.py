"""Plans whose tasks' memory and time don't hang on the rows of one group, range or component."""

import numpy as np
from gridlark.operators import graph as G
from gridlark.operators import scan, stats
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interp_passes_rows_backwards(spark):
    """A frame up to the last row costs the square of a range's rows."""
    rng = np.random.default_rng(2)
    x, k = rng.uniform(-1, 11, 500), np.arange(10.0)
    points = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    knots = spark.createDataFrame([(float(v), float(v * v)) for v in k], "k double, w double")
    out = scan.interp(points, knots, "x", "k", "w", "out")
    assert "unboundedfollowing" not in plan_of(out).lower()
    got = sorted((r.x, r.out) for r in out.collect())
    assert np.allclose([g[1] for g in got], np.interp(sorted(x), k, k * k))


def test_quantiles_leave_groups_spread(spark):
    df = spark.createDataFrame([("ab"[i % 10 == 0], float(i % 997)) for i in range(5000)] + [(None, 3.0)], "g string, v double")
    assert "SortMergeJoin" not in plan_of(scan.quantiles(df, ["g"], F.col("v"), {"m": 0.5}))
    got = {r.g: r.mad for r in stats.median_abs_deviation(df, "v", ["g"]).collect()}
    for g in "ab":
        v = np.array([i % 997 for i in range(5000) if "ab"[i % 10 == 0] == g], float)
        assert got[g] == np.median(abs(v - np.median(v)))


def test_interquartile_range_without_a_task_a_group(spark):
    df = spark.createDataFrame([("ab"[i % 3 == 0], float(i)) for i in range(900)] + [(None, 1.0), (None, 3.0)], "g string, v double")
    out = stats.summarise(df, ["g"], "v", ["iqr", "gmean", "sem"])
    assert "percentile" not in plan_of(out).lower() and out.columns == ["g", "iqr", "gmean", "sem"]
    got = {r.g: r.iqr for r in out.collect()}
    v = np.array([i for i in range(900) if i % 3 == 0], float)
    assert got["b"] == np.subtract(*np.quantile(v, [0.75, 0.25])) and got[None] == 1.0


def test_forest_drops_edges_within_components(spark, monkeypatch):
    """Each round had all edges before; between components few are left."""
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 900), rng.integers(0, 60, 900), rng.integers(0, 4, 900))] + [(100, 101, 1.0), (5, 5, 0.0), (7, 8, 2.0), (7, 8, 2.0)]
    sizes, plans, real = [], [], G.checkpoint

    def noted(df):
        out = real(df)
        plans.append(plan_of(df))
        if df.columns == ["a", "b", "place"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "checkpoint", noted)
    got = sorted((r.src, r.dst, r.w) for r in G.minimum_spanning_tree(spark.createDataFrame(rows, "src long, dst long, w double")).collect())
    assert sizes and sizes[-1] == 0 and sizes[0] <= 902 and all(b < a for a, b in zip(sizes, sizes[1:])) and not any("SortAggregate" in p for p in plans)
    root = {}
    find = lambda v: v if root.get(v, v) == v else find(root[v])
    want = []
    for w, a, b in sorted((w, a, b) for a, b, w in rows if a != b):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    assert got == sorted(want)
