import math

import numpy as np
import pytest
from gridlark.functions import distributions as D
from gridlark.operators import stats as T
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    g = rng.integers(0, 3, 400)
    x = np.round(rng.normal(g * 0.3, 1 + g * 0.2, 400), 2)
    y = np.round(x * 0.5 + rng.normal(size=400), 2)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "g int, x double, y double").repartition(3).cache()
    return df, g, x, y


def ranks(v):
    u, inv, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[inv]


def test_correlation(data):
    df, _, x, y = data
    r, p = T.pearsonr(df, "x", "y")
    assert r == pytest.approx(np.corrcoef(x, y)[0, 1]) and 0 <= p < 1e-10
    assert T.spearmanr(df, "x", "y")[0] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    fit = T.linregress(df, "x", "y")
    assert (fit["slope"], fit["intercept"]) == pytest.approx(np.polyfit(x, y, 1))


def test_mean_tests(data):
    df, g, x, y = data
    a, b = x[g == 0], x[g == 2]
    t, p = T.ttest_ind(df.where("g = 0"), "x", df.where("g = 2"), "x", equal_var=False)
    assert t == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)))
    assert T.ttest_1samp(df, "x", 0.3)[0] == pytest.approx((x.mean() - 0.3) / (x.std(ddof=1) / 20))
    assert T.ttest_rel(df, "x", "y")[0] == pytest.approx((x - y).mean() / ((x - y).std(ddof=1) / 20))
    two = T.ttest_ind(df.where("g = 0"), "x", df.where("g = 2"), "x")
    f, pf = T.f_oneway(df.where("g != 1"), "g", "x")
    assert f == pytest.approx(two[0] ** 2) and pf == pytest.approx(two[1])  # of two groups they are one test
    groups = [x[g == k] for k in range(3)]
    between = sum(len(v) * (v.mean() - x.mean()) ** 2 for v in groups) / 2
    within = sum(((v - v.mean()) ** 2).sum() for v in groups) / (len(x) - 3)
    assert T.f_oneway(df, "g", "x")[0] == pytest.approx(between / within)
    assert T.levene(df, "g", "x")[1] < 0.05 and T.bartlett(df, "g", "x")[1] < 0.05
    assert T.ttest_ind_from_stats(1.0, 1.0, 10, 0.0, 1.0, 10)[1] == pytest.approx(2 * float(D.t(18).sf(math.sqrt(5))))


def test_rank_tests(data):
    df, g, x, y = data
    r = ranks(x)
    n = len(x)
    _, c = np.unique(x, return_counts=True)
    h = (12 / (n * (n + 1)) * sum(r[g == k].sum() ** 2 / (g == k).sum() for k in range(3)) - 3 * (n + 1)) / (1 - (c**3 - c).sum() / (n**3 - n))
    assert T.kruskal(df, "g", "x")[0] == pytest.approx(h)
    a, b = x[g == 0], x[g == 2]
    u = sum((a > v).sum() + (a == v).sum() / 2 for v in b)
    assert T.mannwhitneyu(df, "g", "x", 0, 2)[0] == pytest.approx(u) and 0 < T.mannwhitneyu(df, "g", "x", 0, 2)[1] < 1
    d = np.round(x - y, 10)
    d = d[d != 0]
    w = min(ranks(abs(d))[d > 0].sum(), ranks(abs(d))[d < 0].sum())
    assert T.wilcoxon(df.select(F.round("x", 2).alias("x"), F.round("y", 2).alias("y")).select(F.round(F.col("x") - F.col("y"), 10).alias("x"), F.lit(0.0).alias("y")), "x", "y")[0] == pytest.approx(w)


def test_distribution_tests(data):
    df, g, x, y = data
    grid = np.unique(np.concatenate([x, y]))
    fx, fy = (np.searchsorted(np.sort(v), grid, "right") / len(v) for v in (x, y))
    assert T.ks_2samp(df, "x", df, "y")[0] == pytest.approx(abs(fx - fy).max())
    assert T.wasserstein_distance(df, "x", df, "y") == pytest.approx((abs(fx - fy)[:-1] * np.diff(grid)).sum())
    assert T.energy_distance(df, "x", df, "y") == pytest.approx(math.sqrt(2 * ((fx - fy)[:-1] ** 2 * np.diff(grid)).sum()))
    s = np.sort(x)
    cdf = D.norm().cdf(s)
    want = max((np.arange(1, 401) / 400 - cdf).max(), (cdf - np.arange(400) / 400).max())
    assert T.ks_1samp(df, "x", D.norm().column("cdf", F.col("v")))[0] == pytest.approx(want)
    z = (x - x.mean()) / x.std()
    assert T.jarque_bera(df, "x")[0] == pytest.approx(400 / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4))
    assert 0 <= T.normaltest(df, "x")[1] <= 1


def test_counts(spark, data):
    df, *_ = data
    assert T.chisquare([16, 18, 16, 14, 12, 12])[0] == pytest.approx(2.0) and T.chisquare([16, 18, 16, 14, 12, 12])[1] == pytest.approx(0.84914503608460956)
    table = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 15, "a string, b string")
    stat, p, free = T.chi2_contingency(table, "a", "b", correction=False)
    o = np.array([[10, 20], [30, 15]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert stat == pytest.approx(((o - e) ** 2 / e).sum()) and free == 1
    assert T.fisher_exact([[8, 2], [1, 5]])[1] == pytest.approx(0.03496503496503495) and T.binomtest(3, 15, 0.1) == pytest.approx(0.18406106910639114)
    assert T.false_discovery_control([0.01, 0.02, 0.03, 0.5]).tolist() == pytest.approx([0.04, 0.04, 0.04, 0.5])
    assert T.combine_pvalues([0.1, 0.05, 0.02])[0] == pytest.approx(-2 * math.log(0.1 * 0.05 * 0.02))


def test_descriptive(data):
    df, g, x, y = data
    assert T.trim_mean(df, "x", 0.1) == pytest.approx(np.sort(x)[40:-40].mean())
    assert T.moment(df, "x", 3) == pytest.approx(((x - x.mean()) ** 3).mean())
    kde = {r.x: r.density for r in T.gaussian_kde(df, "x", [0.0, 1.0]).collect()}
    h = x.std(ddof=1) * 400 ** (-1 / 5)
    assert kde[1.0] == pytest.approx(np.exp(-0.5 * ((1 - x) / h) ** 2).mean() / h / math.sqrt(2 * math.pi))
    means = [r["mean"] for r in T.bootstrap(df, "x", 100).collect()]
    assert np.std(means) == pytest.approx(x.std() / 20, rel=0.3) and np.mean(means) == pytest.approx(x.mean(), abs=0.05)
    assert T.percentileofscore(df, "x", float(np.median(x))) == pytest.approx(50, abs=2)
    p = df.select(F.abs("x").alias("p"))
    q = np.abs(x) / np.abs(x).sum()
    assert T.entropy(p, "p") == pytest.approx(-(q[q > 0] * np.log(q[q > 0])).sum())
