"""Statistics over columns. Data pass through one or two aggregates; what comes back to the driver is a row of moments,
from which a test's statistic and p-value follow. Rank tests rank the distinct values with their counts, by a distributed
scan."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import special as S
from gridlark.functions import ufuncs as U
from gridlark.operators import reduce as R
from gridlark.operators import scan

Test = tuple[float, float]


def _over(a: float | None, b: float | None) -> float:
    """a / b by IEEE rules: what doesn't vary gives NaN or an infinity and no error; nulls are NaN."""
    with np.errstate(all="ignore"):
        return float(np.divide(np.nan if a is None else float(a), np.nan if b is None else float(b)))


def _root(x: float | None) -> float:
    return math.sqrt(x) if x is not None and x >= 0 else math.nan


def _clean(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _moments(df: DataFrame, *columns: str) -> dict[str, tuple[int, float, float]]:
    """count, mean and sample variance of each column."""
    cells = [f(_clean(c)).alias(f"{c}_{i}") for c in columns for i, f in enumerate((F.count, F.avg, F.var_samp))]
    r = df.agg(*cells).first()
    return {c: tuple(r[f"{c}_{i}"] for i in range(3)) for c in columns}


def _two_sided(t: float, df: float, alternative: str = "two-sided") -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    low = float(S.stdtr(df, t))
    return {"two-sided": 2 * min(low, 1 - low) if abs(t) < 30 else 2 * float(S.stdtr(df, -abs(t))), "less": low, "greater": float(S.stdtr(df, -t))}[alternative]


# Descriptive


def describe(df: DataFrame, c: str, nan_policy: str = "propagate") -> DataFrame:
    """nan_policy: propagate (a NaN counts and spreads) or omit. Nulls are left out."""
    x = _clean(c) if nan_policy == "omit" else F.col(c).cast("double")
    bad = F.coalesce(F.bool_or(F.isnan(x)), F.lit(False))
    told = lambda f: F.when(bad, float("nan")).otherwise(f)
    varied = lambda f: told(F.when(F.count(x) > 0, F.coalesce(f, F.lit(float("nan")))))
    return df.agg(F.count(x).alias("nobs"), told(F.min(x)).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), varied(F.var_samp(x)).alias("variance"), varied(F.skewness(x)).alias("skewness"), varied(F.kurtosis(x)).alias("kurtosis"))


def zscore(c: str, by: list[str] = [], ddof: int = 0) -> Column:  # noqa: B006
    """Within groups. For a whole table use `standardise`, which needs no window."""
    w = Window.partitionBy(*by)
    return U.divide(F.col(c) - F.avg(c).over(w), (F.stddev_pop(c) if ddof == 0 else F.stddev(c)).over(w))


def standardise(df: DataFrame, c: str, output: str = "z") -> DataFrame:
    """(c - mean) / std over the whole table; NaN where nothing varies."""
    m, s = df.agg(F.avg(c), F.stddev_pop(c)).first()
    return df.withColumn(output, U.divide(F.col(c) - F.lit(m).cast("double"), F.lit(s).cast("double")))


#: Aggregates by name, for groupBy(...).agg(...).
AGGREGATES = {
    "gmean": lambda x: F.exp(F.avg(F.log(x))), "hmean": lambda x: F.count(x) / F.sum(1 / x), "sem": lambda x: F.stddev(x) / F.sqrt(F.count(x)), "variation": lambda x: F.stddev_pop(x) / F.avg(x),
    "iqr": lambda x: F.percentile(x, 0.75) - F.percentile(x, 0.25), "mode": lambda x: F.mode(x, True), "tmean": F.avg, "tvar": F.var_samp, "tstd": F.stddev, "tmin": F.min, "tmax": F.max, "tsem": lambda x: F.stddev(x) / F.sqrt(F.count(x)),
    "gstd": lambda x: F.exp(F.stddev(F.log(x))), "skew": F.skewness, "kurtosis": F.kurtosis, "circmean": lambda x: F.pmod(F.atan2(F.sum(F.sin(x)), F.sum(F.cos(x))), F.lit(2 * math.pi)),
    "circvar": lambda x: 1 - F.sqrt(F.pow(F.avg(F.sin(x)), 2) + F.pow(F.avg(F.cos(x)), 2)), "circstd": lambda x: F.sqrt(-2 * F.log(F.sqrt(F.pow(F.avg(F.sin(x)), 2) + F.pow(F.avg(F.cos(x)), 2)))),
}


def summarise(df: DataFrame, by: list[str], c: str, names: list[str]) -> DataFrame:
    """by and the AGGREGATES named, of c. The interquartile range comes from quantiles by ranges: as an aggregate, all distinct
    values of a group meet in one task."""
    plain = [n for n in names if n != "iqr"]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *(AGGREGATES[n](F.col(c)).alias(n) for n in plain))
    if "iqr" in names:
        ends = scan.few(scan.quantiles(df, by, F.col(c), {"__q1": 0.25, "__q3": 0.75}).select(F.struct(*by).alias("__by"), (F.col("__q3") - F.col("__q1")).alias("iqr")))
        out = out.join(ends, F.struct(*by) == F.col("__by"), "left")
    return out.select(*by, *names)


def pmean(x: Column, p: float) -> Column:
    return F.exp(F.avg(F.log(x))) if p == 0 else F.pow(F.avg(F.pow(x, p)), 1 / p)


def moment(df: DataFrame, c: str, order: int) -> float:
    m = df.agg(F.avg(_clean(c))).first()[0]
    return df.agg(F.avg(F.pow(_clean(c) - m, order))).first()[0]


def median_abs_deviation(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """by, mad. Medians by ranges, for groups of any size."""
    mid = scan.quantiles(df, by, F.col(c), {"__mid": 0.5})
    off = df.join(scan.few(mid), by).select(*by, F.abs(F.col(c) - F.col("__mid")).alias("__off"))
    return scan.quantiles(off, by, F.col("__off"), {"mad": 0.5})


def trim_mean(df: DataFrame, c: str, share: float) -> float:
    """Mean without the `share` lowest and highest values: places come from counts of distinct values."""
    counts = df.groupBy(F.col(c).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null")
    run = scan.prefix_scan(counts, [F.col("v")], F.col("n"), "upto", zero=0)
    total = df.where(F.col(c).isNotNull()).count()
    cut = int(share * total)
    inside = F.greatest(F.least(F.col("upto"), F.lit(total - cut)) - F.greatest(F.col("upto") - F.col("n"), F.lit(cut)), F.lit(0))
    r = run.agg(F.sum(F.col("v") * inside).alias("s"), F.sum(inside).alias("k")).first()
    return _over(r.s, r.k)


def percentileofscore(df: DataFrame, c: str, score: float, kind: str = "rank") -> float:
    x = F.col(c)
    r = df.agg(F.count_if(x < score).alias("l"), F.count_if(x <= score).alias("u"), F.count(x).alias("n")).first()
    return 100 * {"rank": (r.l + r.u + (r.u > r.l)) / 2, "weak": r.u, "strict": r.l, "mean": (r.l + r.u) / 2}[kind] / r.n


def entropy(df: DataFrame, p: str, q: str | None = None, base: float | None = None) -> float:
    one = df.agg(F.sum(p).alias("__p"), *([F.sum(q).alias("__q")] if q else []))
    both = df.crossJoin(F.broadcast(one))
    pk = F.col(p) / F.col("__p")
    term = F.when(pk > 0, pk * F.log(pk / (F.col(q) / F.col("__q")))) if q else F.when(pk > 0, -pk * F.log(pk))
    return both.agg(F.sum(term)).first()[0] / (math.log(base) if base else 1)


# Correlation and regression


def pearsonr(df: DataFrame, x: str, y: str) -> Test:
    """NaN where either side doesn't vary."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r, n = both.agg(R.corr(_clean(x), _clean(y)), F.count(F.lit(1))).first()
    r = math.nan if r is None else r
    return r, _two_sided(r * math.sqrt(max(n - 2, 0) / max(1 - r * r, 1e-300)), n - 2)


def spearmanr(df: DataFrame, x: str, y: str) -> Test:
    both = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = scan.rankdata(scan.rankdata(both, x, "__rx"), y, "__ry")
    return pearsonr(ranked, "__rx", "__ry")


pointbiserialr = pearsonr


def linregress(df: DataFrame, x: str, y: str) -> dict[str, float]:
    a, b = _clean(x), _clean(y)
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.covar_pop(a, b).alias("c")).first()
    if not r.n:
        return dict.fromkeys(("slope", "intercept", "rvalue", "pvalue", "stderr", "intercept_stderr"), math.nan)
    slope, corr = _over(r.c, r.vx), _over(r.c, _root(r.vx * r.vy))
    error = _root(_over((1 - corr * corr) * _over(r.vy, r.vx), r.n - 2))
    return {"slope": slope, "intercept": r.my - slope * r.mx, "rvalue": corr, "pvalue": _two_sided(corr * math.sqrt(max(r.n - 2, 0) / max(1 - corr * corr, 1e-300)), r.n - 2), "stderr": error, "intercept_stderr": error * math.sqrt(r.vx + r.mx**2)}


# Tests on means and variances


def ttest_1samp(df: DataFrame, c: str, mean: float, alternative: str = "two-sided") -> Test:
    n, m, v = _moments(df, c)[c]
    t = _over(None if m is None else m - mean, _root(_over(v, n)))
    return t, _two_sided(t, n - 1, alternative)


def ttest_ind(a: DataFrame, ca: str, b: DataFrame, cb: str, equal_var: bool = True, alternative: str = "two-sided") -> Test:
    (n, m, v), (k, p, w) = _moments(a, ca)[ca], _moments(b, cb)[cb]
    return ttest_ind_from_stats(m, _root(v), n, p, _root(w), k, equal_var, alternative)


def ttest_ind_from_stats(m1, s1, n1, m2, s2, n2, equal_var: bool = True, alternative: str = "two-sided") -> Test:
    v1, v2 = _over(s1 * s1, n1), _over(s2 * s2, n2)
    if equal_var:
        df = n1 + n2 - 2
        error = _root(_over((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, df) * (_over(1, n1) + _over(1, n2)))
    else:
        df = _over((v1 + v2) ** 2, _over(v1 * v1, n1 - 1) + _over(v2 * v2, n2 - 1))
        error = _root(v1 + v2)
    t = _over(None if m1 is None or m2 is None else m1 - m2, error)
    if math.isnan(df):
        return t, math.nan
    return t, _two_sided(t, df, alternative)


def ttest_rel(df: DataFrame, x: str, y: str, alternative: str = "two-sided") -> Test:
    return ttest_1samp(df.select((F.col(x) - F.col(y)).alias("__d")), "__d", 0.0, alternative)


def f_oneway(df: DataFrame, group: str, c: str) -> Test:
    g = df.groupBy(group).agg(F.count(_clean(c)).alias("n"), F.avg(_clean(c)).alias("m"), F.var_pop(_clean(c)).alias("v"))
    r = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within")).first()
    if not r.n or r.k < 2:
        return math.nan, math.nan
    between = r.q - r.s * r.s / r.n
    f = _over(_over(between, r.k - 1), _over(r.within, r.n - r.k))
    return f, math.nan if math.isnan(f) else float(S.fdtrc(r.k - 1, r.n - r.k, f))


def levene(df: DataFrame, group: str, c: str, center: str = "median") -> Test:
    mid = {"median": F.percentile(c, 0.5), "mean": F.avg(c)}[center]
    z = df.join(df.groupBy(group).agg(mid.alias("__mid")), group).select(group, F.abs(F.col(c) - F.col("__mid")).alias("__z"))
    return f_oneway(z, group, "__z")


def bartlett(df: DataFrame, group: str, c: str) -> Test:
    g = df.groupBy(group).agg(F.count(c).alias("n"), F.var_samp(c).alias("v"))
    k = F.col("n") - 1
    r = g.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(k * F.col("v")).alias("s"), F.sum(k * F.log("v")).alias("l"), F.sum(1 / k).alias("i")).first()
    free = r.n - r.g
    t = (free * math.log(r.s / free) - r.l) / (1 + (r.i - 1 / free) / (3 * (r.g - 1)))
    return t, float(S.chdtrc(r.g - 1, t))


def jarque_bera(df: DataFrame, c: str) -> Test:
    n, s, k = df.agg(F.count(_clean(c)), F.skewness(_clean(c)), F.kurtosis(_clean(c))).first()
    t = n / 6 * (s * s + k * k / 4)
    return t, float(S.chdtrc(2, t))


def skewtest(df: DataFrame, c: str) -> Test:
    n, g = df.agg(F.count(_clean(c)), F.skewness(_clean(c))).first()
    y = g * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b - 1))
    a = math.sqrt(2 / (w2 - 1))
    z = math.asinh(y / a) / math.sqrt(0.5 * math.log(w2))
    return z, 2 * float(S.ndtr(-abs(z)))


def kurtosistest(df: DataFrame, c: str) -> Test:
    n, k = df.agg(F.count(_clean(c)), F.kurtosis(_clean(c))).first()
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (k + 3 - mean) / math.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + math.sqrt(1 + 4 / (b * b)))
    d = 1 + x * math.sqrt(2 / (a - 4))
    z = (1 - 2 / (9 * a) - math.copysign(abs((1 - 2 / a) / d) ** (1 / 3), d)) / math.sqrt(2 / (9 * a))
    return z, 2 * float(S.ndtr(-abs(z)))


def normaltest(df: DataFrame, c: str) -> Test:
    t = skewtest(df, c)[0] ** 2 + kurtosistest(df, c)[0] ** 2
    return t, float(S.chdtrc(2, t))


# Rank tests


def _ranked_groups(df: DataFrame, group: str, c: str) -> tuple[list, float, int]:
    """count and rank sum of each group, the tie sum of t**3 - t, and the number of rows."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v"), F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    values = counts.groupBy("v").agg(F.sum("n").alias("t"))
    run = scan.prefix_scan(values, [F.col("v")], F.col("t"), "upto", zero=0).withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2)
    ties, n = run.agg(F.sum(F.pow("t", 3) - F.col("t")), F.sum("t")).first()
    groups = counts.join(run, "v").groupBy("g").agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("n")).orderBy("g").collect()
    return groups, ties, n


def kruskal(df: DataFrame, group: str, c: str) -> Test:
    groups, ties, n = _ranked_groups(df, group, c)
    if not n:
        return math.nan, math.nan
    h = _over(12 / (n * (n + 1)) * sum(g.r**2 / g.n for g in groups) - 3 * (n + 1), 1 - _over(ties, n**3 - n))
    return h, math.nan if not math.isfinite(h) else float(S.chdtrc(len(groups) - 1, h))


def mannwhitneyu(df: DataFrame, group: str, c: str, first, second) -> Test:
    """By the normal approximation with tie and continuity corrections."""
    groups, ties, n = _ranked_groups(df.where(F.col(group).isin(first, second)), group, c)
    of = {g.g: g for g in groups}
    a, b = of[first], of[second]
    u = a.r - a.n * (a.n + 1) / 2
    s = _root(a.n * b.n / 12 * ((n + 1) - _over(ties, n * (n - 1))))
    z = _over(max(u, a.n * b.n - u) - a.n * b.n / 2 - 0.5, s)
    return u, min(1.0, 2 * float(S.ndtr(-z)))


def ranksums(df: DataFrame, group: str, c: str, first, second) -> Test:
    groups, _, n = _ranked_groups(df.where(F.col(group).isin(first, second)), group, c)
    of = {g.g: g for g in groups}
    a, b = of[first], of[second]
    z = (a.r - a.n * (n + 1) / 2) / math.sqrt(a.n * b.n * (n + 1) / 12)
    return z, 2 * float(S.ndtr(-abs(z)))


def wilcoxon(df: DataFrame, x: str, y: str) -> Test:
    """Signed ranks of differences, zeros left out, by the normal approximation."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d != 0").select(F.abs("d").alias("v"), (F.col("d") > 0).alias("g"))
    groups, ties, n = _ranked_groups(d, "g", "v")
    r = {g.g: g.r for g in groups}
    w = min(r.get(True, 0.0), r.get(False, 0.0))
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return w, 2 * float(S.ndtr(-abs(z)))


def _steps(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    """v, and both samples' distribution functions there."""
    both = a.select(F.col(ca).cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(cb).cast("double").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y"))).where("v is not null")
    sums = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    run = scan.prefix_scan(scan.prefix_scan(sums, [F.col("v")], F.col("x"), "fx", zero=0), [F.col("v")], F.col("y"), "fy", zero=0)
    total = sums.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    return run.crossJoin(F.broadcast(total)).select("v", (F.col("fx") / F.col("nx")).alias("fx"), (F.col("fy") / F.col("ny")).alias("fy"), (F.col("x") / F.col("nx")).alias("px"), (F.col("y") / F.col("ny")).alias("py"), "nx", "ny")


def ks_2samp(a: DataFrame, ca: str, b: DataFrame, cb: str) -> Test:
    """Statistic, and its p-value by the limiting distribution."""
    d, n, m = _steps(a, ca, b, cb).agg(F.max(F.abs(F.col("fx") - F.col("fy"))), F.max("nx"), F.max("ny")).first()
    en = math.sqrt(n * m / (n + m))
    return d, float(S.kolmogorov(en * d))


def ks_1samp(df: DataFrame, c: str, cdf: Column) -> Test:
    """cdf: a Column over `v`."""
    counts = df.groupBy(F.col(c).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = scan.prefix_scan(counts, [F.col("v")], F.col("n"), "upto", zero=0)
    n = counts.agg(F.sum("n")).first()[0]
    d = run.withColumn("f", cdf).agg(F.max(F.greatest(F.col("upto") / n - F.col("f"), F.col("f") - (F.col("upto") - F.col("n")) / n))).first()[0]
    return d, float(S.kolmogorov(math.sqrt(n) * d))


def _between(a: DataFrame, ca: str, b: DataFrame, cb: str, p: int) -> float:
    """Integral of |F - G|**p. With the values' own places as the variable it is a sum by parts: each value meets the step
    before it, so that no row needs the next one's value."""
    s = _steps(a, ca, b, cb)
    power = lambda d: F.pow(F.abs(d), p)
    own, before = F.col("fx") - F.col("fy"), F.col("fx") - F.col("px") - F.col("fy") + F.col("py")
    return s.agg(F.sum(F.col("v") * (power(before) - power(own)))).first()[0] or 0.0


def wasserstein_distance(a: DataFrame, ca: str, b: DataFrame, cb: str) -> float:
    return _between(a, ca, b, cb, 1)


def energy_distance(a: DataFrame, ca: str, b: DataFrame, cb: str) -> float:
    return math.sqrt(2 * _between(a, ca, b, cb, 2))


# Counts


def power_divergence(observed: list[float], expected: list[float] | None = None, ddof: int = 0, power: float = 1.0) -> Test:
    o = np.asarray(observed, float)
    e = np.full(len(o), o.mean()) if expected is None else np.asarray(expected, float)
    if power == 1:
        t = ((o - e) ** 2 / e).sum()
    elif power == 0:
        t = 2 * (o * np.log(np.where(o > 0, o / e, 1))).sum()
    else:
        t = 2 / (power * (power + 1)) * (o * ((o / e) ** power - 1)).sum()
    return float(t), float(S.chdtrc(len(o) - 1 - ddof, t))


chisquare = power_divergence


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, observed, expected for every pair of values."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))
    rows, cols, total = n.groupBy(a).agg(F.sum("observed").alias("__r")), n.groupBy(b).agg(F.sum("observed").alias("__c")), n.agg(F.sum("observed").alias("__n"))
    return rows.crossJoin(cols).crossJoin(total).join(n, [a, b], "left").select(a, b, F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("__r") * F.col("__c") / F.col("__n")).alias("expected"))


def chi2_contingency(df: DataFrame, a: str, b: str, correction: bool = True) -> tuple[float, float, int]:
    t = crosstab(df, a, b)
    rows, cols = t.agg(F.count_distinct(a), F.count_distinct(b)).first()
    free = (rows - 1) * (cols - 1)
    off = F.abs(F.col("observed") - F.col("expected"))
    if correction and free == 1:
        off = off - F.least(F.lit(0.5), off)
    stat = t.agg(F.sum(off * off / F.col("expected"))).first()[0]
    return stat, float(S.chdtrc(free, stat)), free


def fisher_exact(table: list[list[int]]) -> Test:
    (a, b), (c, d) = table
    n, row, col = a + b + c + d, a + b, a + c
    k = np.arange(max(0, row + col - n), min(row, col) + 1)
    lc = lambda n, k: S.gammaln(n + 1) - S.gammaln(k + 1) - S.gammaln(n - k + 1)
    p = np.exp(lc(col, k) + lc(n - col, row - k) - lc(n, row))
    own = p[k == a][0]
    return (a * d / (b * c) if b * c else math.inf), float(p[p <= own * (1 + 1e-7)].sum())


def binomtest(k: int, n: int, p: float = 0.5) -> float:
    j = np.arange(n + 1)
    pm = np.exp(S.gammaln(n + 1) - S.gammaln(j + 1) - S.gammaln(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))
    return float(min(1.0, pm[pm <= pm[k] * (1 + 1e-7)].sum()))


def combine_pvalues(p: list[float], method: str = "fisher") -> Test:
    p = np.asarray(p, float)
    if method == "fisher":
        t = -2 * np.log(p).sum()
        return float(t), float(S.chdtrc(2 * len(p), t))
    z = S.ndtri(1 - p).sum() / math.sqrt(len(p))
    return float(z), float(S.ndtr(-z))


def false_discovery_control(p: list[float], method: str = "bh") -> np.ndarray:
    p = np.asarray(p, float)
    order, n = np.argsort(p), len(p)
    q = p[order] * n / np.arange(1, n + 1) * ((1 / np.arange(1, n + 1)).sum() if method == "by" else 1)
    out = np.empty(n)
    out[order] = np.clip(np.minimum.accumulate(q[::-1])[::-1], 0, 1)
    return out


def gaussian_kde(df: DataFrame, c: str, grid: list[float], bandwidth: float | None = None) -> DataFrame:
    """x, density on a grid: each partition sums its kernels in numpy and sends one row."""
    import pyarrow as pa

    n, _, v = _moments(df, c)[c]
    h = (bandwidth or n ** (-1 / 5)) * math.sqrt(v)
    points = np.asarray(grid, float)

    def kernel(batches):
        total = np.zeros(len(points))
        for b in batches:
            x = b.column(0).drop_null().to_numpy()
            for i in range(0, len(x), 4096):
                total += np.exp(-0.5 * ((points[:, None] - x[None, i : i + 4096]) / h) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(total)], ["x", "s"])

    sums = df.select(_clean(c).alias("x")).mapInArrow(kernel, "x double, s double")
    return sums.groupBy("x").agg((F.sum("s") / (n * h * math.sqrt(2 * math.pi))).alias("density"))


def bootstrap(df: DataFrame, c: str, resamples: int = 200, seed: int = 0) -> DataFrame:
    """resample, mean, n: Poisson bootstrap, which needs no place numbers and one pass: each row counts in each resample as
    often as a keyed Poisson draw says."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda k: F.struct(k.alias("k"), (F.pmod(F.xxhash64(F.col("__id"), k, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).alias("u")))
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    times = sum((F.when(F.col("d.u") > s, 1).otherwise(0) for s in steps), F.lit(0))
    each = df.select(F.col(c).alias("x"), F.monotonically_increasing_id().alias("__id")).select("x", F.explode(draw).alias("d")).select(F.col("d.k").alias("resample"), times.alias("w"), "x")
    return each.groupBy("resample").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"), F.sum("w").alias("n"))
