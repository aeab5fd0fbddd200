"""Set operations, counting and histograms over columns as relational plans.

Edge cases: nulls are in no set and no bin; a histogram of values with a NaN or an infinity raises, as its range isn't finite;
repeated values count as often as they come; an empty table gives empty sets and bins of zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, c: str) -> DataFrame:
    """Distinct values with counts and the first index that `i`, if there is one, gives them."""
    first = [F.min("i").alias("first_index")] if "i" in df.columns else []
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("counts"), *first)


def isin(df: DataFrame, c: str, test: DataFrame, t: str, *, invert: bool = False) -> DataFrame:
    """Rows whose value is (not) among the test's; NaN is like nothing."""
    keys = test.select(F.col(t).alias("__t")).where("__t is not null").distinct()
    if dict(df.dtypes)[c] in ("double", "float"):
        keys = keys.where(~F.isnan("__t"))
    return df.join(keys, df[c] == keys["__t"], "left_anti" if invert else "left_semi")


def _one(a: DataFrame, ca: str) -> DataFrame:
    return a.select(F.col(ca).alias("value")).where("value is not null")


def union1d(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    return _one(a, ca).union(_one(b, cb)).distinct()


def intersect1d(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    return _one(a, ca).intersect(_one(b, cb))


def setdiff1d(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    return _one(a, ca).distinct().join(_one(b, cb).distinct(), "value", "left_anti")


def setxor1d(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    sides = _one(a, ca).distinct().withColumn("s", F.lit(1)).union(_one(b, cb).distinct().withColumn("s", F.lit(1)))
    return sides.groupBy("value").agg(F.sum("s").alias("s")).where("s = 1").select("value")


def first_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k first rows of an order: each task keeps its own k, and only those are merged."""
    return df.orderBy(*order).limit(k)


def bincount(df: DataFrame, c: str, *, weights: str | None = None, minlength: int = 0) -> DataFrame:
    """bin, counts for every bin from 0 to the largest value, empty ones too."""
    value = F.sum(F.col(weights).cast("double")) if weights else F.count(F.lit(1))
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("long").alias("bin")).agg(value.alias("counts"))
    top = counts.agg(F.max("bin")).first()[0]
    bins = df.sparkSession.range(max(minlength, 0 if top is None else top + 1)).withColumnRenamed("id", "bin")
    zero = F.lit(0.0) if weights else F.lit(0).cast("long")
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("counts", zero).alias("counts"))


def digitize(x: Column, edges: list[float], *, right: bool = False) -> Column:
    """Number of the bin among a few fixed edges, which must rise or fall."""
    rising = all(a <= b for a, b in zip(edges, edges[1:]))
    if not rising and not all(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("bins must be monotonically increasing or decreasing")
    x = x.cast("double")
    hit = (lambda e: e < x) if right == rising else (lambda e: e <= x)
    above = sum((F.when(hit(F.lit(float(e))), 1).otherwise(0) for e in edges), F.lit(0)).cast("long")
    return above if rising else F.lit(len(edges)).cast("long") - above


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Number of the equal-width bin; the last bin is closed; null outside. The width is checked against the edges as the
    reference library does, so a value on a rounded edge lands where its edge says."""
    width = high - low
    at = F.least(F.floor((x - low) / width * bins), F.lit(bins - 1)).cast("long")
    edge = lambda k: low + k * (width / bins)
    at = F.when(x < edge(at), at - 1).when((x >= edge(at + 1)) & (at < bins - 1), at + 1).otherwise(at)
    return F.when((x >= low) & (x <= high), at)


def _limits(df: DataFrame, c: str) -> DataFrame:
    low, high = F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))
    one = df.agg(low.alias("a"), high.alias("b"))
    finite = F.coalesce(~F.isnan("b") & (F.abs("a") != float("inf")) & (F.abs("b") != float("inf")), F.lit(True))
    one = one.select("a", F.when(finite, F.col("b")).otherwise(F.raise_error(F.lit("ValueError: the range of the values is not finite")).cast("double")).alias("b"))
    flat = F.col("a") == F.col("b")
    return one.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("__low"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("__high"))


def histogram(df: DataFrame, c: str, bins: int = 10, *, weights: str | None = None, density: bool = False) -> DataFrame:
    """bin, low, high, counts (or density). One aggregate for the range, broadcast as a row, and one for the bins."""
    binned = df.select(F.col(c).cast("double").alias("__x"), (F.col(weights).cast("double") if weights else F.lit(1)).alias("__w")).crossJoin(F.broadcast(_limits(df, c)))
    counts = binned.select(bin_of(F.col("__x"), F.col("__low"), F.col("__high"), bins).alias("bin"), "__w").where("bin is not null").groupBy("bin").agg(F.sum("__w").alias("counts"))
    edges = df.sparkSession.range(bins).select(F.col("id").alias("bin")).crossJoin(F.broadcast(_limits(df, c)))
    width = (F.col("__high") - F.col("__low")) / bins
    out = edges.join(counts, "bin", "left").select("bin", (F.col("__low") + F.col("bin") * width).alias("low"), (F.col("__low") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("counts", F.lit(0)).alias("counts"))
    if not density:
        return out
    total = out.agg(F.sum("counts").alias("__all"))
    return out.crossJoin(F.broadcast(total)).select("bin", "low", "high", (F.col("counts") / F.col("__all") / (F.col("high") - F.col("low"))).alias("density"))


def histogram2d(df: DataFrame, x: str, y: str, bins: tuple[int, int] = (10, 10)) -> DataFrame:
    """x_bin, y_bin, counts of the bins that aren't empty."""
    a, b = _limits(df, x).toDF("__xl", "__xh"), _limits(df, y).toDF("__yl", "__yh")
    both = df.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))
    at = both.select(bin_of(F.col(x).cast("double"), F.col("__xl"), F.col("__xh"), bins[0]).alias("x_bin"), bin_of(F.col(y).cast("double"), F.col("__yl"), F.col("__yh"), bins[1]).alias("y_bin"))
    return at.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("counts"))


def histogramdd(df: DataFrame, columns: list[str], bins: list[int]) -> DataFrame:
    """bin0, bin1, ..., counts of the bins that aren't empty, over any number of columns."""
    limits = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max)))).first()
    at = []
    for k, (c, n) in enumerate(zip(columns, bins)):
        low, high = limits[f"a{k}"], limits[f"b{k}"]
        if low is not None and not (math.isfinite(low) and math.isfinite(high)):
            raise ValueError("the range of the values is not finite")
        low, high = (low - 0.5, high + 0.5) if low is not None and low == high else (low or 0.0, 0.0 if high is None else high)
        at.append(bin_of(F.col(c).cast("double"), F.lit(float(low)), F.lit(float(high)), n).alias(f"bin{k}"))
    return df.select(*at).dropna().groupBy(*(f"bin{k}" for k in range(len(columns)))).agg(F.count(F.lit(1)).alias("counts"))


def bin_number(n: int, low: float, high: float, std: float, iqr: float, skew: float = 0.0, rule: str = "auto") -> int:
    """Number of bins by a rule's name, from one pass's statistics."""
    spread = high - low
    if not n or not spread:
        return 1
    sturges, fd = spread / (math.log2(n) + 1), 2 * iqr * n ** (-1 / 3)
    sg1 = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) if n > 2 else 0
    width = {
        "sturges": sturges, "fd": fd, "rice": spread / (2 * n ** (1 / 3)), "sqrt": spread / math.sqrt(n), "scott": (24 * math.pi**0.5 / n) ** (1 / 3) * std,
        "doane": spread / (1 + math.log2(n) + math.log2(1 + abs(skew) / sg1)) if sg1 else 0, "auto": min(max(fd, spread / math.sqrt(n) / 2), sturges) if fd else sturges,
    }[rule]
    return max(1, math.ceil(spread / width)) if width else 1


def binned_statistic(df: DataFrame, x: str, value: str, statistic: str = "mean", bins: int = 10) -> DataFrame:
    """bin, statistic over equal-width bins of x; bins without rows are left out."""
    v = F.col(value).cast("double")
    f = {"mean": F.avg(v), "sum": F.sum(v), "count": F.count(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "median": F.percentile(v, 0.5)}[statistic]
    at = bin_of(F.col(x).cast("double"), F.col("__low"), F.col("__high"), bins)
    return df.crossJoin(F.broadcast(_limits(df, x))).groupBy(at.alias("bin")).agg(f.alias("statistic"))
