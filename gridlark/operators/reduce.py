"""Reductions over an axis: aggregates grouped by the kept axes, with array-library NaN and tie rules.

Each is a Column for use in groupBy(...).agg(...), so partial aggregation happens before the shuffle.

Edge cases: sums and maxima of whole numbers stay whole and exact (min_ and argmin by whole=True); all else is in doubles.
A NaN spreads, but in NAN_AWARE. Nulls are left out; argmin and argmax pass them over. A group without values gives the
function's neutral value (sum, prod, any, all) or null. Sums of booleans need a cast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import ufuncs as U


def _nan() -> Column:
    return F.lit(float("nan"))


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _spread(c: Column, out: Column) -> Column:
    """out, or NaN where the group has one."""
    return F.when(F.bool_or(F.isnan(c)), _nan()).otherwise(out)


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_(c) -> Column:
    """In the sum's own type: whole numbers add up exactly, and beyond 64 bits are an error under ANSI mode."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def prod(c) -> Column:
    return F.coalesce(F.product(_d(c)), F.lit(1.0))


def mean(c) -> Column:
    return F.avg(_d(c))


def var(c, ddof: int = 0) -> Column:
    c, n = _d(c), F.count(_d(c))
    return F.var_pop(c) if ddof == 0 else F.when(n > ddof, F.var_pop(c) * n / F.when(n > ddof, n - ddof)).otherwise(_nan())


def std(c, ddof: int = 0) -> Column:
    return F.sqrt(var(c, ddof))


def min_(c, whole: bool = False) -> Column:
    """whole: of whole numbers, which have no NaN; kept in their type."""
    return F.min(_c(c)) if whole else _spread(_d(c), F.min(_d(c)))


def max_(c) -> Column:
    return F.max(_c(c))  # NaN is the largest, so it spreads


def ptp(c, whole: bool = False) -> Column:
    return max_(c) - min_(c, whole)


def argmin(c, index, whole: bool = False) -> Column:
    """Index of the smallest value: the first on ties, a NaN before all; nulls passed over. whole: compared as they are."""
    x = _c(c) if whole else _d(c)
    first = [] if whole else [F.when(F.isnan(x), 0).otherwise(1), F.when(F.isnan(x), 0.0).otherwise(x)]
    return F.min_by(index, F.when(x.isNotNull(), F.struct(*(first or [x]), index)))


def argmax(c, index, whole: bool = False) -> Column:
    x = _c(c) if whole else _d(c)
    first = [] if whole else [F.when(F.isnan(x), 0).otherwise(1), F.when(F.isnan(x), 0.0).otherwise(-x)]
    return F.min_by(index, F.when(x.isNotNull(), F.struct(*(first or [F.bitwise_not(x)]), index)))


def corr(x, y) -> Column:
    """Pearson's correlation of the rows that have both; NaN where either doesn't vary, as ANSI mode would raise."""
    x, y = _d(x), _d(y)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return U.divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def any_(c) -> Column:
    return F.coalesce(F.bool_or(U.truth(c)), F.lit(False))


def all_(c) -> Column:
    return F.coalesce(F.bool_and(U.truth(c)), F.lit(True))


def count_nonzero(c) -> Column:
    return F.count_if(U.truth(c))


def median(c) -> Column:
    return _spread(_d(c), F.percentile(_d(c), 0.5))


def average(c, weights) -> Column:
    return U.divide(F.sum(_d(c) * _d(weights)), F.sum(_d(weights)))


#: Variants that leave NaN out.
NAN_AWARE = {
    "nansum": lambda c: F.coalesce(F.sum(_known(_d(c))), F.lit(0.0)),
    "nanprod": lambda c: F.coalesce(F.product(_known(_d(c))), F.lit(1.0)),
    "nanmean": lambda c: F.coalesce(F.avg(_known(_d(c))), _nan()),
    "nanvar": lambda c, ddof=0: F.coalesce(var(_known(_d(c)), ddof), _nan()),
    "nanstd": lambda c, ddof=0: F.coalesce(std(_known(_d(c)), ddof), _nan()),
    "nanmin": lambda c: F.coalesce(F.min(_known(_d(c))), _nan()),
    "nanmax": lambda c: F.coalesce(F.max(_known(_d(c))), _nan()),
    "nanmedian": lambda c: F.coalesce(F.percentile(_known(_d(c)), 0.5), _nan()),
    "nanargmin": lambda c, index: argmin(_known(_d(c)), index),
    "nanargmax": lambda c, index: argmax(_known(_d(c)), index),
}

#: (alpha, beta) of the quantile methods that interpolate at n*q + alpha + q*(1 - alpha - beta) - 1. Fixed values.
INTERPOLATED = {"linear": (1.0, 1.0), "interpolated_inverted_cdf": (0.0, 1.0), "hazen": (0.5, 0.5), "weibull": (0.0, 0.0), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8)}


def quantile_of_sorted(values: Column, q: float, method: str = "linear") -> Column:
    """Quantile of a sorted array column without nulls, by any of the thirteen methods."""
    if not 0 <= q <= 1:
        raise ValueError("quantiles must be in the range [0, 1]")
    n = F.size(values)
    at = lambda i: F.element_at(values, (F.greatest(F.least(i, n - 1), F.lit(0)) + 1).cast("int"))
    if method in INTERPOLATED:
        a, b = INTERPOLATED[method]
        place = F.greatest(F.least(n * F.lit(q) + a + q * (1 - a - b) - 1, (n - 1).cast("double")), F.lit(0.0))
        low = F.floor(place)
        g = place - low
        x, y = at(low), at(low + 1)
        out = F.when(g >= 0.5, y - (y - x) * (1 - g)).otherwise(x + (y - x) * g)
    elif method in ("inverted_cdf", "averaged_inverted_cdf", "closest_observation"):
        shift = 0.5 if method == "closest_observation" else 0.0
        place = n * F.lit(q) - 1 - shift
        low = F.floor(place)
        g = place - low
        step = F.when(g == 0, F.pmod(low, F.lit(2)).cast("double") if shift else F.lit(0.5 if method.startswith("averaged") else 0.0)).otherwise(1.0)
        x, y = at(low), at(low + 1)
        out = F.when(step == 0, x).when(step == 1, y).otherwise((x + y) / 2)
    else:
        place = (n - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out = {"lower": low, "higher": high, "midpoint": (low + high) / 2, "nearest": at(F.rint(place).cast("int"))}[method]
    return F.when(n > 0, F.when(F.isnan(F.element_at(values, -1)), _nan()).otherwise(out)).otherwise(_nan())


def quantile(c, q: float, method: str = "linear") -> Column:
    """The linear method goes by Spark's percentile, whose buffers hold counts of distinct values; the others collect a
    group's values. Both are for groups that fit a task; scan.quantiles takes groups of any size."""
    if method == "linear":
        return _spread(_d(c), F.percentile(_d(c), q))
    return quantile_of_sorted(F.array_sort(F.collect_list(_d(c))), q, method)


def moments(c) -> dict[str, Column]:
    """Central moments' statistics: biased skewness and excess kurtosis among them, NaN where nothing varies."""
    c = _d(c)
    varied = lambda f: F.when(F.count(c) > 0, F.coalesce(f, _nan()))
    return {"mean": F.avg(c), "var": F.var_pop(c), "skew": varied(F.skewness(c)), "kurtosis": varied(F.kurtosis(c))}


def covariance(x, y, ddof: int = 1) -> Column:
    return F.covar_samp(_d(x), _d(y)) if ddof == 1 else F.covar_pop(_d(x), _d(y))


def cov_matrix(df: DataFrame, columns: list[str], *, correlation: bool = False) -> DataFrame:
    """i, j, v of the covariance (or correlation) matrix of columns: one aggregate over the table, then a small unpivot."""
    f = corr if correlation else lambda a, b: F.when(F.count(F.when(_d(b).isNotNull(), _d(a))) > 1, F.covar_samp(_d(a), _d(b))).otherwise(_nan())
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), f(a, b).alias("v")) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
