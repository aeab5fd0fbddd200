"""Operators that need an order over the whole table, without bringing the table to one task.

The table is range-partitioned on the order and written to the shared checkpoint folder, as the exchange samples and its
rows may lie otherwise when it is made again. Each range is scanned on its own, and the ranges' totals (one row each) are
added as offsets: the distributed prefix scan. Nothing is kept in executors' caches.

Edge cases: a row's columns travel in one struct, so none can clash with those made on the way; an output replaces a column
of its name. Nulls count as missing: they add nothing to a running value and have no rank or place, and their rows stay. NaN
is the largest value. Repeated rows are rows of their own, in any order among themselves. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import ufuncs as U
from gridlark.operators.graph import checkpoint


def _row(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__all")


def _ranged(df: DataFrame, order: list[Column], *more: Column) -> DataFrame:
    """__all (the row), __part (its range of the order), __row (its place in order) and more columns, for good."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return checkpoint(placed.select(_row(df), F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row"), *more))


def _dealt(ranged: DataFrame) -> DataFrame:
    """The ranges dealt over as many tasks as there are ranges. A window's own exchange would be joined up by its compressed
    size, which for sorted rows is a sixtieth of what a task then holds."""
    return ranged.repartition(int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__part")


def _unpacked(df: DataFrame, columns: list[str], output: str, value: Column) -> DataFrame:
    return df.select(*(F.col("__all")[c].alias(c) for c in columns if c != output), value.alias(output))


def prefix_scan(df: DataFrame, order: list[Column], value: Column, output: str, *, total: Callable[[Column], Column] = F.sum, combine: Callable[[Column, Column], Column] = lambda a, b: a + b, zero: float | None = 0.0) -> DataFrame:
    """df with the running `total` of value in the order given. combine joins a range's running value with the total of all
    before it; where either has no value yet it is `zero` (None: stays null)."""
    ranged = _ranged(df, order, value.alias("__value"))
    within = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("__part").agg(total(F.col("__value")).alias("__sum"))  # a row a range
    before = sums.select("__part", total(F.col("__sum")).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    joined = _dealt(ranged).withColumn("__run", total(F.col("__value")).over(within)).join(F.broadcast(before), "__part")
    known = (lambda c: F.col(c)) if zero is None else (lambda c: F.coalesce(F.col(c), F.lit(zero)))
    return _unpacked(joined, df.columns, output, combine(known("__run"), known("__before")))


def cumsum(df: DataFrame, order: list[Column], value: Column, output: str = "cumsum") -> DataFrame:
    return prefix_scan(df, order, value, output)


def cumprod(df: DataFrame, order: list[Column], value: Column, output: str = "cumprod") -> DataFrame:
    return prefix_scan(df, order, value, output, total=F.product, combine=lambda a, b: a * b, zero=1.0)


def cummax(df: DataFrame, order: list[Column], value: Column, output: str = "cummax") -> DataFrame:
    """Null before the first value."""
    return prefix_scan(df, order, value, output, total=F.max, combine=F.greatest, zero=None)


def cummin(df: DataFrame, order: list[Column], value: Column, output: str = "cummin") -> DataFrame:
    """Null before the first value."""
    return prefix_scan(df, order, value, output, total=F.min, combine=F.least, zero=None)


def with_index(df: DataFrame, order: list[Column], output: str = "i") -> DataFrame:
    """df with each row's place, from 0, in the order given."""
    return prefix_scan(df, order, F.lit(1).cast("long"), output, zero=0).withColumn(output, (F.col(f"`{output}`") - 1).cast("long"))


def _counts(df: DataFrame, value: str) -> DataFrame:
    """v, n, upto: each distinct value, its count, and the count up to it; nulls left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return prefix_scan(counts, [F.col("v")], F.col("n"), "upto", zero=0)


def rankdata(df: DataFrame, value: str, output: str = "rank", method: str = "average") -> DataFrame:
    """Ranks from 1 over the whole table; a null has none. Ranks are found on the distinct values with their counts, so ties
    cost nothing, and joined back."""
    ranked = _counts(df, value)
    if method == "dense":
        ranked = with_index(ranked, [F.col("v")], "dense")
        rank = F.col("dense") + 1
    else:
        low = F.col("upto") - F.col("n") + 1
        rank = {"average": (low + F.col("upto")) / 2, "min": low, "max": F.col("upto")}[method]
    rows = df.select(_row(df), F.col(value).alias("v"))
    return _unpacked(rows.join(ranked.select("v", rank.alias("__rank")), "v", "left"), df.columns, output, F.col("__rank"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """value, ecdf: the share of rows up to each distinct value, among those that have one."""
    run = _counts(df, value)
    return run.crossJoin(F.broadcast(run.agg(F.sum("n").alias("all")))).select(F.col("v").alias(value), (F.col("upto") / F.col("all")).alias("ecdf"))


#: Rows that are sent to every task at most.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """df, found once, and broadcast if it has few rows: a join with it then leaves the other side where it is, so that a key
    with a third of all rows is not one task's."""
    df = checkpoint(df)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def quantiles(df: DataFrame, by: list[str], value: Column, levels: dict[str, float]) -> DataFrame:
    """by, and the linear quantile of each level by its name; NaN for a group with a NaN, null for one without values.

    Values are counted by group and value first, and the counts' running sums over ranges of (group, value) say where each
    quantile falls: a group of any size is read by all tasks, and none holds its values."""
    groups = df.select(F.struct(*(F.col(f"`{c}`") for c in by)).alias("g"), value.cast("double").alias("v"))
    counts = groups.groupBy("g", "v").agg(F.count("v").alias("n"))
    run = prefix_scan(counts, [F.col("g"), F.col("v")], F.col("n"), "upto", zero=0)
    whole = run.groupBy("g").agg(F.sum("n").alias("all"), F.min(F.col("upto") - F.col("n")).alias("start"), F.bool_or(F.isnan("v")).alias("bad"))
    at = F.col("upto") - F.col("start")
    place = lambda q: (F.col("all") - 1) * F.lit(float(q))
    picks = [F.min(F.when((F.col("n") > 0) & (at >= F.least(F.floor(place(q)) + k, F.col("all"))), F.col("v"))).alias(f"q{i}_{k}") for i, q in enumerate(levels.values()) for k in (1, 2)]
    found = run.join(few(whole), "g").groupBy("g").agg(F.first("all").alias("all"), F.first("bad").alias("bad"), *picks)
    share = lambda q: place(q) - F.floor(place(q))
    mixed = lambda i, q: F.when(F.col("bad"), float("nan")).otherwise(F.col(f"q{i}_1") + F.when(share(q) > 0, (F.col(f"q{i}_2") - F.col(f"q{i}_1")) * share(q)).otherwise(0.0))
    return found.select(*(F.col("g")[c].alias(c) for c in by), *(mixed(i, q).alias(name) for i, (name, q) in enumerate(levels.items())))


def diff(c: Column, over: Window, n: int = 1) -> Column:
    """n-th difference within a window's partitions; null where there is no earlier value."""
    out = c
    for _ in range(n):
        out = out - F.lag(out).over(over)
    return out


def gradient(y: Column, x: Column, over: Window) -> Column:
    """Second-order difference quotient with uneven steps, one-sided at the ends."""
    before, after = F.lag(y).over(over), F.lead(y).over(over)
    h0, h1 = x - F.lag(x).over(over), F.lead(x).over(over) - x
    inner = U.divide(h0 * h0 * after + (h1 * h1 - h0 * h0) * y - h1 * h1 * before, h0 * h1 * (h0 + h1))
    return F.when(before.isNull(), U.divide(after - y, h1)).when(after.isNull(), U.divide(y - before, h0)).otherwise(inner)


def trapezoid_parts(y: Column, x: Column, over: Window) -> Column:
    """Area between a row and the one before it; null for the first. Their sum is the trapezoid rule's."""
    return (x - F.lag(x).over(over)) * (y + F.lag(y).over(over)) / 2


def searchsorted(edges: DataFrame, edge: str, values: DataFrame, value: str, output: str = "i", side: str = "left") -> DataFrame:
    """values with the place at which each would go among the edges; null for null. Both are counted in one ordered union: no
    value meets every edge, and there is one scan over the distinct values."""
    left = edges.select(F.col(edge).cast("double").alias("v"), F.lit(1).alias("edge"))
    right = values.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("edge")).distinct()
    both = left.unionByName(right).where("v is not null").groupBy("v").agg(F.sum("edge").cast("long").alias("n"), F.count_if(F.col("edge") == 0).alias("asked"))
    run = prefix_scan(both, [F.col("v")], F.col("n"), "upto", zero=0).where("asked > 0")
    place = F.col("upto") - (F.col("n") if side == "left" else F.lit(0))
    rows = values.select(_row(values), F.col(value).cast("double").alias("v"))
    return _unpacked(rows.join(run.select("v", place.cast("long").alias("__place")), "v", "left"), values.columns, output, F.col("__place"))


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str]) -> DataFrame:
    """left with `columns` of the last right row of the same `by` at or before left's `on`; null where there is none. Of right
    rows at the same place any may be taken.

    Both sides are one ordered union: each range carries the last right row on, and the ranges' last ones (a row each) carry
    it over their edges. So a key with a third of all rows is dealt over tasks like any other."""
    key = F.struct(*(F.col(f"`{c}`") for c in by))
    a = left.select(key.alias("k"), F.col(f"`{on}`").alias("t"), F.lit(1).alias("side"), _row(left))
    b = right.where(F.col(f"`{on}`").isNotNull()).select(key.alias("k"), F.col(f"`{on}`").alias("t"), F.lit(0).alias("side"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("found"))
    both = a.unionByName(b, allowMissingColumns=True)
    ranged = _ranged(both, [F.col("k"), F.col("t"), F.col("side")]).select("__all.*", "__part", "__row").withColumn("own", F.when(F.col("side") == 0, F.struct("k", "found")))
    ends = ranged.where("side = 0").groupBy("__part").agg(F.max_by("own", "__row").alias("end"))
    parts = ranged.select("__part").distinct().join(ends, "__part", "left")
    before = parts.select("__part", F.last("end", True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    carried = _dealt(ranged).withColumn("last", F.last("own", True).over(within)).join(F.broadcast(before), "__part").where("side = 1")
    last = F.coalesce("last", "before")
    known = all_known(F.col("k"), by)
    found = F.when(known & F.col("t").isNotNull() & (last["k"] == F.col("k")), last["found"])
    return carried.select(F.col("__all").alias("row"), found.alias("found")).select(*(F.col("row")[c].alias(c) for c in left.columns), *(F.col("found")[c].alias(c) for c in columns))


def all_known(key: Column, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & key[n].isNotNull()
    return out


def interp(points: DataFrame, knots: DataFrame, x: str, xp: str, fp: str, output: str = "y") -> DataFrame:
    """Piecewise linear interpolation at points.x through knots, held at the ends; null for null; knots of any number."""
    a = points.select(F.col(x).cast("double").alias("x"), F.lit(1).alias("side"), _row(points))
    b = knots.where(F.col(xp).isNotNull()).select(F.col(xp).cast("double").alias("x"), F.lit(0).alias("side"), F.struct(F.col(xp).cast("double").alias("x"), F.col(fp).cast("double").alias("y")).alias("knot"))
    both = _ranged(a.unionByName(b, allowMissingColumns=True), [F.col("x"), F.col("side")]).select("__all.*", "__part", "__row")
    ends = both.groupBy("__part").agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    w = Window.orderBy("__part")
    ends = ends.select("__part", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.last("first", True).over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    within = Window.partitionBy("__part").orderBy("__row")
    down = F.last("knot", True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    # A frame up to the last row is found anew for each row: the rows are passed backwards instead.
    back = Window.partitionBy("__part").orderBy(F.desc("__row"))
    up = F.last("knot", True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    found = _dealt(both).withColumn("down", down).withColumn("up", up).join(F.broadcast(ends), "__part").where("side = 1")
    lo, hi, at = F.coalesce("down", "before"), F.coalesce("up", "after"), F.col("x")
    y = F.when(at.isNull(), None).when(F.isnan(at), float("nan")).when(lo.isNull(), hi["y"]).when(hi.isNull() | (lo["x"] == at), lo["y"]).otherwise(lo["y"] + U.divide((hi["y"] - lo["y"]) * (at - lo["x"]), hi["x"] - lo["x"]))
    return _unpacked(found.withColumn("__y", y), points.columns, output, F.col("__y"))


def unwrap(c: Column, over: Window, period: float = 6.283185307179586) -> Column:
    """c with jumps of more than half a period taken out, within a window's partitions."""
    d = c - F.lag(c).over(over)
    near = F.pmod(d + period / 2, F.lit(period)) - period / 2
    near = F.when((near == -period / 2) & (d > 0), F.lit(period / 2)).otherwise(near)
    step = F.when(F.abs(d) < period / 2, 0.0).otherwise(near - d)
    return c + F.coalesce(F.sum(F.coalesce(step, F.lit(0.0))).over(over.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
