"""Arrays in long form: a DataFrame with one row an element, index columns i0, i1, ... and the value v.

Views become plans: a slice is a filter on index columns (which Parquet statistics can prune), a transpose renames them, a
reshape computes them. Nothing is moved until an operator needs it. Index columns are explicit, so no operator relies on
the order of rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import ufuncs as U

#: Promotion by kind, then by size; scalars are weak. Names of element types and their Spark types.
TYPES = {"float64": "double", "float32": "float", "int64": "long", "int32": "int", "uint8": "short", "bool": "boolean", "complex128": "struct<re:double,im:double>"}
ITEMSIZE = {"float64": 8, "float32": 4, "int64": 8, "int32": 4, "uint8": 1, "bool": 1, "complex128": 16}
_ORDER = ["bool", "uint8", "int32", "int64", "float32", "float64", "complex128"]


def promote(a: str, b: str) -> str:
    """Type of an operation on two arrays."""
    if a == b:
        return a
    pair = sorted((a, b), key=_ORDER.index)
    if pair[1] == "float32" and pair[0] in ("int32", "int64"):
        return "float64"
    return pair[1]


def broadcast_shapes(*shapes: Sequence[int]) -> tuple[int, ...]:
    out: list[int] = []
    for dims in itertools.zip_longest(*(reversed(s) for s in shapes), fillvalue=1):
        sizes = {d for d in dims if d != 1}
        if len(sizes) > 1:
            raise ValueError(f"shapes {shapes} can't be broadcast together")
        out.append(sizes.pop() if sizes else 1)
    return tuple(reversed(out))


class NDFrame:
    """An n-dimensional array as a DataFrame of (i0, ..., v) and its shape."""

    def __init__(self, df: DataFrame, shape: Sequence[int], dtype: str = "float64"):
        self.df, self.shape, self.dtype = df, tuple(int(s) for s in shape), dtype

    ndim = property(lambda self: len(self.shape))
    size = property(lambda self: math.prod(self.shape))
    nbytes = property(lambda self: self.size * ITEMSIZE[self.dtype])
    axes = property(lambda self: [f"i{k}" for k in range(self.ndim)])

    def _like(self, columns: Sequence[Column], value: Column | str = "v", shape: Sequence[int] | None = None, df: DataFrame | None = None, dtype: str | None = None) -> NDFrame:
        v = F.col(value) if isinstance(value, str) else value
        cols = [c.cast("long").alias(f"i{k}") for k, c in enumerate(columns)]
        return NDFrame((df if df is not None else self.df).select(*cols, v.alias("v")), self.shape if shape is None else shape, dtype or self.dtype)

    def _axis(self, axis: int) -> int:
        if not -self.ndim <= axis < self.ndim:
            raise IndexError(f"axis {axis} is out of bounds for {self.ndim} dimensions")
        return axis % self.ndim

    # Making and taking out

    @staticmethod
    def _grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
        """Index columns of a shape from one range: no cross join."""
        flat = spark.range(math.prod(shape)).withColumnRenamed("id", "__flat")
        return flat.select("__flat", *(F.expr(f"(__flat div {max(math.prod(shape[k + 1 :]), 1)}) % {max(s, 1)}").alias(f"i{k}") for k, s in enumerate(shape)))

    @classmethod
    def full(cls, spark: SparkSession, shape: Sequence[int], value: float, dtype: str = "float64") -> NDFrame:
        return cls(cls._grid(spark, shape).drop("__flat").withColumn("v", F.lit(value).cast(TYPES[dtype])), shape, dtype)

    @classmethod
    def zeros(cls, spark, shape, dtype="float64") -> NDFrame:
        return cls.full(spark, shape, 0, dtype)

    @classmethod
    def ones(cls, spark, shape, dtype="float64") -> NDFrame:
        return cls.full(spark, shape, 1, dtype)

    @classmethod
    def arange(cls, spark: SparkSession, start: float, stop: float | None = None, step: float = 1) -> NDFrame:
        if stop is None:
            start, stop = 0, start
        n = max(0, math.ceil((stop - start) / step))
        whole = all(isinstance(x, int) for x in (start, stop, step))
        return cls(spark.range(n).select(F.col("id").alias("i0"), (F.lit(start) + F.col("id") * step).cast("long" if whole else "double").alias("v")), (n,), "int64" if whole else "float64")

    @classmethod
    def linspace(cls, spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True) -> NDFrame:
        step = (stop - start) / max(num - endpoint, 1)
        v = F.when((F.col("id") == num - 1) & F.lit(endpoint and num > 1), float(stop)).otherwise(start + F.col("id") * step)
        return cls(spark.range(num).select(F.col("id").alias("i0"), v.alias("v")), (num,))

    @classmethod
    def geomspace(cls, spark: SparkSession, start: float, stop: float, num: int = 50) -> NDFrame:
        grid = cls.linspace(spark, math.log10(start), math.log10(stop), num)
        return grid._like([F.col("i0")], F.pow(F.lit(10.0), F.col("v")))

    @classmethod
    def eye(cls, spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> NDFrame:
        a = cls.zeros(spark, (n, m or n))
        return a._like([F.col("i0"), F.col("i1")], (F.col("i1") - F.col("i0") == k).cast("double"))

    @classmethod
    def array(cls, spark: SparkSession, data) -> NDFrame:
        import numpy as np

        a = np.asarray(data, float)
        rows = [(*map(int, i), float(x)) for i, x in np.ndenumerate(a)]
        return cls(spark.createDataFrame(rows, ", ".join([f"i{k} long" for k in range(a.ndim)] + ["v double"])), a.shape)

    @classmethod
    def from_cells(cls, df: DataFrame, row: str, cell: str, width: int, rows: int) -> NDFrame:
        """A matrix of one row a cell; row: its number."""
        return cls(df.select(F.col(row).cast("long").alias("i0"), F.posexplode(cell).alias("i1", "v")).withColumns({"i1": F.col("i1").cast("long"), "v": F.col("v").cast("double")}), (rows, width))

    def to_cells(self) -> DataFrame:
        """i0, cell: each first-axis row as an array, in order."""
        return self.df.groupBy("i0").agg(F.transform(F.array_sort(F.collect_list(F.struct(*self.axes[1:], "v"))), lambda s: s["v"]).alias("cell"))

    def to_numpy(self):
        import numpy as np

        out = np.zeros(self.shape)
        for r in self.df.collect():
            out[tuple(r[: self.ndim])] = r[self.ndim]
        return out

    # Views

    def transpose(self, axes: Sequence[int] | None = None) -> NDFrame:
        axes = list(range(self.ndim))[::-1] if axes is None else [self._axis(a) for a in axes]
        return self._like([F.col(f"i{a}") for a in axes], shape=[self.shape[a] for a in axes])

    def swap_axes(self, a: int, b: int) -> NDFrame:
        order = list(range(self.ndim))
        order[self._axis(a)], order[self._axis(b)] = order[self._axis(b)], order[self._axis(a)]
        return self.transpose(order)

    def move_axis(self, source: int, destination: int) -> NDFrame:
        order = [k for k in range(self.ndim) if k != self._axis(source)]
        order.insert(self._axis(destination), self._axis(source))
        return self.transpose(order)

    def flat(self) -> Column:
        """Place of an element in row-major order."""
        return sum((F.col(f"i{k}") * math.prod(self.shape[k + 1 :]) for k in range(self.ndim)), F.lit(0))

    def reshape(self, *shape: int) -> NDFrame:
        shape = list(shape[0] if len(shape) == 1 and not isinstance(shape[0], int) else shape)
        if -1 in shape:
            shape[shape.index(-1)] = self.size // max(1, -math.prod(shape))
        if math.prod(shape) != self.size:
            raise ValueError(f"can't reshape {self.shape} to {tuple(shape)}")
        f = self.flat()
        return self._like([F.floor(f / math.prod(shape[k + 1 :])) % shape[k] for k in range(len(shape))], shape=shape)  # exact below 2**53 elements

    def ravel(self) -> NDFrame:
        return self.reshape(self.size)

    def expand_dims(self, axis: int) -> NDFrame:
        shape = list(self.shape)
        axis = axis % (self.ndim + 1)
        cols = [F.col(a) for a in self.axes]
        return self._like([*cols[:axis], F.lit(0), *cols[axis:]], shape=[*shape[:axis], 1, *shape[axis:]])

    def squeeze(self) -> NDFrame:
        keep = [k for k, s in enumerate(self.shape) if s != 1]
        return self._like([F.col(f"i{k}") for k in keep], shape=[self.shape[k] for k in keep])

    def broadcast_to(self, shape: Sequence[int]) -> NDFrame:
        if broadcast_shapes(self.shape, shape) != tuple(shape):
            raise ValueError(f"can't broadcast {self.shape} to {shape}")
        lead = len(shape) - self.ndim
        df = self.df.toDF(*[f"i{k + lead}" for k in range(self.ndim)], "v")
        for k, s in enumerate(shape):
            if k < lead or self.shape[k - lead] != s:
                df = df.drop(f"i{k}").withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s - 1).cast("long"))))
        return self._like([F.col(f"i{k}") for k in range(len(shape))], shape=shape, df=df)

    def __getitem__(self, spec) -> NDFrame:
        """Slices, whole numbers, None and one ellipsis; or a boolean NDFrame of the same shape, giving a vector."""
        if isinstance(spec, NDFrame):
            return self.filter(spec)
        spec = list(spec) if isinstance(spec, tuple) else [spec]
        given = sum(s is not None and s is not Ellipsis for s in spec)
        if given > self.ndim:
            raise IndexError("too many indices")
        if Ellipsis in spec:
            at = spec.index(Ellipsis)
            spec[at : at + 1] = [slice(None)] * (self.ndim - given)
        spec += [slice(None)] * (self.ndim - sum(s is not None for s in spec))
        df, columns, shape, axis = self.df, [], [], 0
        for s in spec:
            if s is None:
                columns.append(F.lit(0))
                shape.append(1)
                continue
            i, n = F.col(f"i{axis}"), self.shape[axis]
            if isinstance(s, slice):
                r = range(n)[s]
                if len(r) < n or r.step != 1:
                    low, high = (r[0], r[-1]) if len(r) else (0, -1)
                    df = df.where(i.between(min(low, high), max(low, high)) & ((i - low) % r.step == 0)) if len(r) else df.where("false")
                columns.append(((i - (r[0] if len(r) else 0)) / r.step))
                shape.append(len(r))
            else:
                if not -n <= s < n:
                    raise IndexError(f"index {s} is out of bounds for axis {axis} of size {n}")
                df = df.where(i == s % n)
            axis += 1
        return self._like(columns, shape=shape, df=df)

    def flip(self, axis: int | None = None) -> NDFrame:
        axes = range(self.ndim) if axis is None else [self._axis(axis)]
        return self._like([(self.shape[k] - 1 - F.col(f"i{k}")) if k in axes else F.col(f"i{k}") for k in range(self.ndim)])

    def roll(self, shift: int, axis: int = -1) -> NDFrame:
        a = self._axis(axis)
        return self._like([F.pmod(F.col(f"i{k}") + shift, F.lit(self.shape[k])) if k == a else F.col(f"i{k}") for k in range(self.ndim)])

    def rot90(self, k: int = 1) -> NDFrame:
        out = self
        for _ in range(k % 4):
            out = out.swap_axes(0, 1).flip(0)
        return out

    def diagonal(self, offset: int = 0) -> NDFrame:
        n, m = self.shape[:2]
        size = max(0, min(n, m - offset) if offset >= 0 else min(n + offset, m))
        return self._like([F.least("i0", "i1")], shape=[size], df=self.df.where(F.col("i1") - F.col("i0") == offset))

    def trace(self, offset: int = 0) -> float:
        return self.diagonal(offset).df.agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]

    def diag(self, k: int = 0) -> NDFrame:
        n = self.shape[0] + abs(k)
        filled = self._like([F.col("i0") + max(-k, 0), F.col("i0") + max(k, 0)], shape=[n, n])
        return NDFrame.zeros(self.df.sparkSession, (n, n)).overlay(filled)

    def tril(self, k: int = 0) -> NDFrame:
        return self.map(lambda v: F.when(F.col("i1") - F.col("i0") <= k, v).otherwise(0.0))

    def triu(self, k: int = 0) -> NDFrame:
        return self.map(lambda v: F.when(F.col("i1") - F.col("i0") >= k, v).otherwise(0.0))

    # Joining, repeating, padding

    def overlay(self, other: NDFrame) -> NDFrame:
        """self with the elements that other has."""
        o = other.df.withColumnRenamed("v", "__o")
        return self._like([F.col(a) for a in self.axes], F.coalesce("__o", "v"), df=self.df.join(o, self.axes, "left"))

    @staticmethod
    def concatenate(parts: Sequence[NDFrame], axis: int = 0) -> NDFrame:
        a, start, dfs = parts[0]._axis(axis), 0, []
        for p in parts:
            dfs.append(p.df.withColumn(f"i{a}", F.col(f"i{a}") + start))
            start += p.shape[a]
        df = dfs[0]
        for d in dfs[1:]:
            df = df.unionByName(d)
        shape = list(parts[0].shape)
        shape[a] = start
        return NDFrame(df, shape, parts[0].dtype)

    @staticmethod
    def stack(parts: Sequence[NDFrame], axis: int = 0) -> NDFrame:
        return NDFrame.concatenate([p.expand_dims(axis) for p in parts], axis)

    def repeat(self, n: int, axis: int = -1) -> NDFrame:
        a, shape = self._axis(axis), list(self.shape)
        shape[a] *= n
        df = self.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return self._like([F.col(f"i{k}") * n + F.col("__k") if k == a else F.col(f"i{k}") for k in range(self.ndim)], shape=shape, df=df)

    def tile(self, n: int, axis: int = -1) -> NDFrame:
        a, shape = self._axis(axis), list(self.shape)
        df = self.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        out = self._like([F.col(f"i{k}") + F.col("__k") * shape[a] if k == a else F.col(f"i{k}") for k in range(self.ndim)], df=df)
        shape[a] *= n
        return NDFrame(out.df, shape, self.dtype)

    def pad(self, before: int, after: int, axis: int = -1, mode: str = "constant", value: float = 0.0) -> NDFrame:
        """Modes constant, edge (nearest), reflect (about the middle of the edge element), symmetric and wrap: each source
        element is sent to the places that it fills."""
        a, n = self._axis(axis), self.shape[self._axis(axis)]
        shape = list(self.shape)
        shape[a] = n + before + after
        if mode == "constant":
            return NDFrame.full(self.df.sparkSession, shape, float(value)).overlay(self._like([F.col(f"i{k}") + before if k == a else F.col(f"i{k}") for k in range(self.ndim)], shape=shape))
        source: dict[int, list[int]] = {}
        period = {"reflect": max(2 * n - 2, 1), "symmetric": 2 * n, "wrap": n}.get(mode)
        for out in range(shape[a]):
            i = out - before
            if mode == "edge":
                i = min(max(i, 0), n - 1)
            else:
                i %= period
                i = i if i < n else (period - i if mode == "reflect" else period - 1 - i)
            if out < before or out >= before + n:
                source.setdefault(i, []).append(out)
        extra = self.df.sparkSession.createDataFrame([(i, o) for i, outs in source.items() for o in outs] or [(-1, -1)], "__i long, __o long")
        own = self._like([F.col(f"i{k}") + before if k == a else F.col(f"i{k}") for k in range(self.ndim)])
        more = self.df.join(F.broadcast(extra), F.col(f"i{a}") == F.col("__i"))
        return NDFrame(own.df.unionByName(self._like([F.col("__o") if k == a else F.col(f"i{k}") for k in range(self.ndim)], df=more).df), shape, self.dtype)

    # Picking and putting

    def filter(self, mask: NDFrame) -> NDFrame:
        """Elements where the mask holds, numbered in row-major order by a distributed scan."""
        from gridlark.operators.scan import with_index

        m = mask.df.withColumnRenamed("v", "__m")
        kept = self.df.join(m, self.axes).where(F.col("__m").cast("boolean")).select(self.flat().alias("__f"), "v")
        df = with_index(kept, [F.col("__f")], "i0").select("i0", "v")
        return NDFrame(df, (kept.count(),), self.dtype)

    def take(self, indices: DataFrame, n: int, axis: int = 0, mode: str = "raise") -> NDFrame:
        """indices: (k, i): for each new place the old one; an index join. Modes raise, wrap, clip."""
        a, size = self._axis(axis), self.shape[self._axis(axis)]
        i = F.col("i")
        i = F.pmod(i, F.lit(size)) if mode == "wrap" else F.greatest(F.least(i, F.lit(size - 1)), F.lit(0)) if mode == "clip" else F.when(i.between(-size, size - 1), F.pmod(i, F.lit(size))).otherwise(F.raise_error(F.lit("IndexError: index out of bounds")).cast("long"))
        df = self.df.join(indices.select(i.alias("__i"), F.col("k").alias("__k")), F.col(f"i{a}") == F.col("__i"))
        shape = list(self.shape)
        shape[a] = n
        return self._like([F.col("__k") if k == a else F.col(f"i{k}") for k in range(self.ndim)], shape=shape, df=df)

    def put(self, values: DataFrame) -> NDFrame:
        """self with the values (i, v) at row-major places."""
        f = values.select(F.col("i").alias("__f"), F.col("v").alias("__v"))
        df = self.df.withColumn("__f", self.flat()).join(f, "__f", "left")
        return self._like([F.col(a) for a in self.axes], F.coalesce("__v", "v"), df=df)

    def nonzero(self) -> DataFrame:
        return self.df.where(U.truth(F.col("v"))).select(*self.axes)

    # Arithmetic

    def map(self, f: Callable[[Column], Column] | str, dtype: str | None = None) -> NDFrame:
        """f, or the named function, of each element."""
        g = U.UNARY[f] if isinstance(f, str) else f
        return NDFrame(self.df.withColumn("v", g(F.col("v"))), self.shape, dtype or self.dtype)

    def combine(self, other: NDFrame | float, f: Callable[[Column, Column], Column] | str) -> NDFrame:
        """f of the elements of both after broadcasting: an equi-join on the axes that both have at full size."""
        g = U.BINARY[f] if isinstance(f, str) else f
        if not isinstance(other, NDFrame):
            return self.map(lambda v: g(v, F.lit(other)))
        shape = broadcast_shapes(self.shape, other.shape)
        n = len(shape)
        sides, keys = [], []
        for side, a in (("a", self), ("b", other)):
            lead = n - a.ndim
            sides.append(a.df.select(*(F.col(f"i{k}").alias(f"{side}{k + lead}") for k in range(a.ndim) if a.shape[k] == shape[k + lead]), F.col("v").alias(f"{side}v")))
        left, right = sides
        for k in range(n):
            if f"a{k}" in left.columns and f"b{k}" in right.columns:
                keys.append(left[f"a{k}"] == right[f"b{k}"])
        both = left.join(right, keys) if keys else left.crossJoin(right)  # an outer product is what it is
        axes = [F.col(f"a{k}" if f"a{k}" in left.columns else f"b{k}") for k in range(n)]
        return self._like(axes, g(F.col("av"), F.col("bv")), shape=shape, df=both, dtype=promote(self.dtype, other.dtype))

    def __add__(self, o):
        return self.combine(o, "add")

    def __sub__(self, o):
        return self.combine(o, "subtract")

    def __mul__(self, o):
        return self.combine(o, "multiply")

    def __truediv__(self, o):
        return self.combine(o, "divide")

    def __pow__(self, o):
        return self.combine(o, "power")

    def __mod__(self, o):
        return self.combine(o, "mod")

    def reduce(self, f: Callable[[Column], Column], axis: int | Sequence[int] | None = None, keepdims: bool = False) -> NDFrame:
        """An aggregate over axes: grouped by those that are kept."""
        gone = set(range(self.ndim)) if axis is None else {self._axis(a) for a in ([axis] if isinstance(axis, int) else axis)}
        keep = [k for k in range(self.ndim) if k not in gone]
        df = self.df.groupBy(*(f"i{k}" for k in keep)).agg(f(F.col("v")).alias("v"))
        if keepdims:
            return self._like([F.lit(0) if k in gone else F.col(f"i{k}") for k in range(self.ndim)], shape=[1 if k in gone else s for k, s in enumerate(self.shape)], df=df)
        return self._like([F.col(f"i{k}") for k in keep], shape=[self.shape[k] for k in keep], df=df)

    def sum(self, axis=None, keepdims=False) -> NDFrame:
        return self.reduce(F.sum, axis, keepdims)

    def matmul(self, other: NDFrame) -> NDFrame:
        """Sum over the shared axis. A small result of long arrays is summed by tasks, which each read some of the shared
        axis; else an equi-join on that axis and an aggregate that is partial before the shuffle."""
        if self.ndim == other.ndim == 2 and self.shape[0] * other.shape[1] <= SMALL_PRODUCT and max(self.shape[0], other.shape[1]) <= 4096:
            return _summed_product(self, other)
        return einsum("ij,jk->ik", self, other)

    # Types, comparison and assignment

    def astype(self, dtype: str) -> NDFrame:
        """Elements as another type: floats to whole numbers are cut towards zero, to bool by being unlike zero; whole
        numbers wrap around where they don't fit."""
        v = F.col("v")
        if dtype == "bool":
            v = U.truth(v)
        elif dtype in ("int64", "int32", "uint8"):
            v = F.when(v.cast("boolean"), 1).otherwise(0).cast("long") if self.dtype == "bool" else U.trunc(v).cast("long") if self.dtype.startswith("float") else v.cast("long")
            if dtype != "int64":
                bits = {"int32": 32, "uint8": 8}[dtype]
                v = F.pmod(v, F.lit(1 << bits))
                v = F.when(v >= 1 << (bits - 1), v - (1 << bits)).otherwise(v) if dtype == "int32" else v
        return NDFrame(self.df.withColumn("v", v.cast(TYPES[dtype])), self.shape, dtype)

    def compare(self, other: NDFrame | float, op: str) -> NDFrame:
        """equal, not_equal, less, less_equal, greater or greater_equal, element by element: an array of bool."""
        out = self.combine(other, op)
        return NDFrame(out.df, out.shape, "bool")

    def __lt__(self, o):
        return self.compare(o, "less")

    def __le__(self, o):
        return self.compare(o, "less_equal")

    def __gt__(self, o):
        return self.compare(o, "greater")

    def __ge__(self, o):
        return self.compare(o, "greater_equal")

    def where_set(self, mask: NDFrame, value: NDFrame | float) -> NDFrame:
        """self with `value` (broadcast to its shape) where the mask holds."""
        if isinstance(value, NDFrame):
            both = self.broadcast_like(value)
            marked = both.df.join(mask.df.withColumnRenamed("v", "__m"), self.axes)
            return self._like([F.col(a) for a in self.axes], F.when(F.col("__m").cast("boolean"), F.col("__w")).otherwise(F.col("v")), df=marked)
        marked = self.df.join(mask.df.withColumnRenamed("v", "__m"), self.axes)
        return self._like([F.col(a) for a in self.axes], F.when(F.col("__m").cast("boolean"), F.lit(value).cast(TYPES[self.dtype])).otherwise(F.col("v")), df=marked)

    def broadcast_like(self, value: NDFrame) -> NDFrame:
        """self with the broadcast value of each place beside its own, as __w."""
        w = value.broadcast_to(self.shape).df.withColumnRenamed("v", "__w")
        return NDFrame(self.df.join(w, self.axes), self.shape, self.dtype)

    def fill(self, value: float) -> NDFrame:
        return self.map(lambda v: F.lit(value).cast(TYPES[self.dtype]))

    def __radd__(self, o):
        return self + o

    def __rmul__(self, o):
        return self * o

    def __rsub__(self, o):
        return self.map(lambda v: F.lit(float(o)) - v)

    def __rtruediv__(self, o):
        return self.map(lambda v: U.divide(F.lit(float(o)), v))

    def __rpow__(self, o):
        return self.map(lambda v: U.power(F.lit(float(o)), v))

    def __neg__(self):
        return self.map(lambda v: -v)

    def copy(self) -> NDFrame:
        return NDFrame(self.df, self.shape, self.dtype)


#: Products of at most so many elements are summed as whole matrices by each task.
SMALL_PRODUCT = 1 << 20


def _summed_product(a: NDFrame, b: NDFrame) -> NDFrame:
    """(i, k) sums over the shared axis j: both sides are dealt by j once, a task adds up the outer products of its rows of
    j in one matrix, and the tasks' matrices are summed."""
    import numpy as np
    import pyarrow as pa

    n, m = a.shape[0], b.shape[1]
    rows = a.df.select(F.col("i1").alias("j"), F.lit(0).alias("side"), F.col("i0").alias("at"), F.col("v").cast("double").alias("v"))
    rows = rows.unionByName(b.df.select(F.col("i0").alias("j"), F.lit(1).alias("side"), F.col("i1").alias("at"), F.col("v").cast("double").alias("v")))
    parts = int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def added(batches):
        total, held = None, []

        def add(chunk):
            j, side, at, v = (np.concatenate(c) for c in zip(*chunk))
            _, place = np.unique(j, return_inverse=True)
            left, right = np.zeros((place.max() + 1, n)), np.zeros((place.max() + 1, m))
            left[place[side == 0], at[side == 0]] = v[side == 0]
            right[place[side == 1], at[side == 1]] = v[side == 1]
            return left.T @ right

        for batch in batches:
            j, side, at, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("j", "side", "at", "v"))
            if not len(j):
                continue
            # A row of j may go on in the next batch: its last one waits.
            cut = int(np.searchsorted(j, j[-1]))
            if cut:
                total = (0 if total is None else total) + add([*held, (j[:cut], side[:cut], at[:cut], v[:cut])])
                held = []
            elif held and held[-1][0][-1] != j[0]:
                total = (0 if total is None else total) + add(held)
                held = []
            held.append((j[cut:], side[cut:], at[cut:], v[cut:]))
        if held:
            total = (0 if total is None else total) + add(held)
        if total is not None:
            i, k = np.nonzero(np.ones_like(total, bool))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(total.ravel())], ["i0", "i1", "v"])

    sums = rows.repartition(parts, "j").sortWithinPartitions("j").mapInArrow(added, "i0 long, i1 long, v double")
    return NDFrame(sums.groupBy("i0", "i1").agg(F.sum("v").alias("v")), (n, m))


def einsum(labels: str, *arrays: NDFrame) -> NDFrame:
    """Sums of products by labels. Arrays are joined two by two on the labels that they share; labels that no later array
    and no result needs are summed away at once, before the next join."""
    inputs, out = labels.replace(" ", "").split("->")
    terms = inputs.split(",")
    size: dict[str, int] = {}
    frames = []
    for t, a in zip(terms, arrays):
        df = a.df
        for k, c in enumerate(t):
            size[c] = a.shape[k]
        cond = [F.col(f"i{k}") == F.col(f"i{t.index(c)}") for k, c in enumerate(t) if t.index(c) != k]
        for c in cond:
            df = df.where(c)
        own = sorted(set(t))
        df = df.select(*(F.col(f"i{t.index(c)}").alias(c) for c in own), F.col("v"))
        # Labels that no other array and no result has are summed away before any join.
        kept = [c for c in own if c in out or sum(c in u for u in terms) > 1]
        if kept != own:
            df, own = df.groupBy(*kept).agg(F.sum("v").alias("v")), kept
        frames.append((own, df))
    have, now = frames[0]
    for k, (need, df) in enumerate([*frames[1:], ([], None)]):
        if df is not None:
            right = df.withColumnRenamed("v", "__w")
            shared = [c for c in need if c in have]
            now = (now.join(right, shared) if shared else now.crossJoin(right)).withColumn("v", F.col("v") * F.col("__w")).drop("__w")
            have = sorted({*have, *need})
        later = set(out) | {c for n, _ in frames[k + 2 :] for c in n}
        keep = [c for c in have if c in later]
        if keep != have:
            now, have = now.groupBy(*keep).agg(F.sum("v").alias("v")), keep
    return NDFrame(now.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(out)), "v"), [size[c] for c in out])
