"""Distances, neighbours and clusters over points held as (id, ARRAY of coordinates).

Distances are expressions over array pairs, or tiles of two blocks of points. All pairs and neighbours go block by block;
clusters keep their few centres on the driver and aggregate the points."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def _centred(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)
    return F.transform(a, lambda x: x - mean)


def _cosine(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def _truth(f: Callable[[Column, Column, Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A dissimilarity of boolean vectors by its counts: both, first only, second only, neither."""
    n = lambda a, b, t: _sum(a, b, lambda x, y: F.when(t(x != 0, y != 0), 1.0).otherwise(0.0))
    return lambda a, b: f(n(a, b, lambda x, y: x & y), n(a, b, lambda x, y: x & ~y), n(a, b, lambda x, y: ~x & y), n(a, b, lambda x, y: ~x & ~y))


#: Distance of two array columns, by name.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "sqeuclidean": lambda a, b: _sum(a, b, lambda x, y: (x - y) * (x - y)), "euclidean": lambda a, b: F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y))),
    "cityblock": lambda a, b: _sum(a, b, lambda x, y: F.abs(x - y)), "chebyshev": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))),
    "cosine": _cosine, "correlation": lambda a, b: _cosine(_centred(a), _centred(b)), "hamming": lambda a, b: _sum(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)) / F.size(a),
    "braycurtis": lambda a, b: _sum(a, b, lambda x, y: F.abs(x - y)) / _sum(a, b, lambda x, y: F.abs(x + y)), "canberra": lambda a, b: _sum(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))),
    "jensenshannon": lambda a, b: _jensenshannon(a, b), "jaccard": _truth(lambda tt, tf, ft, ff: F.when(tt + tf + ft == 0, 0.0).otherwise((tf + ft) / (tt + tf + ft))), "dice": _truth(lambda tt, tf, ft, ff: (tf + ft) / (2 * tt + tf + ft)),
    "rogerstanimoto": _truth(lambda tt, tf, ft, ff: 2 * (tf + ft) / (tt + ff + 2 * (tf + ft))), "russellrao": _truth(lambda tt, tf, ft, ff: 1 - tt / (tt + tf + ft + ff)), "sokalsneath": _truth(lambda tt, tf, ft, ff: 2 * (tf + ft) / (tt + 2 * (tf + ft))), "yule": _truth(lambda tt, tf, ft, ff: F.when(tf * ft == 0, 0.0).otherwise(2 * tf * ft / (tt * ff + tf * ft))),
}
METRICS["manhattan"] = METRICS["cityblock"]


def _jensenshannon(a: Column, b: Column) -> Column:
    p = F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    q = F.transform(b, lambda x: x / F.aggregate(b, F.lit(0.0), lambda s, y: s + y))
    half = lambda u, v: _sum(u, v, lambda x, y: F.when(x > 0, x * F.log(2 * x / (x + y))).otherwise(0.0))
    return F.sqrt((half(p, q) + half(q, p)) / 2)


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(_sum(a, b, lambda x, y: F.pow(F.abs(x - y), p)), 1 / p)


def seuclidean(a: Column, b: Column, variances: list[float]) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.array(*map(F.lit, variances)), lambda d, v: d / v), F.lit(0.0), lambda s, x: s + x))


def mahalanobis(a: Column, b: Column, inverse: list[list[float]]) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    rows = [F.aggregate(F.zip_with(d, F.array(*map(F.lit, r)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for r in inverse]
    return F.sqrt(_dot(d, F.array(*rows)))


#: Points of a block at most, and the tile of distances that a task holds at a time (rows, columns).
BLOCK, TILE = 20_000, (64, 2048)


def _by_coordinate(step: Callable[[np.ndarray, np.ndarray], np.ndarray], join: np.ufunc = np.add, last: Callable | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of all pairs, a coordinate at a time: the differences of two points are never held together."""

    def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        for u, v in zip(a.T, b.T):
            join(out, step(u[:, None], v[None]), out=out)
        return last(out) if last else out

    return tile


def _square(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = u - v
    return np.multiply(d, d, out=d)


def _away(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = u - v
    return np.abs(d, out=d)


#: Distances of all pairs of two blocks' rows, for the metrics that have them.
TILES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "sqeuclidean": _by_coordinate(_square), "euclidean": _by_coordinate(_square, last=np.sqrt), "cityblock": _by_coordinate(_away), "manhattan": _by_coordinate(_away), "chebyshev": _by_coordinate(_away, np.maximum),
    "cosine": lambda a, b: 1 - a @ b.T / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None]),
}


def _unpacked(points: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of coordinates, short ones filled up with zeros, and their widths; -1 for a null or one with a null."""
    points = points.combine_chunks()
    if isinstance(points, pa.ChunkedArray):
        points = pa.concat_arrays(points.chunks) if points.num_chunks else pa.array([], points.type)
    width, flat = np.diff(np.asarray(points.offsets)), points.flatten()
    if len(points) and not points.null_count and not flat.null_count and (width == width[0]).all():
        return flat.to_numpy(zero_copy_only=False).reshape(len(points), -1), width
    rows = points.to_pylist()
    known = np.array([r is not None and None not in r for r in rows], bool)
    x = np.zeros((len(rows), max((len(r) for r in rows if r), default=0)))
    for i in np.flatnonzero(known):
        x[i, : len(rows[i])] = rows[i]
    return x, np.array([len(r) if k else -1 for r, k in zip(rows, known)], int)


def _block_pairs(left: DataFrame, right: DataFrame | None, point: str, block: int, kernel: Callable, schema: str) -> DataFrame:
    """What the kernel yields (record batches) for each pair of a block of left and one of right: ids, points and widths of
    both. Without right, of each two blocks of left once; the second is None for a block with itself.

    A block has `block` points at most on average; a task meets a pair at a time and holds its two blocks."""
    alone, cores = right is None, left.sparkSession.sparkContext.defaultParallelism
    counts = [df.count() for df in (left, right) if df is not None]
    parts = [max(1, -(-n // block), min(math.isqrt((32 if alone else 16) * cores), n // 256)) for n in counts]  # small tables are cut for the cores' sake
    own = lambda df, n: df.select(F.col(df.columns[0]).alias("i"), F.col(point).cast("array<double>").alias("x"), F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).alias("c"))
    if alone:
        m = parts[0]
        p, q = F.least("c", "k"), F.greatest("c", "k")
        rows = own(left, m).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
        rows, pairs = rows.select("i", "x", (F.col("c") > p).alias("second"), (F.expr("least(c, k) * (2 * %d - least(c, k) + 1) div 2" % m) + q - p).alias("pair")), m * (m + 1) // 2
    else:
        m, n = parts
        a = own(left, m).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select("i", "x", F.lit(False).alias("second"), (F.col("c") * n + F.col("k")).alias("pair"))
        b = own(right, n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))).select("i", "x", F.lit(True).alias("second"), (F.col("k") * n + F.col("c")).alias("pair"))
        rows, pairs = a.unionByName(b), m * n

    def run(batches):
        def done():
            t = pa.Table.from_batches(held)
            second = t.column("second").to_numpy()
            sides = [t.filter(pa.array(second == side)) for side in (False, True)]
            sides = [(s.column("i").combine_chunks(), *_unpacked(s.column("x"))) for s in sides]
            return kernel(sides[0], None if alone and not second.any() else sides[1])

        held, at = [], None
        for b in batches:
            pair = b.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    if held and pair[s] != at:
                        yield from done()
                        held = []
                    at = pair[s]
                    held.append(b.slice(s, e - s))
        if held:
            yield from done()

    return rows.repartitionById(pairs, F.col("pair").cast("int")).sortWithinPartitions("pair").mapInArrow(run, schema)


def _distances(left: DataFrame, right: DataFrame | None, point: str, metric: str) -> DataFrame:
    names = [dict(df.dtypes)[df.columns[0]] for df in (left, left if right is None else right)]
    tile, alone = TILES[metric], right is None

    def kernel(a, b):
        (ai, ax, aw), (bi, bx, bw) = a, a if b is None else b
        width = max(ax.shape[1], bx.shape[1])
        ax, bx = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (ax, bx))
        for s in range(0, len(ax), TILE[0]):
            for t in range(0, len(bx), TILE[1]):
                u, v = slice(s, s + TILE[0]), slice(t, t + TILE[1])
                with np.errstate(all="ignore"):
                    d = tile(ax[u], bx[v])
                unlike = (aw[u, None] != bw[None, v]) | (aw[u, None] < 0)
                i, j = ai.take(pa.array(np.repeat(np.arange(len(ai))[u], d.shape[1]))), bi.take(pa.array(np.tile(np.arange(len(bi))[v], d.shape[0])))
                out = pa.table({"i": i, "j": j, "d": pa.array(d.ravel(), mask=unlike.ravel() if unlike.any() else None)})
                if alone:
                    less = pc.less(i, j)
                    if b is None:
                        out = out.filter(less)
                    else:
                        out = pa.table({"i": pc.if_else(less, i, j), "j": pc.if_else(less, j, i), "d": out.column("d")})
                yield from out.to_batches()

    return _block_pairs(left, right, point, BLOCK, kernel, f"i {names[0]}, j {names[1]}, d double")


def cdist(a: DataFrame, b: DataFrame, point: str, metric: str = "euclidean") -> DataFrame:
    """i, j, d of every pair, which is the result asked for: a tile of two blocks at a time, or by the metric's expression
    where it has no tiles. The side that is then counted to be small is broadcast."""
    if metric in TILES:
        return _distances(a, b, point, metric)
    right = b.select(F.col(b.columns[0]).alias("j"), F.col(point).alias("__b"))
    if right.limit(10_001).count() <= 10_000:
        right = F.broadcast(right)
    left = a.select(F.col(a.columns[0]).alias("i"), F.col(point).alias("__a")).repartition(4 * a.sparkSession.sparkContext.defaultParallelism)
    return left.crossJoin(right).select("i", "j", METRICS[metric](F.col("__a"), F.col("__b")).alias("d"))


def pdist(a: DataFrame, point: str, metric: str = "euclidean") -> DataFrame:
    """i < j, d. Ids aren't null."""
    return _distances(a, None, point, metric) if metric in TILES else cdist(a, a, point, metric).where("i < j")


def _nearest(qx: np.ndarray, px: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, of their k nearest points (which are in order of id), and distances. Products of matrices tell which
    points may be among the k, with room for their error; those are measured by their differences."""
    k = min(k, len(px))
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    safe = np.isfinite(qx).all() and np.isfinite(px).all()
    middle = px.mean(0) if safe else 0.0
    p, q = px - middle, qx - middle
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    room = 8 * (px.shape[1] + 8) * 2.0**-53 * (qq + pp.max(initial=0))
    for s in range(0, len(qx), 128):
        if safe:
            with np.errstate(all="ignore"):
                near = q[s : s + 128] @ p.T
                near *= -2
                near += pp
                edge = np.partition(near, k - 1, axis=1)[:, k - 1] + room[s : s + 128]
            rows, places = np.nonzero(~(near > edge[:, None]))
            cuts = np.searchsorted(rows, np.arange(len(near) + 1))
        for r in range(len(qx[s : s + 128])):
            at = places[cuts[r] : cuts[r + 1]] if safe else np.arange(len(px))
            d = np.sqrt(((px[at] - qx[s + r]) ** 2).sum(1))
            best = np.argsort(d, kind="stable")[:k]
            found.append((s + r, at[best], d[best]))
    return np.repeat([f[0] for f in found], k).astype(int), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])


def knn(queries: DataFrame, points: DataFrame, point: str, k: int, block: int = BLOCK) -> DataFrame:
    """i, j, d of the k nearest points to each query by Euclidean distance, the lower id first on ties.

    Points go by blocks of bounded size; each block meets each block of queries once, as matrices, and leaves its own k
    best a query; what is merged is k rows a query and block."""
    names = [dict(df.dtypes)[df.columns[0]] for df in (queries, points)]

    def kernel(a, b):
        (qi, qx, qw), (pi, px, pw) = a, b
        if len(qi) and len(pi):
            if (qw != qw[0]).any() or (pw != qw[0]).any() or qw[0] < 0:
                raise ValueError("points must have as many coordinates as each other, none of them null")
            order = pc.sort_indices(pi)
            i, j, d = _nearest(qx, px[order.to_numpy()], k)
            yield pa.RecordBatch.from_arrays([qi.take(pa.array(i)), pi.take(order).take(pa.array(j)), pa.array(d)], ["i", "j", "d"])

    found = _block_pairs(queries, points, point, block, kernel, f"i {names[0]}, j {names[1]}, d double")
    w = Window.partitionBy("i").orderBy("d", "j")
    return found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def vq(df: DataFrame, point: str, code_book: np.ndarray) -> DataFrame:
    """df with code and dist of the nearest centre; the first on ties. The code book is a parameter of bounded size."""
    book = np.asarray(code_book, float)

    @F.arrow_udf("code int, dist double")
    def nearest(a: pa.Array) -> pa.Array:
        x = np.array(a.to_pylist(), float).reshape(len(a), -1)
        d = np.sqrt(((x[:, None] - book[None]) ** 2).sum(-1))
        code = d.argmin(1)
        return pa.StructArray.from_arrays([pa.array(code, pa.int32()), pa.array(d[np.arange(len(x)), code])], ["code", "dist"])

    return df.withColumn("__n", nearest(F.col(point))).select("*", "__n.code", "__n.dist").drop("__n")


def _centres(coded: DataFrame, point: str) -> tuple[dict[int, np.ndarray], float]:
    """Mean of each code's points, and the mean distance; partial sums before the shuffle."""
    width = len(coded.select(point).first()[0])
    sums = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("d"), *(F.sum(F.element_at(point, k + 1).cast("double")).alias(f"s{k}") for k in range(width))).collect()  # a row a centre
    n = sum(r.n for r in sums)
    return {r.code: np.array([r[f"s{k}"] for k in range(width)]) / r.n for r in sums}, sum(r.d for r in sums) / n


def kmeans(df: DataFrame, point: str, code_book: np.ndarray, thresh: float = 1e-5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Lloyd's rounds from a given code book until the mean distance changes by at most thresh; centres without points are
    dropped."""
    book, last = np.asarray(code_book, float), math.inf
    for _ in range(rounds):
        found, distance = _centres(vq(df, point, book), point)
        book = np.array([found[c] for c in sorted(found)])
        if abs(last - distance) <= thresh:
            return book, distance
        last = distance
    raise RuntimeError(f"k-means did not settle in {rounds} rounds")


def whiten(df: DataFrame, point: str) -> DataFrame:
    width = len(df.select(point).first()[0])
    s = df.agg(*(F.stddev_pop(F.element_at(point, k + 1)) for k in range(width))).first()
    scale = F.array(*(F.lit(float(x) or 1.0) for x in s))
    return df.withColumn(point, F.zip_with(point, scale, lambda x, y: x / y))


def gram(df: DataFrame, point: str) -> np.ndarray:
    """X'X of the points as rows: each task sums its own products; the driver adds one matrix a task."""
    def partial(batches):
        total = None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    parts = df.select(point).mapInArrow(partial, "g array<double>")
    cells = parts.select(F.posexplode("g").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    n = math.isqrt(len(cells))
    return np.array([r.v for r in cells]).reshape(n, n)


def lstsq(df: DataFrame, features: list[str], target: str, intercept: bool = True) -> np.ndarray:
    """Least squares by the normal equations: one pass for X'X and X'y."""
    columns = [*(["__one"] if intercept else []), *features, target]
    wide = df.select(F.array(*((F.lit(1.0) if c == "__one" else F.col(c).cast("double")) for c in columns)).alias("x"))
    g = gram(wide, "x")
    return np.linalg.solve(g[:-1, :-1], g[:-1, -1])


def pca(df: DataFrame, point: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances and directions (rows) of the k first principal components, by the covariance matrix."""
    width = len(df.select(point).first()[0])
    r = df.agg(F.count(F.lit(1)), *(F.avg(F.element_at(point, j + 1).cast("double")) for j in range(width))).first()
    n, mean = r[0], np.array(r[1:])
    values, vectors = np.linalg.eigh((gram(df, point) - n * np.outer(mean, mean)) / (n - 1))
    return values[::-1][:k], vectors[:, ::-1].T[:k]


def linkage(points: np.ndarray, method: str = "single") -> np.ndarray:
    """Agglomerative clusters of points that fit the driver: rows (a, b, distance, size), by Lance and Williams' updates."""
    x = np.asarray(points, float)
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), len(d))
        i, j = min(i, j), max(i, j)
        a, b, ni, nj = d[i], d[j], size[i], size[j]
        if method == "single":
            new = np.minimum(a, b)
        elif method == "complete":
            new = np.maximum(a, b)
        elif method == "average":
            new = (ni * a + nj * b) / (ni + nj)
        elif method == "weighted":
            new = (a + b) / 2
        elif method == "ward":
            nk, t = np.array(size), ni + nj + np.array(size)
            new = np.sqrt(((ni + nk) * a * a + (nj + nk) * b * b - nk * d[i, j] ** 2) / t)
        elif method == "centroid":
            new = np.sqrt(np.maximum((ni * a * a + nj * b * b) / (ni + nj) - ni * nj * d[i, j] ** 2 / (ni + nj) ** 2, 0))
        else:
            new = np.sqrt(np.maximum((a * a + b * b) / 2 - d[i, j] ** 2 / 4, 0))
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), d[i, j], ni + nj))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        ids[i], size[i] = n + step, ni + nj
        del ids[j], size[j]
    return np.array(out)


def fcluster(z: np.ndarray, t: float, criterion: str = "distance") -> np.ndarray:
    """Flat clusters: under a distance, or at most t of them."""
    n = len(z) + 1
    root = list(range(2 * n - 1))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    cut = t if criterion == "distance" else (z[n - 1 - int(t), 2] if t < n else -1.0)
    for k, (a, b, d, _) in enumerate(z):
        if (d <= cut) if criterion == "distance" else k < n - int(t):
            root[find(int(a))] = root[find(int(b))] = n + k
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names) + 1) for i in range(n)])


def convex_hull(points: DataFrame, x: str, y: str) -> list[tuple[float, float]]:
    """Corners counter-clockwise. Each task keeps its own hull; the driver joins these, some corners a task."""
    def hull(p: list[tuple[float, float]]) -> list[tuple[float, float]]:
        p = sorted(set(p))
        if len(p) < 3:
            return p
        def chain(q):
            out: list = []
            for c in q:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(c)
            return out[:-1]
        return chain(p) + chain(p[::-1])

    def own(batches):
        kept: list = []
        for b in batches:
            kept = hull(kept + list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in kept], pa.float64()), pa.array([c[1] for c in kept], pa.float64())], ["x", "y"])

    parts = points.select(F.col(x).cast("double"), F.col(y).cast("double")).dropna().mapInArrow(own, "x double, y double")
    return hull([(r.x, r.y) for r in parts.collect()])
