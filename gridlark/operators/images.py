"""Images: one matrix a row (cells), with numpy kernels registered under `images.`; measurements by label over long tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions import cells
from gridlark.operators.scan import quantiles

#: Names of boundary modes and of numpy's paddings that give them.
MODES = {"reflect": "symmetric", "constant": "constant", "nearest": "edge", "mirror": "reflect", "wrap": "wrap"}


def _padded(x: np.ndarray, before: Sequence[int], after: Sequence[int], mode: str, cval: float) -> np.ndarray:
    extra = {"constant_values": cval} if mode == "constant" else {}
    return np.pad(np.asarray(x, float), list(zip(before, after)), MODES[mode], **extra)


def _windows(x: np.ndarray, size: int | Sequence[int], mode: str, cval: float) -> np.ndarray:
    size = [size] * np.ndim(x) if isinstance(size, int) else list(size)
    half = [s // 2 for s in size]
    return np.lib.stride_tricks.sliding_window_view(_padded(x, half, [s - 1 - h for s, h in zip(size, half)], mode, cval), size)


def correlate(x, weights, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    w = np.asarray(weights, float)
    v = _windows(x, w.shape, mode, cval)
    return (v * w).sum(tuple(range(-w.ndim, 0)))


def convolve(x, weights, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    w = np.flip(np.asarray(weights, float))
    odd = [s // 2 if s % 2 else s // 2 - 1 for s in w.shape]
    v = np.lib.stride_tricks.sliding_window_view(_padded(x, odd, [s - 1 - h for s, h in zip(w.shape, odd)], mode, cval), w.shape)
    return (v * w).sum(tuple(range(-w.ndim, 0)))


def correlate1d(x, weights, axis: int = -1, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    shape = [1] * np.ndim(x)
    shape[axis] = len(weights)
    return correlate(x, np.reshape(weights, shape), mode, cval)


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    t = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    return g if order == 0 else g * -t / sigma**2 if order == 1 else g * (t * t / sigma**4 - 1 / sigma**2)


def gaussian_filter(x, sigma: float, order: int | Sequence[int] = 0, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    """One pass an axis."""
    out = np.asarray(x, float)
    orders = [order] * out.ndim if isinstance(order, int) else order
    for axis, k in enumerate(orders):
        out = correlate1d(out, gaussian_kernel(sigma, k)[::-1], axis, mode, cval)
    return out


def _filter(f: Callable) -> Callable:
    def run(x, size: int | Sequence[int] = 3, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
        v = _windows(x, size, mode, cval)
        return f(v.reshape(*np.shape(x), -1))

    return run


uniform_filter = _filter(lambda v: v.mean(-1))
minimum_filter = _filter(lambda v: v.min(-1))
maximum_filter = _filter(lambda v: v.max(-1))
median_filter = _filter(lambda v: np.sort(v, -1)[..., v.shape[-1] // 2])


def rank_filter(x, rank: int, size: int = 3, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    return _filter(lambda v: np.sort(v, -1)[..., rank])(x, size, mode, cval)


def percentile_filter(x, percentile: float, size: int = 3, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    n = size ** np.ndim(x)
    return rank_filter(x, min(int(n * percentile / 100), n - 1), size, mode, cval)


def generic_filter(x, f: Callable, size: int = 3, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    return _filter(lambda v: np.apply_along_axis(f, -1, v))(x, size, mode, cval)


def sobel(x, axis: int = -1, mode: str = "reflect") -> np.ndarray:
    out = correlate1d(x, [-1, 0, 1], axis, mode)
    for k in range(np.ndim(x)):
        if k != axis % np.ndim(x):
            out = correlate1d(out, [1, 2, 1], k, mode)
    return out


def prewitt(x, axis: int = -1, mode: str = "reflect") -> np.ndarray:
    out = correlate1d(x, [-1, 0, 1], axis, mode)
    for k in range(np.ndim(x)):
        if k != axis % np.ndim(x):
            out = correlate1d(out, [1, 1, 1], k, mode)
    return out


def laplace(x, mode: str = "reflect") -> np.ndarray:
    return sum(correlate1d(x, [1, -2, 1], k, mode) for k in range(np.ndim(x)))


def gaussian_laplace(x, sigma: float) -> np.ndarray:
    n = np.ndim(x)
    return sum(gaussian_filter(x, sigma, [2 * (k == j) for j in range(n)]) for k in range(n))


def gaussian_gradient_magnitude(x, sigma: float) -> np.ndarray:
    n = np.ndim(x)
    return np.sqrt(sum(gaussian_filter(x, sigma, [int(k == j) for j in range(n)]) ** 2 for k in range(n)))


def binary_structure(rank: int = 2, connectivity: int = 1) -> np.ndarray:
    return np.abs(np.indices([3] * rank) - 1).sum(0) <= connectivity


def binary_dilation(x, structure: np.ndarray | None = None, iterations: int = 1) -> np.ndarray:
    s = np.flip(binary_structure(np.ndim(x)) if structure is None else np.asarray(structure, bool))
    out = np.asarray(x, bool)
    for _ in range(iterations):
        v = _windows(out, s.shape, "constant", 0.0)
        out = (v.astype(bool) & s).any(tuple(range(-s.ndim, 0)))
    return out


def binary_erosion(x, structure: np.ndarray | None = None, iterations: int = 1) -> np.ndarray:
    s = binary_structure(np.ndim(x)) if structure is None else np.asarray(structure, bool)
    out = np.asarray(x, bool)
    for _ in range(iterations):
        v = _windows(out, s.shape, "constant", 0.0)
        out = (v.astype(bool) | ~s).all(tuple(range(-s.ndim, 0)))
    return out


def binary_opening(x) -> np.ndarray:
    return binary_dilation(binary_erosion(x))


def binary_closing(x) -> np.ndarray:
    return binary_erosion(binary_dilation(x))


def binary_propagation(seed, mask) -> np.ndarray:
    out = np.asarray(seed, bool) & np.asarray(mask, bool)
    while True:
        new = binary_dilation(out) & np.asarray(mask, bool)
        if (new == out).all():
            return out
        out = new


def binary_fill_holes(x) -> np.ndarray:
    x = np.asarray(x, bool)
    wide = np.pad(~x, 1, constant_values=True)
    seed = np.zeros_like(wide)
    seed[tuple([0] * x.ndim)] = True
    return ~binary_propagation(seed, wide)[tuple([slice(1, -1)] * x.ndim)]


def grey_opening(x, size: int = 3) -> np.ndarray:
    return maximum_filter(minimum_filter(x, size), size)


def grey_closing(x, size: int = 3) -> np.ndarray:
    return minimum_filter(maximum_filter(x, size), size)


def morphological_gradient(x, size: int = 3) -> np.ndarray:
    return maximum_filter(x, size) - minimum_filter(x, size)


def white_tophat(x, size: int = 3) -> np.ndarray:
    return np.asarray(x, float) - grey_opening(x, size)


def black_tophat(x, size: int = 3) -> np.ndarray:
    return grey_closing(x, size) - np.asarray(x, float)


def label(x) -> np.ndarray:
    """Components of neighbours along the axes, numbered in scan order: the least place spreads until it settles."""
    x = np.asarray(x) != 0
    big = x.size
    place = np.where(x, np.arange(big).reshape(x.shape), big)
    while True:
        new = place
        for axis in range(x.ndim):
            for step in (1, -1):
                moved = np.full(x.shape, big)
                src, dst = [slice(None)] * x.ndim, [slice(None)] * x.ndim
                src[axis], dst[axis] = (slice(None, -1), slice(1, None)) if step == 1 else (slice(1, None), slice(None, -1))
                moved[tuple(dst)] = new[tuple(src)]
                new = np.where(x, np.minimum(new, moved), big)
        flat = np.append(new.ravel(), big)
        new = flat[new]  # a label takes its label's label
        if (new == place).all():
            break
        place = new
    _, names = np.unique(np.append(place[x], -1), return_inverse=True)
    out = np.zeros(x.shape, int)
    out[x] = names[:-1]
    return out


def find_objects(labels: np.ndarray) -> list[tuple[slice, ...] | None]:
    out = []
    for k in range(1, int(np.max(labels, initial=0)) + 1):
        at = np.nonzero(labels == k)
        out.append(tuple(slice(int(a.min()), int(a.max()) + 1) for a in at) if len(at[0]) else None)
    return out


def distance_transform_edt(x) -> np.ndarray:
    """Euclidean distance to the nearest zero, an axis at a time."""
    d = np.where(np.asarray(x) != 0, np.inf, 0.0)
    for axis in range(d.ndim):
        n = d.shape[axis]
        off = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2.0
        d = np.moveaxis((np.moveaxis(d, axis, -1)[..., None, :] + off).min(-1), -1, axis)
    return np.sqrt(d)


def distance_transform_cdt(x) -> np.ndarray:
    d = np.where(np.asarray(x) != 0, np.inf, 0.0)
    for axis in range(d.ndim):
        n = d.shape[axis]
        off = np.abs(np.arange(n)[:, None] - np.arange(n)[None]).astype(float)
        d = np.moveaxis((np.moveaxis(d, axis, -1)[..., None, :] + off).min(-1), -1, axis)
    return d


def center_of_mass(x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([(x * g).sum() / x.sum() for g in np.indices(x.shape)])


def map_coordinates(x, at, mode: str = "constant", cval: float = 0.0) -> np.ndarray:
    """Multilinear interpolation at (axis, point) coordinates."""
    x, at = np.asarray(x, float), np.asarray(at, float)
    shape = np.array(x.shape)[:, None]
    if mode == "wrap":
        at = np.mod(at, shape)
    elif mode == "nearest":
        at = np.clip(at, 0, shape - 1)
    outside = ((at < 0) | (at > shape - 1)).any(0) if mode == "constant" else np.zeros(at.shape[1], bool)
    low = np.clip(np.floor(at).astype(int), 0, shape - 1)
    g, out = np.clip(at - low, 0, 1), np.zeros(at.shape[1])
    for corner in np.ndindex(*[2] * x.ndim):
        c = np.array(corner)[:, None]
        out += np.prod(np.where(c, g, 1 - g), 0) * x[tuple(np.minimum(low + c, shape - 1))]
    return np.where(outside, cval, out)


def affine_transform(x, matrix, offset=0.0, shape=None, **options) -> np.ndarray:
    shape = np.shape(x) if shape is None else tuple(shape)
    grid = np.indices(shape).reshape(len(shape), -1)
    at = np.asarray(matrix, float) @ grid + np.reshape(np.broadcast_to(offset, len(shape)), (-1, 1))
    return map_coordinates(x, at, **options).reshape(shape)


def shift(x, by, **options) -> np.ndarray:
    return affine_transform(x, np.eye(np.ndim(x)), -np.broadcast_to(by, np.ndim(x)), **options)


def zoom(x, factor: float) -> np.ndarray:
    shape = [round(s * factor) for s in np.shape(x)]
    scale = np.diag([(a - 1) / (b - 1) if b > 1 else 0 for a, b in zip(np.shape(x), shape)])
    return affine_transform(x, scale, 0.0, shape, mode="nearest")


def rotate(x, degrees: float) -> np.ndarray:
    t = math.radians(degrees)
    m = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    c = (np.array(np.shape(x)) - 1) / 2
    return affine_transform(x, m, c - m @ c)


for _name, _kind, _f in [
    *((n, "matrix", globals()[n]) for n in "correlate convolve correlate1d gaussian_filter uniform_filter minimum_filter maximum_filter median_filter rank_filter percentile_filter sobel prewitt laplace gaussian_laplace gaussian_gradient_magnitude binary_dilation binary_erosion binary_opening binary_closing binary_fill_holes grey_opening grey_closing morphological_gradient white_tophat black_tophat label distance_transform_edt distance_transform_cdt affine_transform shift zoom rotate".split()),
    ("center_of_mass", "vector", center_of_mass),
]:
    cells.register(f"images.{_name}", _kind, _f)


def label_statistics(df: DataFrame, labels: str, value: str) -> DataFrame:
    """label, count, sum, mean, variance, min, max, median of a long table's values by label: one aggregate, and the medians
    by ranges, so that a label of any size is read by all tasks."""
    rows = df.select(F.col(labels).alias("label"), F.col(value).cast("double").alias("v"))
    v = F.col("v")
    sums = rows.groupBy("label").agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))
    mid = quantiles(rows, ["label"], v, {"median": 0.5}).withColumnRenamed("label", "__label")
    return sums.join(mid, sums["label"].eqNullSafe(mid["__label"])).drop("__label")
