"""Array functions over cells: each row holds whole small arrays (ARRAY columns, nested for matrices), and a kernel maps
them to a scalar or an array. Kernels run vectorised in Arrow batches, one call a cell.

The catalogue names each function once with the kind of its result; `apply` gives the Column. For arrays that are too
large for a cell use the long form (operators/), which is distributed.

Cells: double arrays; matrices are arrays of rows; complex numbers are structs of re and im. A null cell gives null."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev, hermite, hermite_e, laguerre, legendre, polynomial
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions import batches

_COMPLEX = pa.struct([("re", pa.float64()), ("im", pa.float64())])
#: Kinds of result: Spark type and Arrow type.
KINDS = {
    "scalar": ("double", pa.float64()), "whole": ("long", pa.int64()), "truth": ("boolean", pa.bool_()),
    "vector": ("array<double>", pa.list_(pa.float64())), "wholes": ("array<long>", pa.list_(pa.int64())), "matrix": ("array<array<double>>", pa.list_(pa.list_(pa.float64()))),
    "complex": ("array<struct<re:double,im:double>>", pa.list_(_COMPLEX)), "complexes": ("array<array<struct<re:double,im:double>>>", pa.list_(pa.list_(_COMPLEX))),
}

CATALOGUE: dict[str, tuple[str, Callable]] = {}


def _add(kind: str, module, names: str, prefix: str = "") -> None:
    for n in names.split():
        if (f := getattr(module, n, None)) is not None:
            CATALOGUE[prefix + n] = kind, f


_add("scalar", np, "sum prod mean var std min max ptp median average trace dot vdot inner nansum nanprod nanmean nanvar nanstd nanmin nanmax nanmedian trapezoid percentile quantile nanpercentile nanquantile")
_add("whole", np, "argmin argmax nanargmin nanargmax count_nonzero ndim size")
_add("truth", np, "any all array_equal array_equiv allclose")
_add("vector", np, "cumsum cumprod nancumsum nancumprod diff ediff1d gradient sort flip roll repeat resize tile append insert delete clip around round interp convolve correlate unwrap trim_zeros extract compress take union1d intersect1d setdiff1d setxor1d unique cumulative_sum cumulative_prod partition ravel real imag angle nan_to_num copysign bartlett blackman hamming hanning kaiser linspace logspace geomspace arange histogram_bin_edges select choose where put_along_axis take_along_axis pad poly polyfit polyval polyadd polysub polymul polyder polyint roots sinc i0 heaviside maximum minimum fmax fmin hypot arctan2 fmod mod floor_divide power logaddexp logaddexp2 add subtract multiply divide negative absolute sqrt cbrt exp exp2 expm1 log log2 log10 log1p sin cos tan arcsin arccos arctan sinh cosh tanh arcsinh arccosh arctanh degrees radians floor ceil trunc rint fix sign square reciprocal spacing nextafter ldexp fabs positive float_power remainder vecdot matvec vecmat diagonal zeros_like ones_like full_like squeeze")
_add("wholes", np, "argsort argpartition searchsorted digitize bincount nonzero flatnonzero lexsort argwhere gcd lcm bitwise_and bitwise_or bitwise_xor left_shift right_shift invert bitwise_count packbits unpackbits ravel_multi_index unravel_index")
_add("matrix", np, "outer kron diag diagflat eye identity tri tril triu vander cov corrcoef atleast_2d transpose matmul cross tensordot einsum vstack hstack dstack column_stack stack concatenate block fliplr flipud rot90 rollaxis moveaxis swapaxes reshape broadcast_to meshgrid fill_diagonal matrix_transpose expand_dims tril_indices triu_indices indices zeros ones full")
_add("scalar", np.linalg, "det norm cond matrix_norm vector_norm", "linalg.")
_add("whole", np.linalg, "matrix_rank", "linalg.")
_add("vector", np.linalg, "solve eigvalsh svdvals", "linalg.")
_add("matrix", np.linalg, "inv pinv cholesky matrix_power multi_dot tensorinv tensorsolve", "linalg.")
_add("complex", np.linalg, "eigvals", "linalg.")
_add("complex", np.fft, "fft ifft rfft hfft ihfft fftshift ifftshift", "fft.")
_add("complexes", np.fft, "fft2 ifft2 fftn ifftn rfft2 rfftn", "fft.")
_add("vector", np.fft, "irfft fftfreq rfftfreq", "fft.")
_add("matrix", np.fft, "irfft2 irfftn", "fft.")
for _module, _short, _root in ((polynomial, "poly", "polynomial"), (chebyshev, "cheb", "chebyshev"), (legendre, "leg", "legendre"), (hermite, "herm", "hermite"), (hermite_e, "herme", "hermite_e"), (laguerre, "lag", "laguerre")):
    _add("vector", _module, " ".join(_short + n for n in ("add sub mul mulx pow der int val fromroots line trim weight fit").split()) + f" poly2{_short} {_short}2poly chebpts1 chebpts2 polyvalfromroots", f"{_root}.")
    _add("matrix", _module, " ".join(_short + n for n in "vander companion val2d grid2d vander2d".split()), f"{_root}.")
    _add("complex", _module, f"{_short}roots", f"{_root}.")

#: Results of several parts are one function a part.
CATALOGUE |= {
    "linalg.qr.q": ("matrix", lambda a: np.linalg.qr(a)[0]), "linalg.qr.r": ("matrix", lambda a: np.linalg.qr(a)[1]),
    "linalg.svd.u": ("matrix", lambda a: np.linalg.svd(a, full_matrices=False)[0]), "linalg.svd.s": ("vector", lambda a: np.linalg.svd(a, compute_uv=False)), "linalg.svd.vh": ("matrix", lambda a: np.linalg.svd(a, full_matrices=False)[2]),
    "linalg.eigh.values": ("vector", lambda a: np.linalg.eigh(a)[0]), "linalg.eigh.vectors": ("matrix", lambda a: np.linalg.eigh(a)[1]),
    "linalg.eig.values": ("complex", lambda a: np.linalg.eig(a)[0]), "linalg.eig.vectors": ("complexes", lambda a: np.linalg.eig(a)[1]),
    "linalg.slogdet.sign": ("scalar", lambda a: np.linalg.slogdet(a)[0]), "linalg.slogdet.log": ("scalar", lambda a: np.linalg.slogdet(a)[1]),
    "linalg.lstsq": ("vector", lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0]), "histogram": ("wholes", lambda a, bins=10: np.histogram(a, int(bins))[0]),
    "unique_counts": ("wholes", lambda a: np.unique(a, return_counts=True)[1]), "unique_inverse": ("wholes", lambda a: np.unique(a, return_inverse=True)[1]), "divmod.quotient": ("vector", lambda a, b: np.divmod(a, b)[0]), "divmod.remainder": ("vector", lambda a, b: np.divmod(a, b)[1]),
    "frexp.mantissa": ("vector", lambda a: np.frexp(a)[0]), "frexp.exponent": ("wholes", lambda a: np.frexp(a)[1]), "modf.fraction": ("vector", lambda a: np.modf(a)[0]), "modf.whole": ("vector", lambda a: np.modf(a)[1]),
    "polydiv.quotient": ("vector", lambda a, b: np.polydiv(a, b)[0]), "polydiv.remainder": ("vector", lambda a, b: np.polydiv(a, b)[1]),
    "array_split": ("matrix", lambda a, n: np.array_split(a, int(n))), "isnan": ("wholes", np.isnan), "isfinite": ("wholes", np.isfinite), "isinf": ("wholes", np.isinf), "isin": ("wholes", np.isin), "isclose": ("wholes", np.isclose), "signbit": ("wholes", np.signbit),
}


def register(name: str, kind: str, f: Callable) -> None:
    """Add a kernel of one's own: a function of arrays, with the kind of its result."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; there are {', '.join(KINDS)}")
    CATALOGUE[name] = kind, f
    _OWN.add(name)


_OWN: set[str] = set()


def _in(v):
    if v is None or isinstance(v, (int, float, bool, str)):
        return v
    if v and isinstance(v[0], dict):
        return np.array([complex(x["re"], x["im"]) for x in v])
    return np.asarray(v)


def _out(kind: str, v):
    if v is None:
        return None
    if kind == "scalar":
        return float(v)
    if kind == "whole":
        return int(v)
    if kind == "truth":
        return bool(v)
    if isinstance(v, (tuple, list)):
        v = v[0] if kind == "wholes" else v
        if kind == "matrix" and len({len(x) for x in v}) > 1:
            return [[float(y) for y in x] for x in v]
    a = np.asarray(v)
    if kind.startswith("complex"):
        pair = lambda z: {"re": float(z.real), "im": float(z.imag)}
        a = a.astype(complex)
        return [pair(z) for z in np.atleast_1d(a)] if kind == "complex" else [[pair(z) for z in row] for row in np.atleast_2d(a)]
    if kind == "wholes":
        return np.atleast_1d(a).astype(np.int64).ravel().tolist()
    if kind == "vector":
        return np.atleast_1d(a.real if np.iscomplexobj(a) else a).astype(float).ravel().tolist()
    a = np.atleast_2d(a).astype(float)
    return a.reshape(a.shape[0], -1).tolist()


#: Kernels that take whole blocks of cells of one width, as the rows of a matrix: element by element, or along the rows.
BY_ELEMENT = frozenset("add subtract multiply divide negative absolute fabs square sqrt cbrt exp exp2 expm1 log log2 log10 log1p sin cos tan arcsin arccos arctan sinh cosh tanh arcsinh arccosh arctanh degrees radians floor ceil trunc rint sign reciprocal positive maximum minimum fmax fmin hypot arctan2 power float_power mod fmod remainder floor_divide logaddexp logaddexp2 copysign nextafter spacing sinc nan_to_num heaviside ldexp zeros_like ones_like".split())
ALONG_ROWS = frozenset("sum prod mean var std min max ptp median nansum nanprod nanmean nanvar nanstd nanmin nanmax nanmedian argmin argmax nanargmin nanargmax count_nonzero any all cumsum cumprod nancumsum nancumprod diff sort argsort partition argpartition percentile quantile nanpercentile nanquantile average trapezoid".split())


def _matrix(column: pa.Array) -> np.ndarray | None:
    """The column's cells as rows, if they are lists of one width without nulls."""
    if not pa.types.is_list(column.type) or not pa.types.is_floating(column.type.value_type) or column.null_count or not len(column):
        return None
    flat, offsets = column.flatten(), np.asarray(column.offsets)
    width = np.diff(offsets)
    return None if flat.null_count or (width != width[0]).any() or not width[0] else flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _as_block(name: str, kind: str, f: Callable, columns: tuple, options: dict) -> pa.Array | None:
    """All cells' results by one call, where the kernel and the cells allow it."""
    if name not in BY_ELEMENT and not (name in ALONG_ROWS and len(columns) == 1 and "axis" not in options) or any(not isinstance(v, (int, float)) for v in options.values()):
        return None
    blocks = [_matrix(c) for c in columns]
    if any(m is None or m.shape != blocks[0].shape for m in blocks):
        return None
    out = np.asarray(f(*blocks, **options) if name in BY_ELEMENT else f(*blocks, axis=-1, **options))
    if kind in ("vector", "wholes"):
        offsets = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(out).ravel().astype(float if kind == "vector" else np.int64)))
    return pa.array(out.astype({"scalar": float, "whole": np.int64, "truth": bool}[kind]))


def _by_cell(kind: str, f: Callable, columns: tuple, options: dict, once: bool = True) -> pa.Array:
    """A call a row of cells, or a row that differs."""
    blocks = [batches.flat(c) for c in columns] if once else [None]
    found = None if any(b is None for b in blocks) else batches.distinct(blocks)
    if found is not None:
        columns = tuple(c.take(pa.array(found[0])) for c in columns)
    rows = zip(*(m if (m := _matrix(c)) is not None else map(_in, c.to_pylist()) for c in columns))
    out = pa.array([None if any(x is None for x in r) else _out(kind, f(*r, **options)) for r in rows], KINDS[kind][1])
    return out if found is None else out.take(pa.array(found[1]))


def apply(name: str, *cells: Column, **options) -> Column:
    """The named function of the cells, with constant options passed to the kernel. Cells of one width go as blocks
    where the kernel can; else it is called once for equal cells of a batch."""
    kind, own = CATALOGUE[name]
    own = own if name in _OWN else None  # built-in kernels are looked up where they run

    @F.arrow_udf(KINDS[kind][0])
    def kernel(*columns: pa.Array) -> pa.Array:
        from gridlark.functions import cells as here

        f = own or here.CATALOGUE[name][1]
        with np.errstate(all="ignore"):
            if own is None and (block := here._as_block(name, kind, f, columns, options)) is not None:
                return block
            return here._by_cell(kind, f, columns, options, own is None)

    return kernel(*cells)


def supported() -> list[str]:
    return sorted(CATALOGUE)
