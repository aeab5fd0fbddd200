"""Interpolants and splines over points that fit a task, as numpy objects; `column` evaluates any of them on a Column.

Points must rise where a piecewise interpolant is asked for. NaN in gives NaN out."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def column(interpolant: Callable[[np.ndarray], np.ndarray], x: Column) -> Column:
    """The interpolant of a Column, in Arrow batches; null for null."""

    @F.arrow_udf("double")
    def kernel(a: pa.Array) -> pa.Array:
        return pa.array(np.asarray(interpolant(a.cast(pa.float64()).to_numpy(zero_copy_only=False)), float), mask=a.is_null().to_numpy(zero_copy_only=False))

    return kernel(x.cast("double"))


class PPoly:
    """Piecewise polynomials: c[i, k] is the coefficient of (x - breaks[k])**(degree - i). The end pieces go on outside."""

    def __init__(self, c, breaks):
        self.c, self.x = np.asarray(c, float), np.asarray(breaks, float)
        if (np.diff(self.x) <= 0).any():
            raise ValueError("breaks must rise")

    def __call__(self, at, nu: int = 0) -> np.ndarray:
        at = np.asarray(at, float)
        p = self
        for _ in range(nu):
            p = p.derivative()
        k = np.clip(np.searchsorted(p.x, at, "right") - 1, 0, len(p.x) - 2)
        t, out = at - p.x[k], np.zeros_like(at)
        for row in p.c:
            out = out * t + row[k]
        return out

    def derivative(self) -> PPoly:
        n = len(self.c) - 1
        return PPoly(self.c[:-1] * np.arange(n, 0, -1)[:, None] if n else 0 * self.c, self.x)

    def antiderivative(self) -> PPoly:
        """Zero at the first break, and continuous."""
        n = len(self.c)
        c = np.vstack([self.c / np.arange(n, 0, -1)[:, None], np.zeros((1, self.c.shape[1]))])
        h, total = np.diff(self.x), 0.0
        for k in range(c.shape[1]):
            c[-1, k] = total
            total = np.polyval(c[:, k], h[k])
        return PPoly(c, self.x)

    def integrate(self, a: float, b: float) -> float:
        f = self.antiderivative()
        return float(f(b) - f(a))

    def roots(self) -> np.ndarray:
        """Real roots within the breaks."""
        out = []
        for k, h in enumerate(np.diff(self.x)):
            r = np.roots(np.trim_zeros(self.c[:, k], "f"))
            r = r[np.abs(r.imag) < 1e-9].real
            out += (self.x[k] + r[(r >= -1e-12) & (r < h + (1e-12 if k == len(self.x) - 2 else -1e-12))]).tolist()
        return np.unique(np.round(out, 12))


def hermite_pieces(x, y, d) -> PPoly:
    """Cubics through values y with slopes d."""
    x, y, d = (np.asarray(v, float) for v in (x, y, d))
    h = np.diff(x)
    s = np.diff(y) / h
    return PPoly(np.stack([(d[:-1] + d[1:] - 2 * s) / h**2, (3 * s - 2 * d[:-1] - d[1:]) / h, d[:-1], y[:-1]]), x)


CubicHermiteSpline = hermite_pieces


def _by_kind(x, y, kind: str) -> PPoly:
    from gridlark.operators.solve import Cubic

    return hermite_pieces(x, y, Cubic(x, y, kind).d)


def PchipInterpolator(x, y) -> PPoly:
    """Keeps the data's rises and falls."""
    return _by_kind(x, y, "pchip")


def Akima1DInterpolator(x, y) -> PPoly:
    return _by_kind(x, y, "akima")


def CubicSpline(x, y, bc_type: str = "not-a-knot") -> PPoly:
    return _by_kind(x, y, bc_type)


def pchip_interpolate(x, y, at) -> np.ndarray:
    return PchipInterpolator(x, y)(at)


def BPoly(c, breaks) -> PPoly:
    """Piecewise polynomials by their Bernstein coefficients."""
    c, x = np.asarray(c, float), np.asarray(breaks, float)
    n, h = len(c) - 1, np.diff(x)
    power = np.zeros_like(c)  # of t = (x - break) / h, the lowest power first
    for j in range(n + 1):
        for i in range(j, n + 1):
            power[i] += c[j] * math.comb(n, i) * math.comb(i, j) * (-1) ** (i - j)
    return PPoly((power / h ** np.arange(n + 1)[:, None])[::-1], x)


class KroghInterpolator:
    """The polynomial through points; a point that comes again gives its next derivative."""

    def __init__(self, x, y):
        self.x = np.asarray(x, float)
        n = len(self.x)
        table = [np.asarray(y, float).copy()]
        first = [int(np.flatnonzero(self.x == v)[0]) for v in self.x]
        f = table[0][first]
        self.c = [f[0]]
        for k in range(1, n):
            new = np.empty(n - k)
            for i in range(n - k):
                if self.x[i] == self.x[i + k]:
                    new[i] = table[0][first[i] + k] / math.factorial(k)
                else:
                    new[i] = (f[i + 1] - f[i]) / (self.x[i + k] - self.x[i])
            f = new
            self.c.append(f[0])

    def __call__(self, at) -> np.ndarray:
        at = np.asarray(at, float)
        out = np.zeros_like(at)
        for k in range(len(self.c) - 1, -1, -1):
            out = out * (at - self.x[k]) + self.c[k]
        return out


def krogh_interpolate(x, y, at) -> np.ndarray:
    return KroghInterpolator(x, y)(at)


class FloaterHormannInterpolator:
    """Barycentric rational interpolation without real poles, blending polynomials of degree d."""

    def __init__(self, x, y, d: int = 3):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        n = len(self.x) - 1
        self.w = np.zeros(n + 1)
        for k in range(n + 1):
            for i in range(max(0, k - d), min(k, n - d) + 1):
                near = [j for j in range(i, i + d + 1) if j != k]
                self.w[k] += (-1) ** i / np.prod(self.x[k] - self.x[near])

    def __call__(self, at) -> np.ndarray:
        at = np.asarray(at, float)
        off = at[..., None] - self.x
        hit = off == 0
        q = self.w / np.where(hit, 1, off)
        return np.where(hit.any(-1), self.y[hit.argmax(-1)], (q * self.y).sum(-1) / q.sum(-1))


#: Radial functions by name; of the distance times epsilon where that counts.
KERNELS = {
    "linear": lambda r: -r, "thin_plate_spline": lambda r: np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1)), 0.0), "cubic": lambda r: r**3, "quintic": lambda r: -(r**5),
    "multiquadric": lambda r: -np.sqrt(r * r + 1), "inverse_multiquadric": lambda r: 1 / np.sqrt(r * r + 1), "inverse_quadratic": lambda r: 1 / (r * r + 1), "gaussian": lambda r: np.exp(-r * r),
}
_DEGREE = {"multiquadric": 0, "linear": 0, "thin_plate_spline": 1, "cubic": 1, "quintic": 2}


class RBFInterpolator:
    """Radial functions at the points plus a polynomial of low degree, by one dense system."""

    def __init__(self, points, values, kernel: str = "thin_plate_spline", epsilon: float = 1.0, smoothing: float = 0.0, degree: int | None = None):
        self.p, v = np.atleast_2d(np.asarray(points, float)), np.asarray(values, float)
        self.f, self.eps = KERNELS[kernel], epsilon
        self.degree = _DEGREE.get(kernel, -1) if degree is None else degree
        a, q = self.f(self._far(self.p)), self._powers(self.p)
        n, m = len(self.p), q.shape[1]
        big = np.zeros((n + m, n + m))
        big[:n, :n], big[:n, n:], big[n:, :n] = a + smoothing * np.eye(n), q, q.T
        self.c = np.linalg.solve(big, np.concatenate([v, np.zeros(m)]))

    def _far(self, at) -> np.ndarray:
        return np.sqrt(((at[:, None] - self.p[None]) ** 2).sum(-1)) * self.eps

    def _powers(self, at) -> np.ndarray:
        from itertools import combinations_with_replacement as ways

        cols = [np.prod(at[:, list(w)], axis=1) if w else np.ones(len(at)) for d in range(self.degree + 1) for w in ways(range(at.shape[1]), d)]
        return np.stack(cols, 1) if cols else np.zeros((len(at), 0))

    def __call__(self, at) -> np.ndarray:
        at = np.atleast_2d(np.asarray(at, float))
        return self.f(self._far(at)) @ self.c[: len(self.p)] + self._powers(at) @ self.c[len(self.p) :]


# B-splines: (knots, coefficients, degree)


def design_matrix(at, t, k: int) -> np.ndarray:
    """Values of each basis spline at each place, by the recurrence over degrees; the end intervals go on outside."""
    at, t = np.atleast_1d(np.asarray(at, float)), np.asarray(t, float)
    n = len(t) - k - 1
    place = np.clip(np.searchsorted(t, at, "right") - 1, k, n - 1)
    b = np.zeros((len(at), len(t) - 1))
    b[np.arange(len(at)), place] = 1
    for d in range(1, k + 1):
        new = np.zeros((len(at), len(t) - 1 - d))
        for i in range(len(t) - 1 - d):
            if t[i + d] > t[i]:
                new[:, i] += (at - t[i]) / (t[i + d] - t[i]) * b[:, i]
            if t[i + d + 1] > t[i + 1]:
                new[:, i] += (t[i + d + 1] - at) / (t[i + d + 1] - t[i + 1]) * b[:, i + 1]
        b = new
    return b


def make_interp_spline(x, y, k: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """Through all points; knots at the points but for those next to the ends (odd k), or between them (even k)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if k == 1:
        t = np.concatenate([[x[0]], x, [x[-1]]])
    else:
        inner = x[(k + 1) // 2 : -(k + 1) // 2] if k % 2 else ((x[1:] + x[:-1]) / 2)[k // 2 : -(k // 2)]
        t = np.concatenate([np.full(k + 1, x[0]), inner, np.full(k + 1, x[-1])])
    return t, np.linalg.solve(design_matrix(x, t, k), y), k


splrep = make_interp_spline


def make_lsq_spline(x, y, t, k: int = 3, w=None) -> tuple[np.ndarray, np.ndarray, int]:
    """Least squares on given knots."""
    w = np.ones(len(x)) if w is None else np.asarray(w, float)
    return np.asarray(t, float), np.linalg.lstsq(design_matrix(x, t, k) * w[:, None], np.asarray(y, float) * w, rcond=None)[0], k


def splev(at, tck, der: int = 0) -> np.ndarray:
    for _ in range(der):
        tck = splder(tck)
    t, c, k = tck
    return design_matrix(at, t, k) @ c


def splder(tck, n: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    for _ in range(n):
        t, c, k = tck
        gap = t[k + 1 : len(c) + k] - t[1 : len(c)]
        tck = t[1:-1], k * np.diff(c) / np.where(gap == 0, 1, gap), k - 1
    return tck


def splantider(tck, n: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    for _ in range(n):
        t, c, k = tck
        gap = t[k + 1 : len(c) + k + 1] - t[: len(c)]
        tck = np.concatenate([t[:1], t, t[-1:]]), np.concatenate([[0.0], np.cumsum(c * gap / (k + 1))]), k + 1
    return tck


def splint(a: float, b: float, tck) -> float:
    f = splantider(tck)
    return float(splev(b, f)[0] - splev(a, f)[0])


def sproot(tck) -> np.ndarray:
    """Real roots, by the pieces as polynomials."""
    return to_pieces(tck).roots()


def to_pieces(tck) -> PPoly:
    t, c, k = tck
    breaks = np.unique(t[k : len(c) + 1])
    rows = [splev(breaks[:-1], splder(tck, n) if n else tck) / math.factorial(n) for n in range(k + 1)]
    return PPoly(np.array(rows[::-1]), breaks)


# Polynomials


def lagrange(x, y) -> np.ndarray:
    """Coefficients, the highest power first."""
    x, out = np.asarray(x, float), np.zeros(len(x))
    for k, v in enumerate(np.asarray(y, float)):
        others = np.delete(x, k)
        out += v * np.poly(others) / np.prod(x[k] - others)
    return out


def pade(taylor: Sequence[float], m: int, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator (of degree m), the highest power first, of the fraction with these first Taylor terms."""
    c = np.asarray(taylor, float)
    n = len(c) - 1 - m if n is None else n
    at = lambda i: c[i] if 0 <= i < len(c) else 0.0
    a = np.array([[at(n + i - j) for j in range(1, m + 1)] for i in range(1, m + 1)])
    q = np.concatenate([[1.0], np.linalg.solve(a, -np.array([at(n + i) for i in range(1, m + 1)]))]) if m else np.ones(1)
    p = np.array([sum(q[j] * at(i - j) for j in range(min(i, m) + 1)) for i in range(n + 1)])
    return p[::-1], q[::-1]
