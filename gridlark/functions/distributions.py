"""Probability distributions: frozen objects with pdf or pmf, cdf, sf, ppf, moments and random variates, over arrays; and
`column` to evaluate any of them on a Column in Arrow batches.

Continuous families give a standard cdf (and, where it is closed, its inverse); location and scale are common to all.
What a family doesn't state in closed form comes from it: pdf by its formula, ppf by bisection of the cdf."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions import special as S


@dataclass
class Family:
    pdf: Callable
    cdf: Callable
    support: Callable = lambda *p: (-math.inf, math.inf)
    ppf: Callable | None = None
    discrete: bool = False


_half = lambda *p: (0.0, math.inf)
_unit = lambda *p: (0.0, 1.0)
_wide = lambda *p: (-math.inf, math.inf)
_phi = lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi)

def _argus(c):
    return S.ndtr(c) - _phi(c) * c - 0.5


def _gamma_pdf(a, x):
    return np.exp((a - 1) * np.log(np.maximum(x, 1e-300)) - x - S.gammaln(a))


def _tukey(x, k):
    """The cdf: where the closed quantile function gives x, by halving."""
    low, high = np.zeros(np.shape(x)), np.ones(np.shape(x))
    for _ in range(70):
        p = (low + high) / 2
        under = ((p**k - (1 - p) ** k) / k if k else np.log(p / (1 - p))) < x
        low, high = np.where(under, p, low), np.where(under, high, p)
    return (low + high) / 2


_ORDERS = np.arange(1, 81)
_orders = lambda x: np.sin(np.asarray(x)[..., None] * _ORDERS) / _ORDERS


@functools.lru_cache(maxsize=64)
def S_ratio(k: float) -> np.ndarray:
    """I_j(k) / I_0(k) for the first orders j."""
    return np.array([float(S.ive(int(j), np.float64(k))) for j in _ORDERS]) / float(S.ive(0, np.float64(k)))


def _poisson_mix(f: Callable, mean: float, terms: int = 200) -> np.ndarray:
    """Sum over j of the chance of j by a Poisson law times f(j)."""
    j = np.arange(max(0, int(mean) - terms), int(mean) + terms)
    return (np.exp(j * math.log(mean) - mean - S.gammaln(j + 1)) * f(j)).sum(-1) if mean else f(np.zeros(1))[..., 0]


def _by_quadrature(name: str, x, *shape) -> np.ndarray:
    """A cdf from its density, over the line folded to an interval."""
    t, w = S.gauss(120)
    u = (t + 1) / 2  # of (-inf, x]: y = x - u / (1 - u)
    y = np.asarray(x, float)[..., None] - u / (1 - u)
    return (CONTINUOUS[name].pdf(y, *shape) * (w / 2 / (1 - u) ** 2)).sum(-1)


CONTINUOUS: dict[str, Family] = {
    "norm": Family(lambda x: _phi(x), S.ndtr, _wide, S.ndtri),
    "uniform": Family(lambda x: np.ones_like(x), lambda x: x, _unit, lambda p: p),
    "expon": Family(lambda x: np.exp(-x), lambda x: -np.expm1(-x), _half, lambda p: -np.log1p(-p)),
    "gamma": Family(lambda x, a: np.exp((a - 1) * np.log(x) - x - S.gammaln(a)), lambda x, a: S.gammainc(a, x), _half, lambda p, a: S.gammaincinv(a, p)),
    "erlang": Family(lambda x, a: np.exp((a - 1) * np.log(x) - x - S.gammaln(a)), lambda x, a: S.gammainc(a, x), _half, lambda p, a: S.gammaincinv(a, p)),
    "chi2": Family(lambda x, k: np.exp((k / 2 - 1) * np.log(x) - x / 2 - k / 2 * math.log(2) - S.gammaln(k / 2)), lambda x, k: S.chdtr(k, x), _half, lambda p, k: 2 * S.gammaincinv(k / 2, p)),
    "chi": Family(lambda x, k: np.exp((k - 1) * np.log(x) - x * x / 2 - (k / 2 - 1) * math.log(2) - S.gammaln(k / 2)), lambda x, k: S.gammainc(k / 2, x * x / 2), _half),
    "beta": Family(lambda x, a, b: np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - S.betaln(a, b)), lambda x, a, b: S.betainc(a, b, x), _unit, lambda p, a, b: S.betaincinv(a, b, p)),
    "betaprime": Family(lambda x, a, b: np.exp((a - 1) * np.log(x) - (a + b) * np.log1p(x) - S.betaln(a, b)), lambda x, a, b: S.betainc(a, b, x / (1 + x)), _half),
    "t": Family(lambda x, v: np.exp(S.gammaln((v + 1) / 2) - S.gammaln(v / 2) - 0.5 * np.log(v * np.pi) - (v + 1) / 2 * np.log1p(x * x / v)), lambda x, v: S.stdtr(v, x), _wide, lambda p, v: S.stdtrit(v, p)),
    "f": Family(lambda x, a, b: np.exp(a / 2 * np.log(a * x) + b / 2 * np.log(b) - (a + b) / 2 * np.log(a * x + b) - np.log(x) - S.betaln(a / 2, b / 2)), lambda x, a, b: S.fdtr(a, b, x), _half),
    "cauchy": Family(lambda x: 1 / np.pi / (1 + x * x), lambda x: 0.5 + np.arctan(x) / np.pi, _wide, lambda p: np.tan(np.pi * (p - 0.5))),
    "halfcauchy": Family(lambda x: 2 / np.pi / (1 + x * x), lambda x: 2 / np.pi * np.arctan(x), _half, lambda p: np.tan(np.pi * p / 2)),
    "halfnorm": Family(lambda x: 2 * _phi(x), lambda x: S.erf(x / math.sqrt(2)), _half, lambda p: S.ndtri((1 + p) / 2)),
    "laplace": Family(lambda x: np.exp(-np.abs(x)) / 2, lambda x: np.where(x < 0, np.exp(np.minimum(x, 0)) / 2, 1 - np.exp(-np.maximum(x, 0)) / 2), _wide, lambda p: np.where(p < 0.5, np.log(2 * p), -np.log(2 * (1 - p)))),
    "logistic": Family(lambda x: np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))) ** 2, lambda x: 1 / (1 + np.exp(-x)), _wide, lambda p: np.log(p / (1 - p))),
    "halflogistic": Family(lambda x: 0.5 / np.cosh(x / 2) ** 2, lambda x: np.tanh(x / 2), _half, lambda p: 2 * np.arctanh(p)),
    "lognorm": Family(lambda x, s: _phi(np.log(x) / s) / (s * x), lambda x, s: S.ndtr(np.log(x) / s), _half, lambda p, s: np.exp(s * S.ndtri(p))),
    "gibrat": Family(lambda x: _phi(np.log(x)) / x, lambda x: S.ndtr(np.log(x)), _half, lambda p: np.exp(S.ndtri(p))),
    "weibull_min": Family(lambda x, c: c * x ** (c - 1) * np.exp(-(x**c)), lambda x, c: -np.expm1(-(x**c)), _half, lambda p, c: (-np.log1p(-p)) ** (1 / c)),
    "weibull_max": Family(lambda x, c: c * (-x) ** (c - 1) * np.exp(-((-x) ** c)), lambda x, c: np.exp(-((-x) ** c)), lambda *p: (-math.inf, 0.0), lambda p, c: -((-np.log(p)) ** (1 / c))),
    "exponweib": Family(lambda x, a, c: a * c * (-np.expm1(-(x**c))) ** (a - 1) * np.exp(-(x**c)) * x ** (c - 1), lambda x, a, c: (-np.expm1(-(x**c))) ** a, _half),
    "invweibull": Family(lambda x, c: c * x ** (-c - 1) * np.exp(-(x**-c)), lambda x, c: np.exp(-(x**-c)), _half, lambda p, c: (-np.log(p)) ** (-1 / c)),
    "rayleigh": Family(lambda x: x * np.exp(-x * x / 2), lambda x: -np.expm1(-x * x / 2), _half, lambda p: np.sqrt(-2 * np.log1p(-p))),
    "maxwell": Family(lambda x: math.sqrt(2 / math.pi) * x * x * np.exp(-x * x / 2), lambda x: S.gammainc(1.5, x * x / 2), _half),
    "gumbel_r": Family(lambda x: np.exp(-x - np.exp(-x)), lambda x: np.exp(-np.exp(-x)), _wide, lambda p: -np.log(-np.log(p))),
    "gumbel_l": Family(lambda x: np.exp(x - np.exp(x)), lambda x: -np.expm1(-np.exp(x)), _wide, lambda p: np.log(-np.log1p(-p))),
    "genextreme": Family(lambda x, c: np.exp(-((1 - c * x) ** (1 / c))) * (1 - c * x) ** (1 / c - 1), lambda x, c: np.exp(-((1 - c * x) ** (1 / c))), lambda c: (-math.inf, 1 / c) if c > 0 else (1 / c, math.inf), lambda p, c: (1 - (-np.log(p)) ** c) / c),
    "genpareto": Family(lambda x, c: (1 + c * x) ** (-1 / c - 1), lambda x, c: 1 - (1 + c * x) ** (-1 / c), lambda c: (0.0, math.inf if c > 0 else -1 / c), lambda p, c: ((1 - p) ** -c - 1) / c),
    "pareto": Family(lambda x, b: b * x ** (-b - 1), lambda x, b: 1 - x**-b, lambda *p: (1.0, math.inf), lambda p, b: (1 - p) ** (-1 / b)),
    "lomax": Family(lambda x, c: c * (1 + x) ** (-c - 1), lambda x, c: 1 - (1 + x) ** -c, _half, lambda p, c: (1 - p) ** (-1 / c) - 1),
    "powerlaw": Family(lambda x, a: a * x ** (a - 1), lambda x, a: x**a, _unit, lambda p, a: p ** (1 / a)),
    "arcsine": Family(lambda x: 1 / (np.pi * np.sqrt(x * (1 - x))), lambda x: 2 / np.pi * np.arcsin(np.sqrt(x)), _unit, lambda p: np.sin(np.pi * p / 2) ** 2),
    "triang": Family(lambda x, c: np.where(x < c, 2 * x / c if c else 0, 2 * (1 - x) / (1 - c) if c < 1 else 0), lambda x, c: np.where(x < c, x * x / c if c else 0, 1 - (1 - x) ** 2 / (1 - c) if c < 1 else 1), _unit),
    "loguniform": Family(lambda x, a, b: 1 / (x * np.log(b / a)), lambda x, a, b: np.log(x / a) / np.log(b / a), lambda a, b: (a, b), lambda p, a, b: a * (b / a) ** p),
    "invgamma": Family(lambda x, a: np.exp(-(a + 1) * np.log(x) - 1 / x - S.gammaln(a)), lambda x, a: S.gammaincc(a, 1 / x), _half, lambda p, a: 1 / S.gammainccinv(a, p)),
    "invgauss": Family(lambda x, m: np.exp(-((x - m) ** 2) / (2 * x * m * m)) / np.sqrt(2 * np.pi * x**3), lambda x, m: S.ndtr((x / m - 1) / np.sqrt(x)) + np.exp(2 / m) * S.ndtr(-(x / m + 1) / np.sqrt(x)), _half),
    "gompertz": Family(lambda x, c: c * np.exp(x - c * np.expm1(x)), lambda x, c: -np.expm1(-c * np.expm1(x)), _half, lambda p, c: np.log1p(-np.log1p(-p) / c)),
    "burr": Family(lambda x, c, d: c * d * x ** (-c - 1) * (1 + x**-c) ** (-d - 1), lambda x, c, d: (1 + x**-c) ** -d, _half, lambda p, c, d: (p ** (-1 / d) - 1) ** (-1 / c)),
    "burr12": Family(lambda x, c, d: c * d * x ** (c - 1) * (1 + x**c) ** (-d - 1), lambda x, c, d: 1 - (1 + x**c) ** -d, _half, lambda p, c, d: ((1 - p) ** (-1 / d) - 1) ** (1 / c)),
    "fisk": Family(lambda x, c: c * x ** (c - 1) / (1 + x**c) ** 2, lambda x, c: 1 / (1 + x**-c), _half, lambda p, c: (p / (1 - p)) ** (1 / c)),
    "levy": Family(lambda x: np.exp(-1 / (2 * x)) / np.sqrt(2 * np.pi * x**3), lambda x: S.erfc(np.sqrt(0.5 / x)), _half, lambda p: 0.5 / S.erfcinv(p) ** 2),
    "moyal": Family(lambda x: np.exp(-(x + np.exp(-x)) / 2) / math.sqrt(2 * math.pi), lambda x: S.erfc(np.exp(-x / 2) / math.sqrt(2)), _wide),
    "hypsecant": Family(lambda x: 1 / (np.pi * np.cosh(x)), lambda x: 2 / np.pi * np.arctan(np.exp(x)), _wide, lambda p: np.log(np.tan(np.pi * p / 2))),
    "semicircular": Family(lambda x: 2 / np.pi * np.sqrt(1 - x * x), lambda x: 0.5 + (x * np.sqrt(1 - x * x) + np.arcsin(x)) / np.pi, lambda: (-1.0, 1.0)),
    "cosine": Family(lambda x: (1 + np.cos(x)) / (2 * np.pi), lambda x: (np.pi + x + np.sin(x)) / (2 * np.pi), lambda: (-math.pi, math.pi)),
    "anglit": Family(lambda x: np.cos(2 * x), lambda x: np.sin(x + np.pi / 4) ** 2, lambda: (-math.pi / 4, math.pi / 4), lambda p: np.arcsin(np.sqrt(p)) - np.pi / 4),
    "bradford": Family(lambda x, c: c / (np.log1p(c) * (1 + c * x)), lambda x, c: np.log1p(c * x) / np.log1p(c), _unit, lambda p, c: np.expm1(p * np.log1p(c)) / c),
    "truncexpon": Family(lambda x, b: np.exp(-x) / -np.expm1(-b), lambda x, b: np.expm1(-x) / np.expm1(-b), lambda b: (0.0, b), lambda p, b: -np.log1p(p * np.expm1(-b))),
    "truncnorm": Family(lambda x, a, b: _phi(x) / (S.ndtr(b) - S.ndtr(a)), lambda x, a, b: (S.ndtr(x) - S.ndtr(a)) / (S.ndtr(b) - S.ndtr(a)), lambda a, b: (a, b), lambda p, a, b: S.ndtri(S.ndtr(a) + p * (S.ndtr(b) - S.ndtr(a)))),
    "skewnorm": Family(lambda x, a: 2 * _phi(x) * S.ndtr(a * x), lambda x, a: S.ndtr(x) - 2 * S.owens_t(x, a), _wide),
    "exponnorm": Family(lambda x, k: np.exp(np.minimum(0.5 / (k * k) - x / k, 700)) * S.ndtr(x - 1 / k) / k, lambda x, k: S.ndtr(x) - np.exp(np.minimum(0.5 / (k * k) - x / k, 700)) * S.ndtr(x - 1 / k), _wide),
    "gennorm": Family(lambda x, b: b / (2 * S.gamma(1 / b)) * np.exp(-(np.abs(x) ** b)), lambda x, b: 0.5 + np.sign(x) * S.gammainc(1 / b, np.abs(x) ** b) / 2, _wide),
    "gengamma": Family(lambda x, a, c: np.abs(c) * np.exp((c * a - 1) * np.log(x) - x**c - S.gammaln(a)), lambda x, a, c: np.where(c > 0, S.gammainc(a, x**c), S.gammaincc(a, x**c)), _half),
    "loggamma": Family(lambda x, c: np.exp(c * x - np.exp(x) - S.gammaln(c)), lambda x, c: S.gammainc(c, np.exp(x)), _wide),
    "genlogistic": Family(lambda x, c: c * np.exp(-x) * (1 + np.exp(-x)) ** (-c - 1), lambda x, c: (1 + np.exp(-x)) ** -c, _wide, lambda p, c: -np.log(p ** (-1 / c) - 1)),
    "johnsonsu": Family(lambda x, a, b: b / np.sqrt(x * x + 1) * _phi(a + b * np.arcsinh(x)), lambda x, a, b: S.ndtr(a + b * np.arcsinh(x)), _wide, lambda p, a, b: np.sinh((S.ndtri(p) - a) / b)),
    "johnsonsb": Family(lambda x, a, b: b / (x * (1 - x)) * _phi(a + b * np.log(x / (1 - x))), lambda x, a, b: S.ndtr(a + b * np.log(x / (1 - x))), _unit, lambda p, a, b: 1 / (1 + np.exp(-(S.ndtri(p) - a) / b))),
    "nakagami": Family(lambda x, v: 2 * v**v / S.gamma(v) * x ** (2 * v - 1) * np.exp(-v * x * x), lambda x, v: S.gammainc(v, v * x * x), _half, lambda p, v: np.sqrt(S.gammaincinv(v, p) / v)),
    "fatiguelife": Family(lambda x, c: (x + 1) / (2 * c * np.sqrt(2 * np.pi * x**3)) * np.exp(-((x - 1) ** 2) / (2 * x * c * c)), lambda x, c: S.ndtr((np.sqrt(x) - 1 / np.sqrt(x)) / c), _half),
    "foldnorm": Family(lambda x, c: _phi(x - c) + _phi(x + c), lambda x, c: S.ndtr(x - c) - S.ndtr(-x - c), _half),
    "foldcauchy": Family(lambda x, c: (1 / (1 + (x - c) ** 2) + 1 / (1 + (x + c) ** 2)) / np.pi, lambda x, c: (np.arctan(x - c) + np.arctan(x + c)) / np.pi, _half),
    "mielke": Family(lambda x, k, s: k * x ** (k - 1) / (1 + x**s) ** (1 + k / s), lambda x, k, s: x**k / (1 + x**s) ** (k / s), _half),
    "dweibull": Family(lambda x, c: c / 2 * np.abs(x) ** (c - 1) * np.exp(-(np.abs(x) ** c)), lambda x, c: np.where(x > 0, 1 - np.exp(-(np.abs(x) ** c)) / 2, np.exp(-(np.abs(x) ** c)) / 2), _wide),
    "dgamma": Family(lambda x, a: np.abs(x) ** (a - 1) * np.exp(-np.abs(x)) / (2 * S.gamma(a)), lambda x, a: 0.5 + np.sign(x) * S.gammainc(a, np.abs(x)) / 2, _wide),
    "loglaplace": Family(lambda x, c: c / 2 * np.where(x < 1, x ** (c - 1), x ** (-c - 1)), lambda x, c: np.where(x < 1, x**c / 2, 1 - x**-c / 2), _half),
    "rdist": Family(lambda x, c: (1 - x * x) ** (c / 2 - 1) / S.beta(0.5, c / 2), lambda x, c: S.betainc(c / 2, c / 2, (x + 1) / 2), lambda c: (-1.0, 1.0)),
    "kstwobign": Family(lambda x: 8 * x * sum((-1) ** (k - 1) * k * k * np.exp(-2 * k * k * x * x) for k in range(1, 60)), lambda x: 1 - S.kolmogorov(x), _half),
    "wald": Family(lambda x: np.exp(-((x - 1) ** 2) / (2 * x)) / np.sqrt(2 * np.pi * x**3), lambda x: S.ndtr((x - 1) / np.sqrt(x)) + math.e**2 * S.ndtr(-(x + 1) / np.sqrt(x)), _half),
    "skewcauchy": Family(lambda x, a: 1 / (np.pi * (1 + x * x / (1 + a * np.sign(x)) ** 2)), lambda x, a: np.where(x <= 0, (1 - a) / 2 + (1 - a) / np.pi * np.arctan(x / (1 - a)), (1 - a) / 2 + (1 + a) / np.pi * np.arctan(x / (1 + a))), _wide),
    "kappa3": Family(lambda x, a: a * (a + x**a) ** (-(a + 1) / a), lambda x, a: x * (a + x**a) ** (-1 / a), _half, lambda p, a: (a / (p**-a - 1)) ** (1 / a)),
    "halfgennorm": Family(lambda x, b: b / S.gamma(1 / b) * np.exp(-(x**b)), lambda x, b: S.gammainc(1 / b, x**b), _half),
    "genhalflogistic": Family(lambda x, c: 2 * (1 - c * x) ** (1 / c - 1) / (1 + (1 - c * x) ** (1 / c)) ** 2, lambda x, c: (1 - (1 - c * x) ** (1 / c)) / (1 + (1 - c * x) ** (1 / c)), lambda c: (0.0, 1 / c), lambda p, c: (1 - ((1 - p) / (1 + p)) ** c) / c),
    "exponpow": Family(lambda x, b: b * x ** (b - 1) * np.exp(1 + x**b - np.exp(x**b)), lambda x, b: -np.expm1(-np.expm1(x**b)), _half, lambda p, b: np.log1p(-np.log1p(-p)) ** (1 / b)),
    "truncweibull_min": Family(lambda x, c, a, b: c * x ** (c - 1) * np.exp(-(x**c)) / (np.exp(-(a**c)) - np.exp(-(b**c))), lambda x, c, a, b: (np.exp(-(a**c)) - np.exp(-(x**c))) / (np.exp(-(a**c)) - np.exp(-(b**c))), lambda c, a, b: (a, b), lambda p, c, a, b: (-np.log(np.exp(-(a**c)) - p * (np.exp(-(a**c)) - np.exp(-(b**c))))) ** (1 / c)),
    "truncpareto": Family(lambda x, b, c: b * x ** (-b - 1) / (1 - c**-b), lambda x, b, c: (1 - x**-b) / (1 - c**-b), lambda b, c: (1.0, c), lambda p, b, c: (1 - p * (1 - c**-b)) ** (-1 / b)),
    "laplace_asymmetric": Family(lambda x, k: np.where(x >= 0, np.exp(-x * k), np.exp(x / k)) / (k + 1 / k), lambda x, k: np.where(x >= 0, 1 - np.exp(-x * k) / (k * (k + 1 / k)), k * np.exp(x / k) / (k + 1 / k)), _wide, lambda p, k: np.where(p >= k / (k + 1 / k), -np.log((1 - p) * k * (k + 1 / k)) / k, np.log(p * (k + 1 / k) / k) * k)),
    "genexpon": Family(lambda x, a, b, c: (a - b * np.expm1(-c * x)) * np.exp((-a - b) * x - b * np.expm1(-c * x) / c), lambda x, a, b, c: -np.expm1((-a - b) * x - b * np.expm1(-c * x) / c), _half),
    "wrapcauchy": Family(lambda x, c: (1 - c * c) / (2 * np.pi * (1 + c * c - 2 * c * np.cos(x))), lambda x, c: np.where(x < np.pi, np.arctan((1 + c) / (1 - c) * np.tan(x / 2)) / np.pi, 1 - np.arctan((1 + c) / (1 - c) * np.tan(np.pi - x / 2)) / np.pi), lambda c: (0.0, 2 * math.pi)),
    "levy_l": Family(lambda x: np.exp(1 / (2 * x)) / np.sqrt(2 * np.pi * np.abs(x) ** 3), lambda x: 1 - S.erfc(np.sqrt(0.5 / np.abs(x))), lambda: (-math.inf, 0.0)),
    "powerlognorm": Family(lambda x, c, s: c / (x * s) * _phi(np.log(x) / s) * S.ndtr(-np.log(x) / s) ** (c - 1), lambda x, c, s: 1 - S.ndtr(-np.log(x) / s) ** c, _half, lambda p, c, s: np.exp(-s * S.ndtri((1 - p) ** (1 / c)))),
    "recipinvgauss": Family(lambda x, m: np.exp(-((1 - m * x) ** 2) / (2 * x * m * m)) / np.sqrt(2 * np.pi * x), lambda x, m: S.ndtr(-(1 / m - x) / np.sqrt(x)) - np.exp(2 / m) * S.ndtr(-(1 / m + x) / np.sqrt(x)), _half),
    "argus": Family(lambda x, c: c**3 / (math.sqrt(2 * math.pi) * (S.ndtr(c) - _phi(np.float64(c)) * c - 0.5)) * x * np.sqrt(1 - x * x) * np.exp(-c * c * (1 - x * x) / 2), lambda x, c: 1 - _argus(c * np.sqrt(1 - x * x)) / _argus(np.float64(c)), _unit),
    "tukeylambda": Family(lambda x, k: 1 / ((_tukey(x, k) ** (k - 1) + (1 - _tukey(x, k)) ** (k - 1))), lambda x, k: _tukey(x, k), lambda k: (-1 / k, 1 / k) if k > 0 else (-math.inf, math.inf), lambda p, k: (p**k - (1 - p) ** k) / k if k else np.log(p / (1 - p))),
    "pearson3": Family(lambda x, k: _phi(x) if abs(k) < 1e-6 else 2 / abs(k) * _gamma_pdf(4 / (k * k), 4 / (k * k) + 2 * x / k), lambda x, k: S.ndtr(x) if abs(k) < 1e-6 else (S.gammainc if k > 0 else S.gammaincc)(4 / (k * k), np.maximum(4 / (k * k) + 2 * x / k, 0)), lambda k: (-math.inf, math.inf) if abs(k) < 1e-6 else (-2 / k, math.inf) if k > 0 else (-math.inf, -2 / k)),
    "vonmises": Family(lambda x, k: np.exp(k * (np.cos(x) - 1)) / (2 * np.pi * S.ive(0, np.float64(k))), lambda x, k: 0.5 + (x / 2 + (_orders(x) * S_ratio(k)).sum(-1)) / np.pi, lambda k: (-math.pi, math.pi)),
    "ncx2": Family(lambda x, d, n: _poisson_mix(lambda j: _gamma_pdf(d / 2 + j, x[..., None] / 2) / 2, n / 2), lambda x, d, n: _poisson_mix(lambda j: S.gammainc(d / 2 + j, x[..., None] / 2), n / 2), _half),
    "jf_skew_t": Family(lambda x, a, b: (1 + x / np.sqrt(a + b + x * x)) ** (a + 0.5) * (1 - x / np.sqrt(a + b + x * x)) ** (b + 0.5) / (2 ** (a + b - 1) * S.beta(a, b) * np.sqrt(a + b)), lambda x, a, b: S.betainc(a, b, (1 + x / np.sqrt(a + b + x * x)) / 2), _wide),
    "norminvgauss": Family(lambda x, a, b: a * S.kve(1, a * np.sqrt(1 + x * x)) / (np.pi * np.sqrt(1 + x * x)) * np.exp(np.sqrt(a * a - b * b) + b * x - a * np.sqrt(1 + x * x)), lambda x, a, b: np.where(x <= 0, _by_quadrature("norminvgauss", np.minimum(x, 0), a, b), 1 - _by_quadrature("norminvgauss", -np.maximum(x, 0), a, -b)), _wide),
    "crystalball": Family(lambda x, b, m: np.where(x > -b, np.exp(-x * x / 2), (m / b) ** m * np.exp(-b * b / 2) * np.maximum(m / b - b - x, 1e-300) ** -m) / (m / b / (m - 1) * np.exp(-b * b / 2) + math.sqrt(2 * math.pi) * S.ndtr(b)), lambda x, b, m: np.where(x > -b, m / b * np.exp(-b * b / 2) / (m - 1) + math.sqrt(2 * math.pi) * (S.ndtr(x) - S.ndtr(-b)), (m / b) ** m * np.exp(-b * b / 2) * np.maximum(m / b - b - x, 1e-300) ** (1 - m) / (m - 1)) / (m / b / (m - 1) * np.exp(-b * b / 2) + math.sqrt(2 * math.pi) * S.ndtr(b)), _wide),
    "powernorm": Family(lambda x, c: c * _phi(x) * S.ndtr(-x) ** (c - 1), lambda x, c: 1 - S.ndtr(-x) ** c, _wide, lambda p, c: -S.ndtri((1 - p) ** (1 / c))),
}


def _pmf(log: Callable) -> Callable:
    return lambda k, *p: np.exp(log(k, *p))


def _ncx2_cdf(x: float, d: np.ndarray, n: float) -> np.ndarray:
    j = np.arange(0, int(n / 2) + 200)
    return (np.exp(j * math.log(n / 2) - n / 2 - S.gammaln(j + 1)) * S.gammainc(np.asarray(d)[..., None] / 2 + j, x / 2)).sum(-1)


_lc = lambda n, k: S.gammaln(n + 1) - S.gammaln(k + 1) - S.gammaln(n - k + 1)
DISCRETE: dict[str, Family] = {
    "bernoulli": Family(lambda k, p: np.where(k == 1, p, 1 - p), lambda k, p: np.where(k < 1, 1 - p, 1.0), lambda p: (0, 1), discrete=True),
    "binom": Family(_pmf(lambda k, n, p: _lc(n, k) + k * np.log(p) + (n - k) * np.log1p(-p)), lambda k, n, p: S.bdtr(k, n, p), lambda n, p: (0, n), discrete=True),
    "poisson": Family(_pmf(lambda k, m: k * np.log(m) - m - S.gammaln(k + 1)), lambda k, m: S.pdtr(k, m), _half, discrete=True),
    "geom": Family(lambda k, p: p * (1 - p) ** (k - 1), lambda k, p: 1 - (1 - p) ** k, lambda p: (1, math.inf), discrete=True),
    "nbinom": Family(_pmf(lambda k, n, p: S.gammaln(k + n) - S.gammaln(n) - S.gammaln(k + 1) + n * np.log(p) + k * np.log1p(-p)), lambda k, n, p: S.nbdtr(k, n, p), _half, discrete=True),
    "hypergeom": Family(_pmf(lambda k, m, n, d: _lc(n, k) + _lc(m - n, d - k) - _lc(m, d)), None, lambda m, n, d: (max(0, d - m + n), min(n, d)), discrete=True),
    "randint": Family(lambda k, a, b: np.full(np.shape(k), 1 / (b - a)), lambda k, a, b: (k - a + 1) / (b - a), lambda a, b: (a, b - 1), discrete=True),
    "zipf": Family(lambda k, a: k ** (-float(a)) / S.zeta(a), None, lambda a: (1, math.inf), discrete=True),
    "logser": Family(lambda k, p: -(p**k) / (k * np.log1p(-p)), None, lambda p: (1, math.inf), discrete=True),
    "betabinom": Family(_pmf(lambda k, n, a, b: _lc(n, k) + S.betaln(k + a, n - k + b) - S.betaln(a, b)), None, lambda n, a, b: (0, n), discrete=True),
    "dlaplace": Family(lambda k, a: np.tanh(a / 2) * np.exp(-a * np.abs(k)), lambda k, a: np.where(k >= 0, 1 - np.exp(-a * (k + 1)) / (np.exp(-a) + 1) * 1.0, np.exp(a * (k + 1)) / (np.exp(a) + 1)), _wide, discrete=True),
    "planck": Family(lambda k, b: -np.expm1(-b) * np.exp(-b * k), lambda k, b: -np.expm1(-b * (k + 1)), _half, discrete=True),
    "yulesimon": Family(lambda k, a: a * S.beta(k, a + 1), lambda k, a: 1 - k * S.beta(k, a + 1), lambda a: (1, math.inf), discrete=True),
    "boltzmann": Family(lambda k, a, n: -np.expm1(-a) / -np.expm1(-a * n) * np.exp(-a * k), lambda k, a, n: np.expm1(-a * (k + 1)) / np.expm1(-a * n), lambda a, n: (0, n - 1), discrete=True),
    "nhypergeom": Family(_pmf(lambda k, m, n, r: _lc(k + r - 1, k) + _lc(m - r - k, n - k) - _lc(m, n)), None, lambda m, n, r: (0, n), discrete=True),
    "betanbinom": Family(_pmf(lambda k, n, a, b: S.gammaln(k + n) - S.gammaln(n) - S.gammaln(k + 1) + S.betaln(a + n, b + k) - S.betaln(a, b)), None, _half, discrete=True),
    "skellam": Family(lambda k, a, b: np.array([float(S.ive(abs(int(v)), np.float64(2 * math.sqrt(a * b)))) for v in np.atleast_1d(k).ravel()]).reshape(np.shape(k)) * np.exp(2 * math.sqrt(a * b) - a - b) * (a / b) ** (np.asarray(k) / 2), lambda k, a, b: np.where(k < 0, _ncx2_cdf(2 * b, -2 * np.minimum(k, -1), 2 * a), 1 - _ncx2_cdf(2 * a, 2 * (np.maximum(k, 0) + 1), 2 * b)), _wide, discrete=True),
    "zipfian": Family(lambda k, a, n: k ** (-float(a)) / (np.arange(1, n + 1) ** (-float(a))).sum(), None, lambda a, n: (1, n), discrete=True),
}


class Frozen:
    """A distribution with its parameters, location and scale."""

    def __init__(self, name: str, *shape: float, loc: float = 0.0, scale: float = 1.0):
        self.family = CONTINUOUS.get(name) or DISCRETE[name]
        self.name, self.shape, self.loc, self.scale = name, shape, loc, scale
        low, high = self.family.support(*shape)
        self.low, self.high = low, high

    def support(self) -> tuple[float, float]:
        return self.loc + self.scale * self.low, self.loc + self.scale * self.high

    def _z(self, x):
        return (np.asarray(x, float) - self.loc) / self.scale

    def pdf(self, x):
        z = self._z(x)
        inside = (z >= self.low) & (z <= self.high) & (~np.bool_(self.family.discrete) | (z == np.floor(z)))
        safe = np.where(inside, z, self._inner())
        with np.errstate(all="ignore"):
            return np.where(np.isnan(z), np.nan, np.where(inside, self.family.pdf(safe, *self.shape) / self.scale, 0.0))

    pmf = pdf

    def _inner(self) -> float:
        if self.family.discrete:
            return self.low if math.isfinite(self.low) else 0
        if math.isfinite(self.low) and math.isfinite(self.high):
            return (self.low + self.high) / 2
        return self.low + 1 if math.isfinite(self.low) else self.high - 1 if math.isfinite(self.high) else 0.5

    def logpdf(self, x):
        with np.errstate(all="ignore"):
            return np.log(self.pdf(x))

    def cdf(self, x):
        z = self._z(x)
        if self.family.discrete:
            z = np.floor(z)
        inside = (z >= self.low) & (z < self.high)
        safe = np.where(inside, z, self._inner())
        with np.errstate(all="ignore"):
            if self.family.cdf is None:
                top = int(np.max(safe, initial=self.low))
                sums = np.cumsum(self.family.pdf(np.arange(self.low, top + 1, dtype=float), *self.shape))
                inner = sums[(safe - self.low).astype(int)]
            else:
                inner = self.family.cdf(safe, *self.shape)
        return np.where(np.isnan(z), np.nan, np.where(z < self.low, 0.0, np.where(z >= self.high, 1.0, np.clip(inner, 0, 1))))

    def sf(self, x):
        return 1 - self.cdf(x)

    def ppf(self, p):
        p = np.asarray(p, float)
        if self.family.ppf is not None:
            with np.errstate(all="ignore"):
                z = self.family.ppf(np.where((p > 0) & (p < 1), p, 0.5), *self.shape)
        else:
            each, where = np.unique(np.where((p > 0) & (p < 1), p, 0.5), return_inverse=True)  # equal ones are inverted once
            z = self._invert(each)[where].reshape(p.shape)
        z = np.where(p == 0, self.low - self.family.discrete, np.where(p == 1, self.high, z))
        return np.where((p >= 0) & (p <= 1), self.loc + self.scale * z, np.nan)

    def _invert(self, p: np.ndarray) -> np.ndarray:
        """Where the cdf reaches each p (within 0..1): brackets are doubled, then halved, for all at once."""
        p = np.atleast_1d(np.asarray(p, float))
        f = lambda z: self.cdf(self.loc + self.scale * z)
        low = np.full(len(p), self.low if math.isfinite(self.low) else -1.0)
        high = np.maximum(low, 0) + 1.0 if not math.isfinite(self.high) else np.full(len(p), float(self.high))
        for edge, free, beyond in ((low, not math.isfinite(self.low), lambda z: f(z) > p), (high, not math.isfinite(self.high), lambda z: f(z) < p)):
            for _ in range(1100 if free else 0):
                if not (out := beyond(edge)).any():
                    break
                edge[out] = edge[out] * 2 + (1 if edge is high else 0)
        if self.family.discrete:
            low, high = np.floor(low) - 1, np.ceil(high)
        near = 0.0 if math.isfinite(self.low) else 1e-15  # about zero, where the support goes on to both sides
        for _ in range(300):
            mid = np.floor((low + high) / 2) if self.family.discrete else (low + high) / 2
            open_ = (high - low > 1) if self.family.discrete else (mid != low) & (mid != high) & (high - low > np.maximum(4e-16 * np.abs(mid), near))
            if not open_.any():
                break
            under = f(mid) < (p * (1 - 1e-14) if self.family.discrete else p)
            low, high = np.where(open_ & under, mid, low), np.where(open_ & ~under, mid, high)
        return high if self.family.discrete else (low + high) / 2

    def isf(self, p):
        return self.ppf(1 - np.asarray(p, float))

    def interval(self, confidence: float):
        return self.ppf((1 - confidence) / 2), self.ppf((1 + confidence) / 2)

    def expect(self, f: Callable) -> float:
        """E f(X), over the quantiles (or the support of a discrete distribution)."""
        if self.family.discrete:
            low = int(self.low if math.isfinite(self.low) else self._invert(1e-14)[0])
            high = int(self.high if math.isfinite(self.high) else self._invert(1 - 1e-14)[0])
            k = np.arange(low, high + 1) * self.scale + self.loc
            return float((f(k) * self.pmf(k)).sum())
        t, w = S.gauss(200)
        u = (t + 1) / 2
        q = u * u * (3 - 2 * u)  # dense at the ends, where quantiles are steep
        return float((f(self.ppf(q)) * w / 2 * 6 * u * (1 - u)).sum())

    def mean(self) -> float:
        return self.expect(lambda x: x)

    def var(self) -> float:
        m = self.mean()
        return self.expect(lambda x: (x - m) ** 2)

    def std(self) -> float:
        return math.sqrt(self.var())

    def median(self) -> float:
        return float(self.ppf(0.5))

    def entropy(self) -> float:
        return self.expect(lambda x: -np.log(np.maximum(self.pdf(x), 1e-300)))

    def rvs(self, size: int, seed: int | None = None) -> np.ndarray:
        return self.ppf(np.random.default_rng(seed).random(size))

    def column(self, method: str, x: Column) -> Column:
        """pdf, pmf, cdf, sf, ppf, ... of a Column, in Arrow batches; equal values of a batch are evaluated once."""
        name, shape, loc, scale = self.name, self.shape, self.loc, self.scale

        @F.arrow_udf("double")
        def kernel(a: pa.Array) -> pa.Array:
            frozen = Frozen(name, *shape, loc=loc, scale=scale)
            return S.on_batch(getattr(frozen, method), [None], (a,))

        return kernel(x.cast("double"))

    def sample(self, df_or_spark, n: int, seed: int = 0):
        """n variates as a DataFrame (id, x): uniforms are made where they are used, a stream a partition."""
        return df_or_spark.range(n).select("id", self.column("ppf", F.rand(seed)).alias("x"))


def __getattr__(name: str):
    if name in CONTINUOUS or name in DISCRETE:
        return lambda *shape, **kw: Frozen(name, *shape, **kw)
    raise AttributeError(name)
