import math

import numpy as np
import pytest
from gridlark.functions import interpolate as I
from pyspark.sql import functions as F

X = np.array([0.0, 0.7, 1.5, 2.0, 3.1, 4.0, 4.4])
Y = np.sin(X)
AT = np.linspace(0, 4.4, 60)


def test_piecewise():
    for make in (I.PchipInterpolator, I.Akima1DInterpolator, I.CubicSpline):
        f = make(X, Y)
        assert np.allclose(f(X), Y) and np.abs(f(AT) - np.sin(AT)).max() < 0.08
        assert f.integrate(0.3, 4.0) == pytest.approx(f.antiderivative()(4.0) - f.antiderivative()(0.3))
        assert np.allclose(f(AT, 1), f.derivative()(AT)) and np.allclose(f.antiderivative().derivative()(AT), f(AT))
    steps = I.PchipInterpolator([0, 1, 2, 3], [0, 0, 1, 1])
    assert (steps(np.linspace(0, 3, 50)) >= 0).all() and (steps(np.linspace(0, 3, 50)) <= 1).all()
    exact = I.CubicHermiteSpline(X, X**3, 3 * X**2)
    assert np.allclose(exact(AT), AT**3) and exact.integrate(0, 2) == pytest.approx(4)
    assert np.allclose(I.CubicSpline(X, Y).roots(), [0, math.pi], atol=0.02)
    assert np.allclose(I.BPoly([[1.0], [2.0], [5.0]], [0, 2])([0, 1, 2]), [1, 2.5, 5])


def test_polynomials():
    p = np.array([2.0, -1.0, 0.5, 3.0])
    x = np.array([0.0, 1.0, 2.5, 4.0])
    assert np.allclose(I.lagrange(x, np.polyval(p, x)), p) and np.allclose(I.KroghInterpolator(x, np.polyval(p, x))(AT), np.polyval(p, AT))
    d = np.polyder(p)
    assert np.allclose(I.krogh_interpolate([1, 1, 2, 2], [np.polyval(p, 1), np.polyval(d, 1), np.polyval(p, 2), np.polyval(d, 2)], AT), np.polyval(p, AT))
    assert np.allclose(I.FloaterHormannInterpolator(X, np.polyval(p, X))(AT), np.polyval(p, AT))
    num, den = I.pade([1 / math.factorial(k) for k in range(6)], 2)
    assert np.polyval(num, 0.7) / np.polyval(den, 0.7) == pytest.approx(math.exp(0.7), rel=1e-4)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_splines(k):
    tck = I.splrep(X, np.polyval(np.arange(1, k + 2), X), k)
    p = np.arange(1, k + 2)
    assert np.allclose(I.splev(AT, tck), np.polyval(p, AT)) and np.allclose(I.splev(AT, tck, 1), np.polyval(np.polyder(p), AT))
    assert I.splint(0.5, 3.0, tck) == pytest.approx(np.polyval(np.polyint(p), 3.0) - np.polyval(np.polyint(p), 0.5))
    assert np.allclose(I.splev(AT, I.splder(I.splantider(tck))), I.splev(AT, tck)) and np.allclose(I.to_pieces(tck)(AT), I.splev(AT, tck))
    fit = I.make_lsq_spline(AT, np.polyval(p, AT), tck[0], k)
    assert np.allclose(fit[1], tck[1])


def test_roots_and_radial_functions():
    assert np.allclose(I.sproot(I.splrep(X, (X - 1) * (X - 3))), [1, 3])
    rng = np.random.default_rng(0)
    points = rng.random((40, 2))
    for name in I.KERNELS:
        f = I.RBFInterpolator(points, points @ [2.0, -1.0] + 3, name, epsilon=3.0, degree=1)
        assert np.allclose(f(points[:9] * 0.9), points[:9] * 0.9 @ [2.0, -1.0] + 3, atol=1e-6)


def test_column(spark):
    f = I.PchipInterpolator(X, Y)
    got = [r.y for r in spark.createDataFrame([(0.7,), (None,), (2.0,)], "x double").select(I.column(f, F.col("x")).alias("y")).collect()]
    assert got[0] == pytest.approx(math.sin(0.7)) and got[1] is None and got[2] == pytest.approx(math.sin(2.0))
