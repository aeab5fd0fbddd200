import math

import numpy as np
import pytest
from gridlark.functions import cells
from gridlark.operators import images as I
from gridlark.operators import signal as G
from gridlark.operators import solve as O
from pyspark.sql import functions as F

rng = np.random.default_rng(0)
rosen = lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2


def test_roots():
    f = lambda x: x**3 - 2 * x - 5
    for got in (O.bisect(f, 2, 3), O.brentq(f, 2, 3), O.ridder(f, 2, 3), O.newton(f, 2.0), O.newton(f, 2.0, lambda x: 3 * x * x - 2)):
        assert got == pytest.approx(2.0945514815423265, abs=1e-11)
    assert O.fixed_point(math.cos, 1.0) == pytest.approx(0.7390851332151607)
    assert np.allclose(O.fsolve(lambda p: [p[0] ** 2 + p[1] - 3, p[0] - p[1] + 1], [1.0, 1.0]), [1, 2])
    with pytest.raises(ValueError):
        O.brentq(f, 5, 6)


def test_minima():
    for method in ("BFGS", "CG", "Nelder-Mead", "Powell"):
        assert np.allclose(O.minimize(rosen, [-1.2, 1.0], method=method, rounds=3000)[0], [1, 1], atol=2e-3), method
    assert np.allclose(O.minimize(rosen, [0.0, 0.0], bounds=[(-1, 0.5), (-1, 2)])[0], [0.5, 0.25], atol=1e-4)
    assert O.minimize_scalar(lambda x: (x - 2) ** 2, 0, 5) == pytest.approx(2, abs=1e-6)
    x = np.linspace(0, 4, 50)
    assert np.allclose(O.curve_fit(lambda x, a, b: a * np.exp(-b * x), x, 2.5 * np.exp(-1.3 * x), [1.0, 1.0]), [2.5, 1.3])
    a, b = rng.normal(size=(20, 4)), rng.normal(size=20)
    w = O.nnls(a, b)
    g = a.T @ (b - a @ w)
    assert (w >= 0).all() and (g[w == 0] <= 1e-8).all() and np.allclose(g[w > 0], 0, atol=1e-8)
    assert O.isotonic_regression([1, 3, 2, 4, 3.5]).tolist() == [1, 2.5, 2.5, 3.75, 3.75]


def test_programmes():
    x, v = O.linprog([-3, -5], [[1, 0], [0, 2], [3, 2]], [4, 12, 18])
    assert x.tolist() == pytest.approx([2, 6]) and v == pytest.approx(-36)
    x, v = O.linprog([1, 2, 3], a_eq=[[1, 1, 1]], b_eq=[2], a_ub=[[1, 0, 0]], b_ub=[0.5])
    assert x.tolist() == pytest.approx([0.5, 1.5, 0])
    with pytest.raises(ArithmeticError):
        O.linprog([1.0], [[1.0]], [-1.0])
    x, v = O.milp([-5, -4], [[6, 4], [1, 2]], [24, 6], [0, 1])
    assert v == pytest.approx(-20) and x.tolist() == [4, 0]
    from itertools import permutations

    for shape in ((5, 5), (4, 6), (6, 4)):
        c = rng.random(shape)
        r, k = O.linear_sum_assignment(c)
        small = c if shape[0] <= shape[1] else c.T
        assert c[r, k].sum() == pytest.approx(min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small))))


def test_integrals_and_equations():
    assert O.quad(math.exp, 0, 1)[0] == pytest.approx(math.e - 1) and O.quad(lambda x: math.exp(-x * x), -math.inf, math.inf)[0] == pytest.approx(math.sqrt(math.pi))
    assert O.dblquad(lambda y, x: x * y, 0, 1, lambda x: 0, lambda x: x) == pytest.approx(1 / 8) and O.romberg(math.sin, 0, math.pi) == pytest.approx(2)
    x = np.sort(rng.random(9))
    assert O.simpson(x**2, x) == pytest.approx((x[-1] ** 3 - x[0] ** 3) / 3) and O.simpson(np.arange(4.0) ** 2) == pytest.approx(9)
    t, y = O.solve_ivp(lambda t, y: [y[1], -y[0]], (0, 10), [1, 0], at=[0, 1, 5, 10], rtol=1e-9, atol=1e-12)
    assert np.allclose(y[0], np.cos(t), atol=1e-7)
    assert O.derivative(math.sin, 1.0) == pytest.approx(math.cos(1)) and np.allclose(O.hessian(rosen, np.array([1.0, 1.0])), [[802, -400], [-400, 200]], rtol=1e-4)


def test_interpolation(spark):
    x = np.linspace(0, 3, 9)
    cubic = x**3 - x
    s = O.Cubic(x, cubic)
    at = np.linspace(0, 3, 31)
    assert np.allclose(s(at), at**3 - at) and np.allclose(s(at, 1), 3 * at**2 - 1) and s.integrate(0.5, 2.5) == pytest.approx((2.5**4 - 0.5**4) / 4 - (2.5**2 - 0.5**2) / 2)
    p = O.Cubic([0, 1, 2, 3], [0, 0, 1, 1], "pchip")(at)
    assert (np.diff(p) >= -1e-12).all()
    n = O.Cubic(x, np.sin(x), "natural")
    assert n(np.array([0.0]), 2)[0] == pytest.approx(0, abs=1e-9) and np.allclose(O.Cubic(x, np.sin(x), "akima")(x), np.sin(x))
    assert np.allclose(O.barycentric(x[:5], cubic[:5], at[:5]), at[:5] ** 3 - at[:5])
    assert O.bspline([0, 0, 0, 1, 1, 1], [1, 2, 4], 2, [0.5]) == pytest.approx([0.25 + 1 + 1])
    assert np.allclose(O.regular_grid([np.arange(3.0), np.arange(4.0)], np.add.outer(np.arange(3.0), 2 * np.arange(4.0)), [[0.5, 1.5], [9, 9]]), [3.5, np.nan], equal_nan=True)
    df = spark.createDataFrame([(0.5,), (None,)], "x double")
    got = df.select(s.column(F.col("x")).alias("y"), O.over_rows(lambda a: O.brentq(lambda t: t * t - a, 0, 2), F.col("x")).alias("r")).collect()
    assert got[0].y == pytest.approx(0.5**3 - 0.5) and got[0].r == pytest.approx(math.sqrt(0.5)) and got[1].y is None


def test_distributed_fit(spark):
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double").cache()
    z = lambda p: p[0] + p[1] * F.col("x")
    loss = lambda p: F.log1p(F.exp(z(p))) - F.col("y") * z(p)
    grad = lambda p: [1 / (1 + F.exp(-z(p))) - F.col("y"), (1 / (1 + F.exp(-z(p))) - F.col("y")) * F.col("x")]
    got, _ = O.fit_columns(df, loss, [0.0, 0.0], grad, tol=1e-6)
    p = 1 / (1 + np.exp(-(got[0] + got[1] * x)))
    assert abs((p - y).mean()) < 1e-5 and abs(((p - y) * x).mean()) < 1e-5


def test_filters(spark):
    x = rng.normal(size=300)
    b, a = G.butter(3, 0.2)
    w, h = G.freqz(b, a, 1000)
    assert abs(h[0]) == pytest.approx(1) and abs(h[200]) == pytest.approx(math.sqrt(0.5), rel=1e-6) and abs(h[900]) < 1e-3
    for kind, cut in (("high", 0.3), ("bandpass", (0.2, 0.4)), ("bandstop", (0.2, 0.4))):
        _, h = G.freqz(*G.butter(2, cut, kind), 1000)
        assert abs(h[int(np.atleast_1d(cut)[0] * 1000)]) == pytest.approx(math.sqrt(0.5), rel=1e-5), kind
    assert np.allclose(G.lfilter([1.0], [1, -0.5], [1.0, 0, 0, 0]), 0.5 ** np.arange(4)) and np.allclose(G.filtfilt(b, a, np.ones(60)), 1)
    assert np.allclose(G.fftconvolve(x, x[:20], "same"), np.convolve(x, x[:20], "same")) and np.allclose(G.medfilt(x)[1:-1], [np.median(x[i - 1 : i + 2]) for i in range(1, 299)])
    t = np.arange(30.0)
    assert np.allclose(G.savgol_filter(t**2, 7, 2), t**2) and np.allclose(G.savgol_filter(t**2, 7, 2, 1), 2 * t) and np.allclose(G.detrend(3 * t + 1), 0)
    assert G.firwin(21, 0.3).sum() == pytest.approx(1) and np.allclose(G.get_window("hann", 8, sym=True), np.hanning(8)) and np.allclose(G.get_window("kaiser", 9, sym=True, beta=5), np.kaiser(9, 5))
    df = spark.createDataFrame([(g, i, float(i * g)) for g in (1, 2) for i in range(20)], "g int, t int, v double")
    out = G.by_group(df, ["g"], "t", "v", lambda v: np.cumsum(v)).collect()
    assert len(out) == 40 and {(r.g, r.k, r.y) for r in out if r.k == 19} == {(1, 19, 190.0), (2, 19, 380.0)}
    assert len(df.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("v")).select(cells.apply("signal.detrend", F.col("v")).alias("d")).first().d) == 20


def test_spectra():
    x = np.sin(2 * np.pi * 0.125 * np.arange(1024)) + 0.1 * rng.normal(size=1024)
    f, p = G.welch(x, size=128)
    assert f[p.argmax()] == 0.125 and (p.sum() * (f[1] - f[0])) == pytest.approx(x.var(), rel=0.1)
    f, p = G.periodogram(x)
    assert (p.sum() * f[1]) == pytest.approx(x.var(), rel=1e-6)
    assert np.allclose(G.istft(G.stft(x, 64), 64)[:1000], x[:1000]) and np.allclose(G.czt(x[:50]), np.fft.fft(x[:50])) and np.allclose(G.idct(G.dct(x[:40])), x[:40])
    assert np.allclose(G.hilbert(np.cos(np.arange(64) * np.pi / 8)).imag, np.sin(np.arange(64) * np.pi / 8)) and G.coherence(x, x, size=64)[1] == pytest.approx(1)
    assert G.find_peaks([0, 2, 0, 3, 3, 0, 1, 0]).tolist() == [1, 3, 6] and G.find_peaks([0, 2, 0, 3, 3, 0, 1, 0], prominence=1.5).tolist() == [1, 3] and G.find_peaks([0, 2, 0, 3, 0, 1, 0], distance=3).tolist() == [3]
    w = np.linspace(0.3, 1.5, 200)
    assert w[G.lombscargle(np.arange(1024), x, w).argmax()] == pytest.approx(2 * np.pi * 0.125, abs=0.01)


def test_images(spark):
    x = rng.random((12, 15))
    pad = np.pad(x, 1, "symmetric")
    v = np.lib.stride_tricks.sliding_window_view(pad, (3, 3))
    assert np.allclose(I.uniform_filter(x), v.mean((-1, -2))) and np.allclose(I.median_filter(x), np.median(v, (-1, -2))) and np.allclose(I.maximum_filter(x), v.max((-1, -2)))
    k = rng.random((3, 3))
    assert np.allclose(I.convolve(x, k), (v * k[::-1, ::-1]).sum((-1, -2))) and I.gaussian_filter(np.ones((9, 9)), 2) == pytest.approx(1)
    m = np.zeros((7, 9), int)
    m[1:4, 1:4] = m[5, 6] = m[1, 7] = 1
    m[2, 2] = 0
    lab = I.label(m)
    assert lab.max() == 3 and [int((lab == i).sum()) for i in (1, 2, 3)] == [8, 1, 1] and I.binary_fill_holes(m)[2, 2] and I.find_objects(lab)[0] == (slice(1, 4), slice(1, 4))
    d = I.distance_transform_edt(1 - m)
    at = np.argwhere(m)
    assert d[6, 0] == pytest.approx(min(np.hypot(*(a - [6, 0])) for a in at)) and I.center_of_mass(m)[0] == pytest.approx(at[:, 0].mean())
    assert (I.binary_erosion(I.binary_dilation(m)) >= m).all() and np.allclose(I.shift(x, (1, 0))[1:], x[:-1]) and np.allclose(I.zoom(x, 2)[0, 0], x[0, 0])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(lab.ravel(), np.arange(63))], "l int, v double")
    assert {r.label: r["count"] for r in I.label_statistics(df, "l", "v").collect()}[1] == 8


def test_filter_design():
    from gridlark.operators import filters as L

    db = lambda ba, w: 20 * np.log10(np.abs(np.polyval(ba[0][::-1], np.exp(-1j * np.pi * np.asarray(w))) / np.polyval(ba[1][::-1], np.exp(-1j * np.pi * np.asarray(w)))))
    inside, beyond = np.linspace(0, 0.3, 300), np.linspace(0.8, 0.99, 300)
    assert np.allclose(L.iirfilter(4, [0.2, 0.5], kind="bandpass")[1], G.butter(4, [0.2, 0.5], "bandpass")[1])
    for n in (2, 3, 4, 5):
        c1, c2, e = L.cheby1(n, 1, 0.3), L.cheby2(n, 40, 0.8), L.ellip(n, 1, 40, 0.3)
        assert db(c1, 0.3) == pytest.approx(-1) and db(c1, inside).min() == pytest.approx(-1, abs=1e-6) and db(c2, 0.8) == pytest.approx(-40) and db(c2, beyond).max() < -40 + 1e-6
        assert db(e, inside).min() == pytest.approx(-1, abs=1e-6) and db(e, inside).max() < 1e-9 and (n < 3 or db(e, beyond).max() < -40 + 1e-4)
    assert db(L.cheby1(4, 1, 0.3, "highpass"), 0.3) == pytest.approx(-1) and db(L.ellip(4, 1, 40, [0.3, 0.6], "bandstop"), 0.6) == pytest.approx(-1)
    assert db(L.iirnotch(0.3, 30), 0.3) < -200 and db(L.iirpeak(0.3, 30), 0.3) == pytest.approx(0, abs=1e-9) and L.bessel(3, 0.4)[1][0] == 1
    n, w = L.buttord(0.2, 0.3, 3, 40)
    assert db(L.iirfilter(n, w), 0.2) == pytest.approx(-3, abs=1e-9) and db(L.iirfilter(n, w), 0.3) <= -40


def test_filter_forms():
    from gridlark.operators import filters as L

    x = np.random.default_rng(0).normal(size=300)
    ba, sos = L.ellip(5, 1, 40, 0.3), L.ellip(5, 1, 40, 0.3, output="sos")
    assert np.allclose(L.sosfilt(sos, x), G.lfilter(*ba, x)) and np.allclose(L.sos2tf(sos)[0], ba[0]) and np.allclose(L.sosfilt(L.tf2sos(*ba), x), G.lfilter(*ba, x))
    assert np.allclose(L.sosfiltfilt(L.iirfilter(4, 0.3, output="sos"), x), G.filtfilt(*G.butter(4, 0.3), x))
    assert np.allclose(np.abs(L.sosfreqz(sos, 64)[1]), np.abs(G.freqz(*ba, 64)[1])) and np.allclose(L.zpk2tf(*L.sos2zpk(sos))[1], ba[1])
    ss = L.tf2ss(*ba)
    assert np.allclose(L.ss2tf(*ss)[0], ba[0]) and np.allclose(L.dlsim(ss, x), G.lfilter(*ba, x)) and np.allclose(L.dstep(ss, 9), G.lfilter(*ba, np.ones(9))) and np.allclose(L.dimpulse(ss, 9), G.lfilter(*ba, L.unit_impulse(9)))
    r, p, whole = L.residue([1, 2, 0, 1], [1, 3, 2])
    assert (r / (1.7 - p)).sum() + np.polyval(whole, 1.7) == pytest.approx(np.polyval([1, 2, 0, 1], 1.7) / np.polyval([1, 3, 2], 1.7))
    q, rest = L.deconvolve(np.convolve([1, 2, 3], [2, 1]) + [0, 0, 0, 1], [2, 1])
    assert np.allclose(np.convolve([2, 1], q) + rest, np.convolve([1, 2, 3], [2, 1]) + [0, 0, 0, 1])
    a, b, c, d = L.cont2discrete(([[-2.0]], [[1.0]], [[1.0]], [[0.0]]), 0.1)
    assert a[0, 0] == pytest.approx(math.exp(-0.2)) and b[0, 0] == pytest.approx((1 - math.exp(-0.2)) / 2)
    assert all(int(L.max_len_seq(n).sum()) == 2 ** (n - 1) for n in range(2, 12)) and L.vectorstrength([0, 1, 2], 1.0)[0] == pytest.approx(1)
    assert np.allclose(L.convolve2d(np.eye(3), np.ones((2, 2)), "valid"), [[2, 1], [1, 2]]) and L.correlate2d(np.eye(2), np.eye(2)).max() == 2 and L.group_delay([1, 0, 0, 1], [1])[1][1] == pytest.approx(1.5)
