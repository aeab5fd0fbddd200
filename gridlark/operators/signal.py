"""Signals: one array a row (cells) or a table of (group, time, value).

Kernels are numpy on whole signals and are registered with the cell catalogue under `signal.`; `by_group` runs any of
them on each group of a long table, one group a call. Short filters over long tables are window expressions instead."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import cells

# Windows


def _cosines(n: int, terms: Sequence[float], sym: bool = True) -> np.ndarray:
    if n <= 1:
        return np.ones(n)
    t = 2 * np.pi * np.arange(n) / (n - 1 if sym else n)
    return sum((-1) ** k * a * np.cos(k * t) for k, a in enumerate(terms))


#: Terms of the sums of cosines. Fixed values.
COSINE_WINDOWS = {
    "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411), "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def get_window(name: str, n: int, *, sym: bool = False, beta: float = 8.6, std: float | None = None, alpha: float = 0.5) -> np.ndarray:
    if name in COSINE_WINDOWS:
        return _cosines(n, COSINE_WINDOWS[name], sym)
    m = n if sym or n <= 1 else n + 1
    t = np.arange(m) - (m - 1) / 2
    half = (m - 1) / 2 or 1
    w = {
        "boxcar": lambda: np.ones(m), "bartlett": lambda: 1 - np.abs(t) / half, "triang": lambda: 1 - np.abs(t) / ((m + m % 2) / 2), "cosine": lambda: np.cos(np.pi * t / m), "gaussian": lambda: np.exp(-0.5 * (t / (std or m / 6)) ** 2),
        "kaiser": lambda: np.kaiser(m, beta), "parzen": lambda: _parzen(t, m), "bohman": lambda: (1 - np.abs(t) / half) * np.cos(np.pi * np.abs(t) / half) + np.sin(np.pi * np.abs(t) / half) / np.pi,
        "exponential": lambda: np.exp(-np.abs(t) / (std or 1.0)), "lanczos": lambda: np.sinc(t / half), "tukey": lambda: _tukey(m, alpha), "barthann": lambda: 0.62 - 0.48 * np.abs(t / (m - 1)) + 0.38 * np.cos(2 * np.pi * t / (m - 1)),
    }[name]()
    return w[:n]


def _parzen(t: np.ndarray, m: int) -> np.ndarray:
    u = np.abs(t) / (m / 2)
    return np.where(np.abs(t) <= (m - 1) / 4, 1 - 6 * u**2 + 6 * u**3, 2 * (1 - u) ** 3)


def _tukey(m: int, alpha: float) -> np.ndarray:
    x, w = np.arange(m), np.ones(m)
    edge = alpha * (m - 1) / 2
    if edge > 0:
        w = np.where(x < edge, 0.5 * (1 + np.cos(np.pi * (x / edge - 1))), w)
        w = np.where(x > (m - 1) - edge, 0.5 * (1 + np.cos(np.pi * ((x - (m - 1)) / edge + 1))), w)
    return w


# Filters


#: Samples that a recursive filter answers at once.
RUN = 32


def lfilter(b: Sequence[float], a: Sequence[float], x: np.ndarray, zi: np.ndarray | None = None, final: bool = False):
    """Direct form II transposed, a run of samples at a time: a run's output is its own input through the impulse response
    plus what the state at its start still gives, both as matrix products. Only the state goes from run to run."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    b, a = b / a[0], a / a[0]
    x = np.asarray(x, float)
    if len(a) == 1 and zi is None:
        return np.convolve(x, b)[: len(x)]
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    state = np.zeros(n - 1) if zi is None else np.array(zi, float)
    if n == 1:
        return (b[0] * x, state) if final else b[0] * x
    step = np.eye(n - 1, k=1)  # state' = step @ state + take * x; y = state[0] + b[0] * x
    step[:, 0] -= a[1:]
    take = b[1:] - a[1:] * b[0]

    def run(part: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """part: (runs, m)"""
        m = part.shape[1]
        rows, gone = np.zeros((m + 1, n - 1)), np.zeros((m, n - 1))  # what of the state is heard after k samples; what x leaves in it
        rows[0, 0] = 1
        push = take.copy()
        for k in range(m):
            rows[k + 1] = rows[k] @ step
            gone[m - 1 - k] = push
            push = step @ push
        h = np.concatenate([[b[0]], rows[: m - 1] @ take])
        lag = np.subtract.outer(np.arange(m), np.arange(m))
        y = part @ np.where(lag >= 0, h[np.maximum(lag, 0)], 0).T
        fresh, whole = part @ gone, np.linalg.matrix_power(step, m)
        states = np.empty((len(part), n - 1))
        for k in range(len(part)):
            states[k] = state
            state = whole @ state + fresh[k]
        return (y + states @ rows[:m].T).ravel(), state

    cut = len(x) // RUN * RUN
    y, state = run(x[:cut].reshape(-1, RUN), state) if cut else (np.zeros(0), state)
    if cut < len(x):
        rest, state = run(x[cut:].reshape(1, -1), state)
        y = np.concatenate([y, rest])
    return (y, state) if final else y


def lfilter_zi(b, a) -> np.ndarray:
    """State of the filter in its steady answer to a step."""
    b, a = np.atleast_1d(np.asarray(b, float)) / a[0], np.atleast_1d(np.asarray(a, float)) / a[0]
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    m = np.eye(n - 1) - np.vstack([-a[1:], np.eye(n - 2, n - 1)]).T if n > 1 else np.eye(0)
    return np.linalg.solve(m, b[1:] - a[1:] * b[0])


def filtfilt(b, a, x: np.ndarray) -> np.ndarray:
    """Forward and backward, over an odd extension at both ends."""
    x = np.asarray(x, float)
    edge = min(3 * max(len(np.atleast_1d(a)), len(np.atleast_1d(b))), len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
    zi = lfilter_zi(b, a)
    y = lfilter(b, a, ext, zi * ext[0], True)[0]
    y = lfilter(b, a, y[::-1], zi * y[-1], True)[0][::-1]
    return y[edge : len(y) - edge]


def butter(order: int, cut: float | Sequence[float], kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth filter; cut in units of the Nyquist frequency."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    w = np.tan(np.pi * np.atleast_1d(np.asarray(cut, float)) / 2) * 4
    if kind == "low":
        z, p, k = np.zeros(0), poles * w[0], w[0] ** order
    elif kind == "high":
        z, p, k = np.zeros(order), w[0] / poles, np.real(1 / np.prod(-poles))
    else:
        band, centre = w[1] - w[0], math.sqrt(w[0] * w[1])
        if kind == "bandpass":
            q = poles * band / 2
            p = np.concatenate([q + np.sqrt(q * q - centre**2), q - np.sqrt(q * q - centre**2)])
            z, k = np.zeros(order), band**order
        else:
            q = band / 2 / poles
            p = np.concatenate([q + np.sqrt(q * q - centre**2), q - np.sqrt(q * q - centre**2)])
            z, k = np.tile([1j * centre, -1j * centre], order), np.real(1 / np.prod(-poles))
    k = k * np.real(np.prod(4 - z) / np.prod(4 - p))
    z, p = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))]), (4 + p) / (4 - p)
    return np.real(k * np.poly(z)), np.real(np.poly(p))


def firwin(taps: int, cut: float | Sequence[float], window: str = "hamming", pass_zero: bool = True) -> np.ndarray:
    """Window method; cuts in units of the Nyquist frequency."""
    edges = np.atleast_1d(np.asarray(cut, float))
    edges = np.concatenate([[0.0] if pass_zero else [], edges, [1.0] if (len(edges) % 2 == 0) == pass_zero else []])
    t = np.arange(taps) - (taps - 1) / 2
    h = sum(right * np.sinc(right * t) - left * np.sinc(left * t) for left, right in edges.reshape(-1, 2))
    h = h * get_window(window, taps, sym=True)
    left, right = edges.reshape(-1, 2)[0]
    at = 0.0 if left == 0 else 1.0 if right == 1 else (left + right) / 2
    return h / (h * np.cos(np.pi * t * at)).sum()


def freqz(b, a=(1.0,), n: int = 512) -> tuple[np.ndarray, np.ndarray]:
    w = np.pi * np.arange(n) / n
    e = np.exp(-1j * w)
    return w, np.polyval(np.atleast_1d(b)[::-1], e) / np.polyval(np.atleast_1d(a)[::-1], e)


def fftconvolve(x, h, mode: str = "full") -> np.ndarray:
    x, h = np.asarray(x, float), np.asarray(h, float)
    n = len(x) + len(h) - 1
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)
    if mode == "full":
        return y
    size = len(x) if mode == "same" else len(x) - len(h) + 1
    start = (n - size) // 2
    return y[start : start + size]


def medfilt(x, size: int = 3) -> np.ndarray:
    padded = np.pad(np.asarray(x, float), size // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size), axis=1)


def savgol_coeffs(size: int, order: int, deriv: int = 0, delta: float = 1.0) -> np.ndarray:
    half = size // 2
    a = np.vander(np.arange(-half, size - half, dtype=float), order + 1, increasing=True)
    return np.linalg.pinv(a)[deriv] * math.factorial(deriv) / delta**deriv


def savgol_filter(x, size: int, order: int, deriv: int = 0, delta: float = 1.0) -> np.ndarray:
    """Polynomial smoothing; the ends take the fit of the first and last window."""
    x, half = np.asarray(x, float), size // 2
    y = np.convolve(x, savgol_coeffs(size, order, deriv, delta)[::-1], "same")
    for s, part in ((slice(0, half), x[:size]), (slice(len(x) - half, len(x)), x[-size:])):
        fit = np.polyder(np.polyfit(np.arange(size), part, order), deriv) if deriv else np.polyfit(np.arange(size), part, order)
        at = np.arange(half) if s.start == 0 else np.arange(size - half, size)
        y[s] = np.polyval(fit, at) / delta**deriv
    return y


def detrend(x, kind: str = "linear") -> np.ndarray:
    x = np.asarray(x, float)
    if kind == "constant":
        return x - x.mean()
    t = np.arange(len(x))
    return x - np.polyval(np.polyfit(t, x, 1), t)


def decimate(x, q: int) -> np.ndarray:
    return filtfilt(firwin(20 * q + 1, 1 / q), [1.0], x)[::q]


def resample(x, n: int) -> np.ndarray:
    x = np.asarray(x, float)
    return np.fft.irfft(np.fft.rfft(x)[: n // 2 + 1], n) * n / len(x)


def upfirdn(h, x, up: int = 1, down: int = 1) -> np.ndarray:
    wide = np.zeros(len(x) * up - (up - 1))
    wide[::up] = x
    return np.convolve(wide, h)[::down]


# Spectra


def periodogram(x, fs: float = 1.0, window: str = "boxcar") -> tuple[np.ndarray, np.ndarray]:
    return welch(x, fs, window, len(x), 0)


def _segments(x: np.ndarray, size: int, overlap: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[:: size - overlap]


def csd(x, y, fs: float = 1.0, window: str = "hann", size: int = 256, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.asarray(x, float), np.asarray(y, float)
    size = min(size, len(x))
    overlap = size // 2 if overlap is None else overlap
    w = get_window(window, size)
    f = lambda s: np.fft.rfft((_segments(s, size, overlap) - _segments(s, size, overlap).mean(1, keepdims=True)) * w)
    p = (np.conj(f(x)) * f(y)).mean(0) / (fs * (w * w).sum())
    p[1 : len(p) - (size % 2 == 0)] *= 2
    return np.fft.rfftfreq(size, 1 / fs), p


def welch(x, fs: float = 1.0, window: str = "hann", size: int = 256, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    f, p = csd(x, x, fs, window, size, overlap)
    return f, p.real


def coherence(x, y, fs: float = 1.0, window: str = "hann", size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    f, xy = csd(x, y, fs, window, size)
    return f, np.abs(xy) ** 2 / (welch(x, fs, window, size)[1] * welch(y, fs, window, size)[1])


def stft(x, size: int = 256, overlap: int | None = None, window: str = "hann") -> np.ndarray:
    """Frequencies by segments, from half a segment before the start, scaled by the window's sum."""
    overlap = size // 2 if overlap is None else overlap
    w = get_window(window, size)
    x = np.pad(np.asarray(x, float), size // 2)
    step = size - overlap
    x = np.pad(x, (0, -(len(x) - size) % step))
    return (np.fft.rfft(_segments(x, size, overlap) * w) / w.sum()).T


def istft(z: np.ndarray, size: int = 256, overlap: int | None = None, window: str = "hann") -> np.ndarray:
    overlap = size // 2 if overlap is None else overlap
    w, step = get_window(window, size), size - overlap
    parts = np.fft.irfft(z.T * w.sum(), size)
    y, norm = np.zeros(size + step * (len(parts) - 1)), np.zeros(size + step * (len(parts) - 1))
    for k, part in enumerate(parts):
        y[k * step : k * step + size] += part * w
        norm[k * step : k * step + size] += w * w
    return (y / np.where(norm > 1e-10, norm, 1))[size // 2 : -(size // 2)]


def spectrogram(x, fs: float = 1.0, size: int = 256, overlap: int | None = None, window: str = "hann") -> np.ndarray:
    overlap = size // 8 if overlap is None else overlap
    w = get_window(window, size)
    p = np.abs(np.fft.rfft((lambda s: s - s.mean(1, keepdims=True))(_segments(np.asarray(x, float), size, overlap)) * w)) ** 2 / (fs * (w * w).sum())
    p[:, 1 : p.shape[1] - (size % 2 == 0)] *= 2
    return p.T


def lombscargle(t, x, w) -> np.ndarray:
    t, x, w = (np.asarray(v, float) for v in (t, x, w))
    tau = np.arctan2(np.sin(2 * np.outer(w, t)).sum(1), np.cos(2 * np.outer(w, t)).sum(1)) / (2 * w)
    c, s = np.cos(w[:, None] * (t - tau[:, None])), np.sin(w[:, None] * (t - tau[:, None]))
    return 0.5 * ((c @ x) ** 2 / (c * c).sum(1) + (s @ x) ** 2 / (s * s).sum(1))


def hilbert(x) -> np.ndarray:
    n = len(x)
    f = np.fft.fft(np.asarray(x, float))
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(f * h)


def envelope(x) -> np.ndarray:
    return np.abs(hilbert(x))


def czt(x, m: int | None = None, w: complex | None = None, a: complex = 1.0) -> np.ndarray:
    """Chirp z-transform by Bluestein's convolution."""
    x = np.asarray(x, complex)
    n, m = len(x), m or len(x)
    w = np.exp(-2j * np.pi / m) if w is None else w
    k = np.arange(max(n, m)) ** 2 / 2
    chirp, size = np.power(complex(w), k), 1 << (n + m - 1).bit_length()
    y = np.fft.fft(x * np.power(complex(a), -np.arange(n)) * chirp[:n], size)
    kernel = np.zeros(size, complex)
    kernel[:m] = 1 / chirp[:m]
    kernel[size - n + 1 :] = 1 / chirp[1:n][::-1]
    return np.fft.ifft(y * np.fft.fft(kernel))[:m] * chirp[:m]


def dct(x, kind: int = 2) -> np.ndarray:
    x = np.asarray(x, float)
    n = len(x)
    k, t = np.arange(n)[:, None], np.arange(n)[None]
    if kind == 1:
        return x[0] + (-1.0) ** np.arange(n) * x[-1] + 2 * (x[1:-1] * np.cos(np.pi * k * t[:, 1:-1] / (n - 1))).sum(1)
    if kind == 2:
        return 2 * (x * np.cos(np.pi * k * (2 * t + 1) / (2 * n))).sum(1)
    if kind == 3:
        return x[0] + 2 * (x[1:] * np.cos(np.pi * (2 * k + 1) * t[:, 1:] / (2 * n))).sum(1)
    return 2 * (x * np.cos(np.pi * (2 * k + 1) * (2 * t + 1) / (4 * n))).sum(1)


def idct(x) -> np.ndarray:
    return dct(x, 3) / (2 * len(x))


def dst(x) -> np.ndarray:
    x = np.asarray(x, float)
    n = len(x)
    return 2 * (x * np.sin(np.pi * np.arange(1, n + 1)[:, None] * (2 * np.arange(n)[None] + 1) / (2 * n))).sum(1)


# Peaks and waves


def find_peaks(x, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Local maxima, the middle of flat tops; higher peaks win over near ones."""
    x = np.asarray(x, float)
    out, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    p = np.array(out, int)
    if height is not None:
        p = p[x[p] >= height]
    if distance > 1:
        keep = np.ones(len(p), bool)
        for k in np.argsort(x[p], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(p - p[k]) < distance
                near[k] = False
                keep &= ~near
        p = p[keep]
    return p if prominence is None else p[peak_prominences(x, p) >= prominence]


def peak_prominences(x, peaks) -> np.ndarray:
    x, out = np.asarray(x, float), []
    for p in peaks:
        higher = np.flatnonzero(x > x[p])
        left, right = higher[higher < p], higher[higher > p]
        a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(x))
        out.append(x[p] - max(x[a : p + 1].min(), x[p:b].min()))
    return np.array(out)


def argrelextrema(x, compare: Callable = np.greater, order: int = 1) -> np.ndarray:
    x = np.asarray(x)
    at, ok = np.arange(len(x)), np.ones(len(x), bool)
    for k in range(1, order + 1):
        ok &= compare(x, x[np.minimum(at + k, len(x) - 1)]) & compare(x, x[np.maximum(at - k, 0)])
    return np.flatnonzero(ok)


def chirp(t, f0: float, t1: float, f1: float) -> np.ndarray:
    t = np.asarray(t, float)
    return np.cos(2 * np.pi * (f0 * t + (f1 - f0) / (2 * t1) * t * t))


def square(t, duty: float = 0.5) -> np.ndarray:
    return np.where(np.mod(t, 2 * np.pi) < duty * 2 * np.pi, 1.0, -1.0)


def sawtooth(t, width: float = 1.0) -> np.ndarray:
    u = np.mod(t, 2 * np.pi) / (2 * np.pi)
    return np.where(u < width, 2 * u / width - 1, 1 - 2 * (u - width) / max(1 - width, 1e-300))


for _name, _kind, _f in [
    ("lfilter", "vector", lfilter), ("filtfilt", "vector", filtfilt), ("fftconvolve", "vector", fftconvolve), ("medfilt", "vector", medfilt), ("savgol_filter", "vector", savgol_filter), ("detrend", "vector", detrend), ("decimate", "vector", decimate), ("resample", "vector", resample),
    ("envelope", "vector", envelope), ("hilbert", "complex", hilbert), ("czt", "complex", czt), ("stft", "complexes", stft), ("spectrogram", "matrix", spectrogram), ("dct", "vector", dct), ("idct", "vector", idct), ("dst", "vector", dst), ("find_peaks", "wholes", find_peaks), ("lombscargle", "vector", lombscargle),
]:
    cells.register(f"signal.{_name}", _kind, _f)


def fir(c: Column | str, over: Window, taps: Sequence[float]) -> Column:
    """A short causal filter as lags over a window's partitions; zeros before the start."""
    return sum((float(k) * F.coalesce(F.lag(c, i).over(over), F.lit(0.0)) for i, k in enumerate(taps)), F.lit(0.0))


def moving(c: Column | str, over: Window, before: int, after: int, statistic: str = "mean") -> Column:
    """mean, min, max, sum or median of the rows from `before` earlier to `after` later ones, as far as there are any."""
    f = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": lambda v: F.percentile(v, 0.5)}[statistic]
    return f(F.col(c) if isinstance(c, str) else c).over(over.rowsBetween(-before, after))


def by_group(df: DataFrame, keys: list[str], order: str, value: str, f: Callable[[np.ndarray], np.ndarray], output: str = "y") -> DataFrame:
    """keys, k, output: f of each group's signal in order. A group is one signal and must fit a task."""
    kinds = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        y = np.asarray(f(table.column(value).to_numpy()), float)
        cols = {k: pa.array([table.column(k)[0].as_py()] * len(y), table.schema.field(k).type) for k in keys}
        return pa.table(cols | {"k": pa.array(np.arange(len(y))), output: pa.array(y)})

    return df.select(*keys, order, value).groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", k long, {output} double")
