"""Array mathematics that SQL can't express, in NumPy; no Spark here.

Kernels take batches ``x[n, samples]`` in double precision and return arrays of the same
number of rows. Filter designs are cached by their parameters.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import repeat

import numpy as np

EPS = 1e-10


def fft_length(n: int, full: bool = False) -> int:
    """Twice the power of two at or over n, or over 2n - 1 for ``full``."""
    m = 2 * n - 1 if full else n
    return 2 * (1 << max(0, (m - 1).bit_length()))


# Correlation. Lag l of r is the sum over n of a[n + l] b[n].


def cross_full(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Linear correlation, lags -(m - 1) to n - 1."""
    n, m = a.shape[1], b.shape[1]
    size = 1 << (n + m - 2).bit_length() if n + m > 2 else 1
    r = np.fft.irfft(np.fft.rfft(a, size, axis=1) * np.conj(np.fft.rfft(b, size, axis=1)), size, axis=1)
    return np.concatenate([r[:, size - (m - 1) :] if m > 1 else r[:, :0], r[:, :n]], axis=1)


def cross_basic(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``cross_full`` over both deviations and the length."""
    scale = a.std(axis=1) * b.std(axis=1) * a.shape[1]
    return cross_full(a, b) / np.where(scale > 0, scale, 1.0)[:, None]


def cross_same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The middle n lags of ``cross_full``."""
    n, m = a.shape[1], b.shape[1]
    skip = (m - 1) // 2
    return cross_full(a, b)[:, skip : skip + n]


def _weighted(a: np.ndarray, b: np.ndarray, size: int, weight: str) -> np.ndarray:
    x, y = np.fft.rfft(a, size, axis=1), np.fft.rfft(b, size, axis=1)
    cross = x * np.conj(y)
    if weight == "phat":
        cross = cross / (np.abs(cross) + EPS)
    elif weight == "roth":
        cross = cross / (np.abs(x) ** 2 + EPS)
    elif weight == "scot":
        cross = cross / (np.sqrt(np.abs(x) ** 2 * np.abs(y) ** 2) + EPS)
    return np.fft.irfft(cross, size, axis=1)


def gcc(a: np.ndarray, b: np.ndarray, weight: str = "phat", max_lag: int | None = None, full: bool = False) -> np.ndarray:
    """Zero-padded generalised correlation, lags -max_lag to max_lag (n - 1 at most)."""
    n = a.shape[1]
    size = fft_length(n, full)
    keep = min(n - 1 if max_lag is None else max_lag, size // 2 - 1)
    r = _weighted(a, b, size, weight)
    return np.concatenate([r[:, size - keep :] if keep else r[:, :0], r[:, : keep + 1]], axis=1)


def gcc_circular(a: np.ndarray, b: np.ndarray, weight: str = "phat") -> np.ndarray:
    """Unpadded, with lag 0 in the middle: lags -(n // 2) to (n - 1) // 2."""
    if a.shape != b.shape or not a.shape[1]:
        raise ValueError("signals of equal, positive length are needed")
    return np.fft.fftshift(_weighted(a, b, a.shape[1], weight), axes=1)


def cross_normalised(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Frequency-domain correlation over its greatest magnitude."""
    r = gcc(a, b, "none", full=True)
    return r / (np.abs(r).max(axis=1, keepdims=True) + EPS)


def lms(reference: np.ndarray, wanted: np.ndarray, taps: int = 32, rate: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive filter over all rows at once: (output, error); the first ``taps`` outputs are 0."""
    out = np.zeros_like(wanted, dtype=float)
    if wanted.shape[1] <= taps:
        return out, out.copy()
    past = _segments(reference[:, :-1], taps, 1)[:, :, ::-1]
    weights = np.zeros((len(wanted), taps))
    for step in range(past.shape[1]):
        out[:, taps + step] = np.einsum("ij,ij->i", weights, past[:, step])
        weights += rate * (wanted[:, taps + step] - out[:, taps + step])[:, None] * past[:, step]
    error = wanted - out
    error[:, :taps] = 0
    return out, error


def cross_adaptive(a: np.ndarray, b: np.ndarray, taps: int = 32, rate: float = 0.01) -> np.ndarray:
    return cross_basic(a, lms(a, b, taps, rate)[1])


# Wavelets.

#: The decomposition low-pass of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
    -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
])


def dwt(x: np.ndarray, low: np.ndarray = DB4) -> tuple[np.ndarray, np.ndarray]:
    """One level with half-sample symmetric extension: (approximation, detail)."""
    taps = len(low)
    high = low[::-1] * (-1.0) ** np.arange(1, taps + 1)
    edge = taps - 1
    wide = np.pad(x, ((0, 0), (edge, edge)), mode="symmetric")
    kernel = np.lib.stride_tricks.sliding_window_view(wide, taps, axis=1)[:, 1::2]
    return kernel @ low[::-1], kernel @ high[::-1]


def wavedec(x: np.ndarray, levels: int = 5) -> list[np.ndarray]:
    """Approximation, then details from the coarsest to the finest."""
    details = []
    for _ in range(levels):
        x, d = dwt(x)
        details.append(d)
    return [x, *details[::-1]]


def cross_wavelet(a: np.ndarray, b: np.ndarray, levels: int = 5) -> np.ndarray:
    """Correlations of the levels, stretched to n and weighted 1, 2, 4, ... from the coarsest."""
    n, out, weights = a.shape[1], np.zeros_like(a, dtype=float), 0.0
    for i, (x, y) in enumerate(zip(wavedec(a, levels), wavedec(b, levels), strict=True)):
        r = cross_same(x, y)
        at = np.linspace(0, 1, n)
        out += 2.0**i * np.stack([np.interp(at, np.linspace(0, 1, r.shape[1]), row) for row in r])
        weights += 2.0**i
    return out / weights


def wavelet_packet_energies(x: np.ndarray, levels: int = 4) -> np.ndarray:
    nodes = [x]
    for _ in range(levels):
        nodes = [part for node in nodes for part in dwt(node)]
    return np.stack([(v**2).sum(axis=1) for v in nodes], axis=1)


def cwt_energies(x: np.ndarray, scales: int = 32, w0: float = 5.0) -> np.ndarray:
    """Energy of a Morlet transform at scales 1 to ``scales``."""
    out = []
    for s in range(1, scales + 1):
        t = np.arange(-min(10 * s, x.shape[1]) // 2, min(10 * s, x.shape[1]) // 2 + 1) / s
        wave = np.exp(-t * t / 2) * np.cos(w0 * t) / np.sqrt(s)
        out.append((cross_same(x, np.repeat(wave[None], len(x), axis=0)) ** 2).sum(axis=1))
    return np.stack(out, axis=1)


# Filters.


@lru_cache(maxsize=64)
def butterworth(order: int, low: float | None, high: float | None, stop: bool = False) -> np.ndarray:
    """Second-order sections [b0 b1 b2 1 a1 a2] for cut-offs as shares of the Nyquist frequency.

    Low-pass with ``high`` alone, high-pass with ``low`` alone, band-pass or band-stop with both.
    """
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 4 * np.tan(np.pi * f / 2)
    if low is None or high is None:
        w = warp(high if low is None else low)
        p = poles * w if low is None else w / poles
        z = np.zeros(0) if low is None else np.zeros(order)
    else:
        a, b = warp(low), warp(high)
        half, centre = (b - a) / 2 * (1 / poles if stop else poles), a * b
        root = np.sqrt(half**2 - centre + 0j)
        p = np.concatenate([half + root, half - root])
        z = np.repeat([1j, -1j], order) * np.sqrt(centre) if stop else np.zeros(order)
    zd, pd = (4 + z) / (4 - z), (4 + p) / (4 - p)
    zd = np.concatenate([zd, -np.ones(len(pd) - len(zd))])
    at = 0.0 if high is not None and low is None or stop else np.pi if high is None else 2 * np.arctan(np.sqrt(warp(low) * warp(high)) / 4)
    point = np.exp(1j * at)
    gain = np.abs(np.prod(point - pd) / np.prod(point - zd))
    return _sections(zd, pd, float(gain))


def _pairs(roots: np.ndarray) -> list[tuple[complex, complex]]:
    """Conjugates together; real roots by two, the outer ones first."""
    up = sorted(roots[roots.imag > 1e-12], key=lambda r: abs(abs(r) - 1))
    real = sorted(roots[np.abs(roots.imag) <= 1e-12].real)
    out = [(r, np.conj(r)) for r in up]
    while len(real) > 1:
        out.append((complex(real.pop(0)), complex(real.pop())))
    return out + [(complex(r), 0j) for r in real]


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    rows = []
    for (z1, z2), (p1, p2) in zip(_pairs(zeros), _pairs(poles), strict=True):
        rows.append([1, -(z1 + z2).real, (z1 * z2).real, 1, -(p1 + p2).real, (p1 * p2).real])
    out = np.array(rows)
    out[0, :3] *= gain
    return out


@lru_cache(maxsize=64)
def notch(f: float, q: float) -> np.ndarray:
    """One section that takes out the share ``f`` of the Nyquist frequency with quality ``q``."""
    w = np.pi * f
    g = 1 / (1 + np.tan(w / q / 2))
    return np.array([[g, -2 * g * np.cos(w), g, 1, -2 * g * np.cos(w), 2 * g - 1]])


def _stepped(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections one after another, all rows at once, sample by sample (direct form II transposed), from states [rows, 2 a section]: output and last states."""
    y, last = np.ascontiguousarray(x.T), np.empty_like(state)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s1, s2 = state[:, 2 * k], state[:, 2 * k + 1]
        out = np.empty_like(y)
        for i, v in enumerate(y):
            o = b0 * v + s1
            s1 = b1 * v - a1 * o + s2
            s2 = b2 * v - a2 * o
            out[i] = o
        last[:, 2 * k], last[:, 2 * k + 1] = s1, s2
        y = out
    return y.T, last


@lru_cache(maxsize=128)
def _block(sos: bytes, size: int) -> tuple[np.ndarray, ...]:
    """The filter over ``size`` samples as matrices: from samples and from states, to samples and to states."""
    sections = np.frombuffer(sos).reshape(-1, 6)
    ones = np.eye(size + 2 * len(sections))
    y, last = _stepped(sections, ones[:, :size], ones[:, size:])
    return y[:size].copy(), y[size:].copy(), last[:size].copy(), last[size:].copy()


def sosfilt(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None, size: int = 64) -> np.ndarray:
    """Sections one after another, all rows at once; long signals in blocks of ``size`` samples, whose states are handed on."""
    x = x.astype(float)
    now = np.zeros((len(x), 2 * len(sos))) if state is None else x[:, :1] * state.reshape(1, -1)
    whole = x.shape[1] // size
    if whole < 8 or not len(x):
        return _stepped(sos, x, now)[0]
    to_y, from_state, to_state, on = _block(np.ascontiguousarray(sos, float).tobytes(), size)
    parts = x[:, : whole * size].reshape(-1, size)
    y, kick = (parts @ to_y).reshape(len(x), whole, size), (parts @ to_state).reshape(len(x), whole, -1)
    states = np.empty_like(kick)
    for i in range(whole):
        states[:, i] = now
        now = now @ on + kick[:, i]
    y += states @ from_state
    return np.concatenate([y.reshape(len(x), -1), _stepped(sos, x[:, whole * size :], now)[0]], axis=1)


def _steady(sos: np.ndarray) -> np.ndarray:
    """States of the sections after an endless step of height one."""
    out, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        after = level * (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = b2 * level - a2 * after
        out.append([b1 * level - a1 * after + s2, s2])
        level = after
    return np.array(out)


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with an odd extension at both ends."""
    edge = min(3 * (2 * len(sos) + 1), x.shape[1] - 1)
    if edge <= 0:
        return x.astype(float)
    left = 2 * x[:, :1] - x[:, edge:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]
    wide = np.concatenate([left, x, right], axis=1)
    state = _steady(sos)
    y = sosfilt(sos, wide, state)
    y = sosfilt(sos, y[:, ::-1], state)[:, ::-1]
    return y[:, edge:-edge]


def bandpass(x: np.ndarray, low: float, high: float, rate: float, order: int = 4, clamp: bool = True) -> np.ndarray:
    """Zero-phase Butterworth; the signal itself where the band is empty."""
    a, b = low / (rate / 2), high / (rate / 2)
    if clamp:
        a, b = min(max(a, 0.01), 0.99), min(max(b, 0.01), 0.99)
    if a >= b or b >= 1:
        return x.astype(float)
    return zero_phase(butterworth(order, a, b), x)


def highpass(x: np.ndarray, cut: float, rate: float, order: int = 4) -> np.ndarray:
    return x.astype(float) if cut >= rate / 2 else zero_phase(butterworth(order, cut / (rate / 2), None), x)


def lowpass(x: np.ndarray, cut: float, rate: float, order: int = 4) -> np.ndarray:
    return x.astype(float) if cut >= rate / 2 else zero_phase(butterworth(order, None, cut / (rate / 2)), x)


def bandstop(x: np.ndarray, low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    return x.astype(float) if high >= rate / 2 else zero_phase(butterworth(order, low / (rate / 2), high / (rate / 2), True), x)


def remove_hum(x: np.ndarray, rate: float, base: float = 60.0, harmonics: int = 5, q: float = 30.0) -> np.ndarray:
    """Notches at the mains frequency and its harmonics, up to the Nyquist frequency."""
    for k in range(1, harmonics + 1):
        if base * k >= rate / 2:
            break
        x = zero_phase(notch(base * k / (rate / 2), q), x)
    return x


def comb(x: np.ndarray, rate: float, base: float, harmonics: int = 5, width: float = 5.0) -> np.ndarray:
    for k in range(1, harmonics + 1):
        if base * k >= rate / 2:
            break
        x = zero_phase(notch(base * k / (rate / 2), base * k / width), x)
    return x


def prepare(x: np.ndarray, rate: float, low: float = 100.0, high: float = 1500.0, alpha: float = 0.9) -> np.ndarray:
    """Mean off, band-pass, pre-whitening, unit deviation."""
    y = bandpass(x - x.mean(axis=1, keepdims=True), low, high, rate)
    y = np.concatenate([y[:, :1], y[:, 1:] - alpha * y[:, :-1]], axis=1)
    s = y.std(axis=1, keepdims=True)
    return y / np.where(s > 0, s, 1.0)


def default_pipeline(x: np.ndarray, rate: float) -> np.ndarray:
    """DC, hum, high-pass 50, low-pass 2000."""
    return lowpass(highpass(remove_hum(x - x.mean(axis=1, keepdims=True), rate), 50.0, rate), 2000.0, rate)


def median_filter(x: np.ndarray, width: int = 3) -> np.ndarray:
    """Running median of odd width over the reflected signal."""
    width += 1 - width % 2
    wide = np.pad(x, ((0, 0), (width // 2, width // 2)), mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, width, axis=1), axis=2)


def wiener(x: np.ndarray, width: int = 3) -> np.ndarray:
    """Local Wiener filter; the noise is the variance of the first tenth."""
    noise = x[:, : max(1, x.shape[1] // 10)].var(axis=1, keepdims=True)
    wide = np.pad(x.astype(float), ((0, 0), (width // 2, width // 2)))
    view = np.lib.stride_tricks.sliding_window_view(wide, width, axis=1)
    m, v = view.mean(axis=2), view.var(axis=2)
    return np.where(v < noise, m, m + (x - m) * (1 - noise / np.maximum(v, 1e-300)))


# Spectra.


def _hann(n: int, periodic: bool = True) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else max(n - 1, 1)))


def _segments(x: np.ndarray, width: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, ::step]


def welch(x: np.ndarray, rate: float, width: int = 2048, y: np.ndarray | None = None, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided density (cross-density with ``y``): periodic Hann, half overlap, mean off."""
    width = min(width, x.shape[1])
    step = width - (width // 2 if overlap is None else overlap)
    w = _hann(width)
    spectrum = lambda s: np.fft.rfft((s - s.mean(axis=2, keepdims=True)) * w, axis=2)
    a = spectrum(_segments(x, width, step))
    b = a if y is None else spectrum(_segments(y, width, step))
    p = (np.conj(a) * b).mean(axis=1) / (rate * (w**2).sum())
    p[:, 1 : None if width % 2 else -1] *= 2
    return np.fft.rfftfreq(width, 1 / rate), p if y is not None else p.real


def coherence(a: np.ndarray, b: np.ndarray, rate: float, width: int = 512, overlap: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude-squared coherence."""
    width = min(width, a.shape[1])
    overlap = min(overlap, width // 2)
    f, ab = welch(a, rate, width, b, overlap)
    aa, bb = welch(a, rate, width, None, overlap)[1], welch(b, rate, width, None, overlap)[1]
    return f, np.abs(ab) ** 2 / np.maximum(aa * bb, 1e-300)


def spectral_features(x: np.ndarray, rate: float, low: float = 100.0, high: float = 1500.0) -> dict[str, np.ndarray]:
    """Entropy, dominant frequency and power, band power share, centroid, from one Welch density."""
    f, p = welch(x, rate)
    share = p / (p.sum(axis=1, keepdims=True) + 1e-12) + 1e-12
    share = share / share.sum(axis=1, keepdims=True)
    top = p.argmax(axis=1)
    band = (f >= low) & (f <= high)
    whole = p.sum(axis=1) + 1e-12
    return {
        "entropy": -(share * np.log(share)).sum(axis=1), "dominant_hz": f[top], "dominant_power": p[np.arange(len(p)), top],
        "band_ratio": p[:, band].sum(axis=1) / whole, "centroid_hz": (p * f).sum(axis=1) / whole,
    }


def coherence_bands(f: np.ndarray, c: np.ndarray, floor: float = 0.7, width: float = 50.0, most: int = 5) -> list[tuple[float, float]]:
    """Runs of frequencies over ``floor``, ``width`` Hz wide at least; the most coherent ones first."""
    over = np.concatenate([[False], c > floor, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1]).reshape(-1, 2)
    found = [(float(c[a:b].mean()), float(f[a]), float(f[b - 1])) for a, b in edges if f[b - 1] - f[a] >= width]
    return [(lo, hi) for _, lo, hi in sorted(found, reverse=True)[:most]]


def coherence_weighted(a: np.ndarray, b: np.ndarray, rate: float, exponent: float = 1.0) -> np.ndarray:
    """PHAT of each coherent band, weighted by its mean coherence; of the whole signal where there is none."""
    f, c = coherence(a, b, rate, 256, 128)
    bands = [coherence_bands(f, row) for row in c]
    parts = {(i, band): None for i, row in enumerate(bands) for band in row or [None]}
    rows: dict[tuple[float, float] | None, list[int]] = {}
    for i, band in parts:
        rows.setdefault(band, []).append(i)
    #: One filter run for all rows with a band.
    for band, at in rows.items():
        x, y = a[at], b[at]
        for i, r in zip(at, gcc_circular(x, y) if band is None else gcc_circular(bandpass(x, *band, rate), bandpass(y, *band, rate)), strict=True):
            parts[i, band] = r
    out = []
    for i, row in enumerate(bands):
        weights = [float(c[i][(f >= lo) & (f <= hi)].mean()) ** exponent for lo, hi in row]
        out.append(sum(w * parts[i, band] for w, band in zip(weights, row, strict=True)) / sum(weights) if row else parts[i, None])
    return np.stack(out)


def stft(x: np.ndarray, width: int = 512, hop: int = 128) -> np.ndarray:
    return np.fft.rfft(_segments(x, width, hop) * _hann(width, False), axis=2)


def istft(spec: np.ndarray, n: int, width: int = 512, hop: int = 128) -> np.ndarray:
    frames = np.fft.irfft(spec, width, axis=2) * _hann(width, False)
    out, norm = np.zeros((len(spec), max(n, (frames.shape[1] - 1) * hop + width))), np.zeros(max(n, (frames.shape[1] - 1) * hop + width))
    for k in range(frames.shape[1]):
        out[:, k * hop : k * hop + width] += frames[:, k]
        norm[k * hop : k * hop + width] += _hann(width, False) ** 2
    return (out / np.where(norm > 1e-10, norm, 1.0))[:, :n]


def spectral_subtraction(x: np.ndarray, noise_psd: np.ndarray, alpha: float = 1.5, floor: float = 0.01, width: int = 512, hop: int = 128) -> np.ndarray:
    """Magnitudes less ``alpha`` times the mean noise density, not under ``floor`` of themselves; phases stay."""
    if x.shape[1] < width:
        return x.astype(float)
    spec = stft(x, width, hop)
    size = np.abs(spec)
    less = np.maximum(size - alpha * np.reshape(noise_psd.mean(axis=-1), (-1, 1, 1)), floor * size)
    return istft(less * np.exp(1j * np.angle(spec)), x.shape[1], width, hop)


@lru_cache(maxsize=8)
def mel_bank(mels: int, n_fft: int, rate: float) -> np.ndarray:
    """HTK triangles, [bins, mels]."""
    to, back = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = back(np.linspace(to(0.0), to(rate / 2), mels + 2))
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: float, mels: int = 64, n_fft: int = 512, hop: int = 128, db: float = 20.0) -> np.ndarray:
    """[rows, frames, mels] of decibels, in steps of half precision."""
    spec = np.abs(np.fft.rfft(_segments(x, n_fft, hop) * _hann(n_fft), axis=2)) @ mel_bank(mels, n_fft, rate)
    return (db * np.log10(np.maximum(spec, EPS))).astype(np.float16).astype(float)


def mfcc(x: np.ndarray, rate: float, count: int = 13, **options: float) -> np.ndarray:
    """Orthonormal cosine transform of the log-mel frames."""
    mel = log_mel(x, rate, **options)
    n = mel.shape[2]
    basis = np.cos(np.pi / n * (np.arange(n)[:, None] + 0.5) * np.arange(count)) * np.sqrt(2 / n)
    basis[:, 0] /= np.sqrt(2)
    return mel @ basis


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = x.shape[1]
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * keep, axis=1))


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """To ``n`` samples in the frequency domain."""
    m = x.shape[1]
    spec = np.fft.rfft(x, axis=1)
    bins = min(n, m) // 2 + 1
    out = np.zeros((len(x), n // 2 + 1), complex)
    out[:, :bins] = spec[:, :bins]
    if min(n, m) % 2 == 0 and n != m:
        out[:, bins - 1] *= 2.0 if n < m else 0.5
    return np.fft.irfft(out, n, axis=1) * (n / m)


def autocorrelation(x: np.ndarray) -> np.ndarray:
    r = cross_full(x, x)[:, x.shape[1] - 1 :]
    return r / np.where(np.abs(r[:, :1]) > 0, r[:, :1], 1.0)


def signal_snr_db(x: np.ndarray) -> np.ndarray:
    """Mean power over the mean of the lowest tenth of the spectrum's powers."""
    p = np.sort(np.abs(np.fft.rfft(x, axis=1)) ** 2, axis=1)
    floor = p[:, : max(1, p.shape[1] // 10)].mean(axis=1)
    with np.errstate(divide="ignore"):
        return np.where(floor > 0, 10 * np.log10(p.mean(axis=1) / np.where(floor > 0, floor, 1)), np.inf)


# Peaks.


def local_maxima(r: np.ndarray) -> np.ndarray:
    """Indices of strict maxima; of a flat top its middle."""
    step = np.sign(np.diff(r))
    turns = np.flatnonzero(step)
    up = np.flatnonzero((step[turns[:-1]] > 0) & (step[turns[1:]] < 0)) if len(turns) > 1 else np.empty(0, int)
    return (turns[up] + 1 + turns[up + 1]) // 2


def find_peaks(r: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Maxima of ``height`` at least; of those nearer than ``distance`` the higher ones win."""
    at = local_maxima(r)
    at = at[r[at] >= height]
    keep = np.ones(len(at), bool)
    for i in np.argsort(r[at], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    return at[keep]


def spline_peak(r: np.ndarray, k: int, half: int = 10, factor: int = 10) -> float:
    """Index of the maximum of a not-a-knot cubic spline around ``k``, on a grid ``factor`` times as fine."""
    a, b = max(0, k - half), min(len(r), k + half + 1)
    y, n = r[a:b], b - a
    if n < 4:
        return float(k)
    m = np.zeros((n, n))
    d = np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = 1, 4, 1
        d[i] = 6 * (y[i - 1] - 2 * y[i] + y[i + 1])
    m[0, :3] = m[-1, -3:] = 1, -2, 1
    c = np.linalg.solve(m, d)
    t = np.linspace(0, n - 1, (n - 1) * factor + 1)
    i = np.minimum(t.astype(int), n - 2)
    u = t - i
    s = c[i] * (1 - u) ** 3 / 6 + c[i + 1] * u**3 / 6 + (y[i] - c[i] / 6) * (1 - u) + (y[i + 1] - c[i + 1] / 6) * u
    return float(a + t[s.argmax()])


# Stacks and solvers.


def huber_stack(x: np.ndarray, delta: float = 1.35, rounds: int = 10, stop: float = 1e-6) -> np.ndarray:
    """Robust mean of the rows by reweighting, until the whole vector settles."""
    now = x.mean(axis=0)
    for _ in range(rounds):
        off = np.abs(x - now)
        w = np.where(off <= delta, 1.0, delta / np.maximum(off, 1e-300))
        new = (w * x).sum(axis=0) / w.sum(axis=0)
        moved = np.abs(new - now).mean()
        now = new
        if moved < stop:
            break
    return now


def trimmed_stack(x: np.ndarray, share: float = 0.1, weights: np.ndarray | None = None) -> np.ndarray:
    """Weighted mean of each sample without the int(n share) lowest and highest rows."""
    n = len(x)
    cut = int(n * share)
    order = np.argsort(x, axis=0, kind="stable")[cut : n - cut]
    w = (np.ones(n) if weights is None else weights)[order]
    return (np.take_along_axis(x, order, axis=0) * w).sum(axis=0) / w.sum(axis=0)


def alignment_shift(reference: np.ndarray, x: np.ndarray, reach: int = 1000) -> int:
    """Samples by which ``x`` lies after the reference: the best lag near the centre."""
    r = cross_same(x[None], reference[None])[0]
    centre = len(r) // 2
    low = max(0, centre - reach)
    return int(low + r[low : centre + reach].argmax() - centre)


def shift(x: np.ndarray, by: int) -> np.ndarray:
    """Moved right by ``by`` samples (left if negative), filled with zeros."""
    out = np.zeros_like(x)
    if abs(by) < len(x):
        out[max(0, by) : len(x) + min(0, by)] = x[max(0, -by) : len(x) - max(0, by)]
    return out


def plane_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all points of the plane. Squares are the C library's, whose last bit decides what merges first."""
    i, j = np.triu_indices(len(x), 1)
    square = lambda v: np.fromiter(map(math.pow, (v[i] - v[j]).tolist(), repeat(2.0)), float, len(i))
    out = np.zeros((len(x), len(x)))
    out[i, j] = out[j, i] = np.sqrt(square(x) + square(y))
    return out


def average_linkage(distances: np.ndarray, limit: float) -> np.ndarray:
    """Cluster ids from 0 in the order of first members; merges while the mean distance is within ``limit``.

    Means are added up anew from the points, in the members' order with the older group outside; of equal
    means, the pair goes first whose older, then whose younger group has the lower first member.
    """
    n = len(distances)
    group, born, size, d = np.arange(n), np.arange(n), np.ones(n, int), distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    #: A group has the number of its first member; ``least`` is the smallest entry of each row.
    least = d.min(axis=1, initial=np.inf)
    for step in range(n, 2 * n - 1):
        low = least.min()
        if not low <= limit:
            break
        ties = [(i, j) if born[i] < born[j] else (j, i) for i in np.flatnonzero(least == low) for j in np.flatnonzero(d[i] == low)]
        i, j = min(ties)
        keep, gone = min(i, j), max(i, j)
        stale = (np.minimum(d[keep], d[gone]) == least) & np.isfinite(least)
        group[group == gone] = keep
        members = np.flatnonzero(group == keep)
        size[keep], born[keep] = len(members), step
        #: ``bincount`` adds in the order of its input.
        sums = np.bincount(np.repeat(group, len(members)), weights=distances[:, members].ravel(), minlength=n)
        mean = np.where(np.isfinite(d[keep]), sums / (size * len(members)), np.inf)
        mean[[keep, gone]] = np.inf
        d[gone] = d[:, gone] = least[gone] = np.inf
        d[keep] = d[:, keep] = mean
        least = np.minimum(least, mean)
        stale[keep], stale[gone] = True, False
        least[stale] = d[stale].min(axis=1)
    return np.unique(group, return_inverse=True)[1]


def trilaterate(anchors: np.ndarray, ranges: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Least-squares point in the plane by Levenberg-Marquardt from the centroid."""
    x, damp = anchors.mean(axis=0), 1e-3
    cost = lambda p: (np.linalg.norm(anchors - p, axis=1) - ranges)
    now = (cost(x) ** 2).sum()
    for _ in range(rounds):
        d = np.linalg.norm(anchors - x, axis=1)
        j = (x - anchors) / np.maximum(d, 1e-12)[:, None]
        normal = j.T @ j
        step = np.linalg.solve(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), -j.T @ (d - ranges))
        new = (cost(x + step) ** 2).sum()
        if new < now:
            x, now, damp = x + step, new, damp / 3
            if np.linalg.norm(step) < 1e-10:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return x


def joint_search(r: np.ndarray, lag0: int, length: float, rate: float, dx: float = 0.5, dc: float = 50.0, c_range: tuple[float, float] = (200.0, 6000.0)) -> tuple[float, float, float, float]:
    """(position, speed, score, confidence) of the best cell; of equal cells the first by position, then speed."""
    x = np.arange(0, length + dx / 2, dx)[:, None]
    c = np.arange(c_range[0], c_range[1] + dc / 2, dc)[None, :]
    #: A source at x is heard at B by (length - 2x)/c later: the peak lies at minus that lag.
    at = -np.trunc((length - 2 * x) / c * rate).astype(int) - lag0
    score = np.where((at >= 0) & (at < len(r)), r[np.clip(at, 0, len(r) - 1)], 0.0)
    i, j = np.unravel_index(score.argmax(), score.shape)
    best = float(score[i, j])
    return float(x[i, 0]), float(c[0, j]), best, best / (float(np.abs(r).max()) + EPS)
