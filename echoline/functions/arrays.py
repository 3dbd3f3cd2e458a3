"""Whole-signal arithmetic on array columns with higher-order functions: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once a row. Inside another lambda a plain expression
    would be worked out again for every element."""
    return F.transform(F.array(value), f)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def moment(x: Column, power: int) -> Column:
    """Central population moment."""
    return let(mean(x), lambda m: total(F.transform(x, lambda v: F.pow(v - m, F.lit(power))))) / F.size(x)


def rms(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x))


def excess_kurtosis(x: Column) -> Column:
    """Population form; 0 for a constant signal."""
    m2 = moment(x, 2)
    return F.when(m2 > 1e-16, moment(x, 4) / (m2 * m2) - 3).otherwise(F.lit(0.0))


def skewness(x: Column) -> Column:
    m2 = moment(x, 2)
    return F.when(m2 > 1e-16, moment(x, 3) / F.pow(m2, F.lit(1.5))).otherwise(F.lit(0.0))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def median(x: Column) -> Column:
    s, n = F.array_sort(x), F.size(x)
    at = lambda k: F.element_at(s, k.cast("int"))
    return (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2


def dc_removed(x: Column) -> Column:
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def prewhitened(x: Column, alpha: float = 0.9) -> Column:
    """y[n] = x[n] - alpha x[n-1], y[0] = x[0]."""
    before = F.concat(F.array(F.lit(0.0)), F.slice(x, F.lit(1), F.size(x) - 1))
    return F.zip_with(x, before, lambda v, b: v - alpha * b)


def peak_normalised(x: Column) -> Column:
    """DC removed, then by the peak; a silent signal becomes zeros."""
    scaled = lambda y: let(peak(y), lambda p: F.transform(y, lambda v: F.when(p > 1e-12, v / p).otherwise(F.lit(0.0))))
    return let(dc_removed(x), scaled)


def scaled_to(x: Column, level: float = 0.98) -> Column:
    held = lambda v, g: F.greatest(F.least(v * g, F.lit(1.0)), F.lit(-1.0))
    return let(level / peak(x), lambda g: F.transform(x, lambda v: F.when(g.isNotNull(), held(v, g)).otherwise(v)))


def shifted(x: Column, by: Column) -> Column:
    """Moved right by ``by`` samples (left if negative), filled with zeros."""
    n = F.size(x)
    k = F.least(F.abs(by), n).cast("int")
    zeros = F.array_repeat(F.lit(0.0), k)
    return F.when(by >= 0, F.concat(zeros, F.slice(x, F.lit(1), n - k))).otherwise(F.concat(F.slice(x, k + 1, n - k), zeros))


def fitted(x: Column, n: int) -> Column:
    """Cut or zero-padded to ``n`` samples."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def windows(x: Column, width: int, step: int) -> Column:
    """Whole windows, no tail; empty if the signal is shorter than one."""
    last = F.size(x) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda k: F.slice(x, k + 1, F.lit(width)))).otherwise(F.array())


def overlapping(x: Column, width: int, overlap: float) -> Column:
    return windows(x, width, int(width * (1 - overlap)))


def frame_energy(x: Column, frame: int, hop: int) -> Column:
    """Mean square of frames that begin before ``n - frame``: the last full frame is left out."""
    last = F.size(x) - frame - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: total(F.transform(F.slice(x, k + 1, F.lit(frame)), lambda v: v * v)) / frame)


def padded_segments(x: Column, width: int) -> Column:
    """Tumbling segments, the last one zero-padded."""
    n = F.ceil(F.size(x) / width).cast("int")
    long_ = F.concat(x, F.array_repeat(F.lit(0.0), width))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(long_, k * width + 1, F.lit(width)))


def first_and_last(x: Column, width: int) -> Column:
    """Two chunks of a long signal; a short one is repeated to one chunk."""
    n = F.size(x)
    tiled = F.slice(F.flatten(F.array_repeat(x, F.ceil(F.lit(width) / n).cast("int"))), 1, width)
    return F.when(n > width, F.array(F.slice(x, 1, width), F.slice(x, n - width + 1, F.lit(width)))).otherwise(F.array(tiled))


# Correlation functions: arrays with the lag of their first element.


def argmax(c: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def _at(c: Column, k: Column) -> Column:
    return F.element_at(c, (k + 1).cast("int"))


def parabolic_offset(c: Column, k: Column) -> Column:
    """Vertex of the parabola through k - 1, k, k + 1, as an offset from k; 0 at an edge or on a line."""
    inside = (k > 0) & (k < F.size(c) - 1)
    a, b, d = _at(c, F.greatest(k - 1, F.lit(0))), _at(c, k), _at(c, F.least(k + 1, F.size(c) - 1))
    bend = 2 * (2 * b - a - d)
    return F.when(inside & (F.abs(bend) >= 1e-10), (d - a) / bend).otherwise(F.lit(0.0))


def gaussian_offset(c: Column, k: Column) -> Column:
    return parabolic_offset(F.transform(c, lambda v: F.log(F.greatest(F.abs(v), F.lit(1e-10)))), k)


def peak_snr_db(c: Column, height: Column) -> Column:
    """Peak power over the mean power of both tails (100 lags or a quarter each)."""
    n = F.size(c)
    t = F.least(F.lit(100), F.floor(n / 4)).cast("int")
    tails = F.concat(F.slice(c, F.lit(1), t), F.slice(c, n - t + 1, t))
    return 10 * F.log10(height * height / (total(F.transform(tails, lambda v: v * v)) / F.size(tails) + 1e-10))


def sharpness(c: Column, k: Column, guard: int) -> Column:
    """Peak over the greatest magnitude more than ``guard`` lags away; infinite if that is 0."""
    other = let(k, lambda k: F.array_max(F.transform(F.filter(c, lambda v, i: F.abs(i - k) > guard), F.abs)))
    return F.when(F.coalesce(other, F.lit(0.0)) > 0, F.abs(_at(c, k)) / other).otherwise(F.lit(float("inf")))


def peak_stability(c: Column, k: Column, side: int = 20) -> Column:
    """0.6 tanh(peak to sidelobe / 3) + 0.4 tanh(10 curvature).

    Sidelobes lie ``side`` to twice ``side`` lags away; at an edge the curvature's share is a half.
    """
    size = F.size(c)
    cut = lambda a, b: F.slice(c, F.greatest(a, F.lit(0)) + 1, F.greatest(b - F.greatest(a, F.lit(0)), F.lit(0)))
    lobe = F.array_max(F.transform(F.concat(cut(k - 2 * side, k - side), cut(k + side, k + 2 * side)), F.abs))
    ratio = F.abs(_at(c, k)) / (F.coalesce(lobe, F.lit(0.0)) + 1e-12)
    bend = F.abs(_at(c, k) - 0.5 * (_at(c, F.greatest(k - 1, F.lit(0))) + _at(c, F.least(k + 1, size - 1))))
    curved = F.when((k > 0) & (k < size - 1), F.tanh(10 * bend)).otherwise(F.lit(0.5))
    return 0.6 * F.tanh(ratio / 3) + 0.4 * curved
