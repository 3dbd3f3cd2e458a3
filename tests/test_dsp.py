import numpy as np
import pytest

from echoline.functions import dsp

RATE = 4096.0
rng = np.random.default_rng(42)


def tone(hz, n=8192):
    return np.sin(2 * np.pi * hz * np.arange(n) / RATE)[None]


def gain(f, hz):
    x = tone(hz)
    return float(f(x)[0, 2000:-2000].std() / x[0, 2000:-2000].std())


@pytest.mark.parametrize(("f", "passed", "stopped"), [
    (lambda x: dsp.bandpass(x, 100, 1500, RATE), [300, 800, 1200], [10, 2000]),
    (lambda x: dsp.highpass(x, 50, RATE), [200, 1500], [5]),
    (lambda x: dsp.lowpass(x, 1000, RATE), [50, 500], [1900]),
    (lambda x: dsp.bandstop(x, 400, 800, RATE), [100, 1500], [600]),
    (lambda x: dsp.remove_hum(x, RATE), [800, 1000], [60, 120, 300]),
])
def test_filters_pass_and_stop(f, passed, stopped):
    assert all(abs(gain(f, hz) - 1) < 0.05 for hz in passed) and all(gain(f, hz) < 0.05 for hz in stopped)


def test_butterworth_is_half_power_at_the_edges_and_stable():
    for order in (2, 3, 4):
        for low, high in ((None, 0.3), (0.3, None), (0.1, 0.4)):
            sos = dsp.butterworth(order, low, high)
            for edge in (low, high):
                if edge is not None:
                    z = np.exp(-1j * np.pi * edge)
                    h = np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos])
                    assert abs(abs(h) - np.sqrt(0.5)) < 1e-9
            assert all(np.all(np.abs(np.roots([1, s[4], s[5]])) < 1) for s in sos)


def test_zero_phase():
    x = tone(500)
    y = dsp.bandpass(x, 100, 1500, RATE)
    assert int(dsp.cross_full(y, x)[0].argmax()) == x.shape[1] - 1


def test_constant_stays_without_edges():
    x = np.full((1, 500), 3.0)
    assert np.allclose(dsp.lowpass(x, 500, RATE), 3.0, atol=1e-6)


def test_correlation_signs():
    """A heard ``d`` samples after B peaks at lag d, whatever the method."""
    b = rng.normal(size=(1, 512))
    for d in (-37, 0, 41):
        a = np.roll(b, d, axis=1)
        for f, zero in ((dsp.gcc, 511), (dsp.cross_basic, 511), (dsp.cross_normalised, 511), (dsp.gcc_circular, 256), (dsp.cross_same, 256), (lambda a, b: dsp.gcc_circular(a, b, "scot"), 256)):
            assert int(f(a, b)[0].argmax()) - zero == d, (f, d)


def test_full_correlation_is_numpys():
    a, b = rng.normal(size=(1, 40)), rng.normal(size=(1, 23))
    assert np.allclose(dsp.cross_full(a, b)[0], np.correlate(a[0], b[0], "full"))
    for n in (41, 64):
        a, b = rng.normal(size=(1, n)), rng.normal(size=(1, n))
        assert np.allclose(dsp.cross_same(a, b)[0], np.correlate(a[0], b[0], "same"))


def test_wavelet_transform_keeps_energy_and_kills_cubics():
    x = np.arange(400.0)[None] ** 3 / 1e6
    assert np.abs(dsp.dwt(x)[1][0, 10:-10]).max() < 1e-8
    assert abs((dsp.DB4**2).sum() - 1) < 1e-9 and abs(dsp.DB4.sum() - np.sqrt(2)) < 1e-9
    y = np.zeros((1, 512))
    y[0, 100:400] = rng.normal(size=300)
    low, high = dsp.dwt(y)
    assert abs((low**2).sum() + (high**2).sum() - (y**2).sum()) < 1e-6


def test_lms_learns_a_delay():
    a = rng.normal(size=(2, 4000))
    b = 0.8 * np.roll(a, 3, axis=1)
    _, error = dsp.lms(a, b, 16, 0.01)
    assert error[:, -500:].std() < 0.05 * b.std()


def test_welch_and_coherence():
    x = tone(800) + 0.1 * rng.normal(size=(1, 8192))
    f, p = dsp.welch(x, RATE, 512)
    assert f[p[0].argmax()] == 800 and abs(p[0].sum() * (f[1] - f[0]) - x.var()) < 0.02
    noise = rng.normal(size=(1, 8192))
    f, c = dsp.coherence(x + noise, x + rng.normal(size=(1, 8192)), RATE)
    assert c[0][f == 800] > 0.9 and np.median(c) < 0.3 and c.max() <= 1 + 1e-9
    assert any(lo <= 800 <= hi for lo, hi in dsp.coherence_bands(f, np.where(np.abs(f - 800) < 60, 0.9, 0.1)))


def test_features_of_a_sine():
    s = dsp.spectral_features(tone(800), RATE)
    assert abs(s["dominant_hz"][0] - 800) < 3 and s["band_ratio"][0] > 0.99
    assert dsp.spectral_features(rng.normal(size=(1, 8192)), RATE)["entropy"][0] > s["entropy"][0]


def test_stft_round_trip_and_subtraction():
    x = rng.normal(size=(1, 4096))
    assert np.allclose(dsp.istft(dsp.stft(x), 4096)[0, 600:-600], x[0, 600:-600])
    assert np.allclose(dsp.spectral_subtraction(x, np.zeros((1, 5)))[0, 600:-600], x[0, 600:-600])


def test_envelope_resample_shift():
    assert np.allclose(dsp.envelope(tone(512))[0], 1, atol=1e-6)
    x = tone(256)
    assert np.allclose(dsp.resample(dsp.resample(x, 16384), 8192), x, atol=1e-9)
    assert dsp.shift(np.array([1, 2, 3]), 1).tolist() == [0, 1, 2] and dsp.shift(np.array([1, 2, 3]), -5).tolist() == [0, 0, 0]


def test_peaks():
    r = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 5.0])
    assert dsp.local_maxima(r).tolist() == [1, 4, 7]
    assert dsp.find_peaks(r, 1.5, 2).tolist() == [4, 7] and dsp.find_peaks(r, 0.5, 4).tolist() == [4]
    t = np.arange(100)
    assert abs(dsp.spline_peak(np.exp(-((t - 50.33) ** 2) / 50), 50) - 50.3) < 0.06


def test_stacks():
    x = np.concatenate([rng.normal(5, 0.01, (8, 50)), np.full((2, 50), 100.0)])
    assert np.abs(dsp.huber_stack(x, 0.1, 50) - 5).max() < 0.2 and np.abs(dsp.trimmed_stack(x, 0.2) - 5).max() < 0.02
    assert np.allclose(dsp.trimmed_stack(x, 0.0, np.arange(10.0)), (x * np.arange(10)[:, None]).sum(axis=0) / 45)


def test_alignment_and_clusters():
    a = rng.normal(size=4000)
    assert dsp.alignment_shift(a, dsp.shift(a, 123)) == 123 and dsp.alignment_shift(a, dsp.shift(a, -77)) == -77
    p = np.array([0.0, 10, 20, 500, 505])
    assert dsp.average_linkage(np.abs(p[:, None] - p[None]), 50).tolist() == [0, 0, 0, 1, 1]
    again = dsp.average_linkage(np.abs(p[:, None] - p[None]), 5)
    assert again.tolist() == [0, 1, 2, 3, 3]


def test_trilateration_and_joint_search():
    anchors = rng.uniform(-100, 100, (5, 2))
    assert np.allclose(dsp.trilaterate(anchors, np.linalg.norm(anchors - [30, -20], axis=1)), [30, -20], atol=1e-5)
    lag = -int((100 - 2 * 35) / 1400 * RATE)
    r = np.exp(-((np.arange(-600, 601) - lag) ** 2) / 8.0)
    x, c, score, conf = dsp.joint_search(r, -600, 100, RATE)
    assert lag == -87 and int((100 - 2 * x) / c * RATE) == 87 and score == 1 and conf > 0.99
