"""Queries of the array kernels: filters, adaptive and wavelet methods, spectra, mel frames, and end-to-end estimates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.functions import arrays as A
from echoline.functions import dsp
from echoline.functions import physics as P
from echoline.operators import estimators
from echoline.operators.kernels import array_kernel, struct_kernel
from echoline.plans import kernel_sql as Q
from echoline.plans.registry import query
from echoline.plans.signals import E, long, pairs, signals
from echoline.sources import synthetic

r = P.rounded
RATE = 4096.0


def _kernel(name: str, f, doc: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long(signals(spark, sf_dir), ["vec_id"], array_kernel(f, F.col("x")))

    run.__doc__ = doc
    query(sql, name)(run)


def _pair_kernel(name: str, f, doc: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long(pairs(spark, sf_dir), ["pair_id"], array_kernel(f, F.col("a"), F.col("b")))

    run.__doc__ = doc
    query(sql, name)(run)


_kernel("bandpass_butter", lambda x: dsp.bandpass(x, 100, 1500, RATE), "Zero-phase Butterworth band-pass of order 4.", Q.filtered([Q.sections(100, 1500)]))
_kernel("highpass_butter", lambda x: dsp.highpass(x, 50, RATE), "Zero-phase high-pass at 50 Hz.", Q.filtered([Q.sections(50, None)]))
_kernel("lowpass_butter", lambda x: dsp.lowpass(x, 1000, RATE), "Zero-phase low-pass at 1 kHz.", Q.filtered([Q.sections(None, 1000)]))
_kernel("bandstop_butter", lambda x: dsp.bandstop(x, 400, 800, RATE), "Zero-phase band-stop.", Q.filtered([Q.sections(400, 800, True)]))
_kernel("notch_hum", lambda x: dsp.remove_hum(x, RATE), "Mains hum and harmonics out.", Q.filtered(Q.notches(60.0, 30.0)))
_kernel("comb_filter", lambda x: dsp.comb(x, RATE, 200.0), "Notches of one width at harmonics.", Q.filtered(Q.notches(200.0, None)))
_kernel("default_filters", lambda x: dsp.default_pipeline(x, RATE), "DC, hum, high-pass, low-pass.", Q.filtered([*Q.notches(60.0, 30.0), Q.sections(50, None), Q.sections(None, 2000)], Q.CENTRED))
_kernel("prepare_signal", lambda x: dsp.prepare(x, RATE), "Preparation for correlation.", Q.prepared())
_kernel("spectral_subtract", lambda x: dsp.spectral_subtraction(x, dsp.welch(x[:, :16], RATE, 16)[1], width=32, hop=8), "Spectral subtraction with the noise of the first quarter.", Q.SUBTRACTED)
_kernel("wavelet_packets", dsp.wavelet_packet_energies, "Energies of the 16 packets of level 4.", Q.PACKETS)
_kernel("cwt_energy", dsp.cwt_energies, "Energies at 32 scales.", Q.MORLET)
_kernel("mel_segments", lambda x: dsp.log_mel(x, RATE, 16, 32, 16).reshape(len(x), -1), "Log-mel frames of 32 samples.", Q.MEL)
_kernel("mfcc_frames", lambda x: dsp.mfcc(x, RATE, 8, mels=16, n_fft=32, hop=16).reshape(len(x), -1), "Cepstra of the log-mel frames.", Q.MFCC)
_pair_kernel("lms_cancel", lambda a, b: dsp.lms(a, b, 16)[1], "LMS noise canceller: what B has beyond A.", Q.LMS)
_pair_kernel("xcorr_adaptive", lambda a, b: dsp.cross_adaptive(a, b, 16), "Correlation after an adaptive filter.", Q.ADAPTIVE)
_pair_kernel("wavelet_corr", lambda a, b: dsp.cross_wavelet(a, b, 3), "Correlation by wavelet levels.", Q.WAVELET)
_pair_kernel("coherence_weighted_corr", lambda a, b: dsp.coherence_weighted(a, b, RATE), "PHAT weighted by coherent bands.")

_kernel(
    "median_filter", lambda x: dsp.median_filter(x, 3), "Running median of three samples.",
    f"WITH {E}, w AS (SELECT vec_id, i, v, coalesce(lag(v) OVER o, v) AS b, coalesce(lead(v) OVER o, v) AS a FROM e WINDOW o AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, i::INTEGER AS i, round(median, 6) + 0 AS v FROM (SELECT vec_id, i, list_sort([b, v, a])[2] AS median FROM w)",
)
_kernel(
    "wiener_filter", dsp.wiener, "Local Wiener filter over three samples.",
    f"""WITH {E}, n AS (SELECT vec_id, var_pop(v) AS noise FROM e WHERE i < 6 GROUP BY vec_id),
    w AS (SELECT vec_id, i, v, coalesce(lag(v) OVER o, 0) AS b, coalesce(lead(v) OVER o, 0) AS a FROM e WINDOW o AS (PARTITION BY vec_id ORDER BY i)),
    m AS (SELECT *, (a + b + v) / 3 AS m, (pow(a - (a + b + v) / 3, 2) + pow(b - (a + b + v) / 3, 2) + pow(v - (a + b + v) / 3, 2)) / 3 AS s FROM w)
    SELECT vec_id, i::INTEGER AS i, round(CASE WHEN s < noise THEN m ELSE m + (v - m) * (1 - noise / s) END, 6) + 0 AS v FROM m JOIN n USING (vec_id)""",
)
_kernel(
    "autocorrelation", dsp.autocorrelation, "Autocorrelation over its value at lag 0.",
    f"WITH {E}, c AS (SELECT a.vec_id, a.i - b.i AS i, sum(a.v * b.v) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i >= b.i GROUP BY ALL) SELECT vec_id, i::INTEGER AS i, round(r / max(CASE WHEN i = 0 THEN r END) OVER (PARTITION BY vec_id), 6) + 0 AS v FROM c",
)
_DFT = f"{E}, f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, -sum(v * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM e, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k)"
_kernel("fft_magnitude", lambda x: np.abs(np.fft.rfft(x, axis=1)), "Magnitudes of the half spectrum.", f"WITH {_DFT} SELECT vec_id, k::INTEGER AS i, round(sqrt(re * re + im * im), 6) AS v FROM f")
_kernel(
    "hilbert_envelope", dsp.envelope, "Envelope by the analytic signal.",
    f"""WITH {_DFT}, t AS (SELECT unnest(range(64)) AS n), h AS (SELECT vec_id, n, sum(CASE WHEN k IN (0, 32) THEN 0 ELSE 2 END * (re * sin(2 * pi() * ((k * n) % 64) / 64) + im * cos(2 * pi() * ((k * n) % 64) / 64))) / 64 AS q FROM f, t GROUP BY vec_id, n)
    SELECT h.vec_id, n::INTEGER AS i, round(sqrt(v * v + q * q), 6) AS v FROM h JOIN e ON e.vec_id = h.vec_id AND e.i = n""",
)
_kernel(
    "resample_fft", lambda x: dsp.resample(x, 32), "Half the rate in the frequency domain.",
    f"""WITH {_DFT}, t AS (SELECT unnest(range(32)) AS n)
    SELECT vec_id, n::INTEGER AS i, round(sum(CASE WHEN k = 0 THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((k * n) % 32) / 32) - im * sin(2 * pi() * ((k * n) % 32) / 32))) / 64, 6) + 0 AS v FROM f, t WHERE k <= 16 GROUP BY vec_id, n""",
)

_SEG = f"""{E}, g AS (SELECT unnest(range(0, 49, 8)) AS s), d AS (SELECT vec_id, s, i - s AS j, v - avg(v) OVER (PARTITION BY vec_id, s) AS v FROM e JOIN g ON i >= s AND i < s + 16),
f AS (SELECT vec_id, s, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * cos(2 * pi() * ((k * j) % 16) / 16)) AS re, -sum(v * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * sin(2 * pi() * ((k * j) % 16) / 16)) AS im FROM d, (SELECT unnest(range(9)) AS k) GROUP BY vec_id, s, k)"""
_kernel(
    "welch_psd", lambda x: dsp.welch(x, 16.0, 16)[1], "Welch density over seven half-overlapping segments.",
    f"WITH {_SEG} SELECT vec_id, k::INTEGER AS i, round(avg(re * re + im * im) / (16 * 6.0) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END, 6) AS v FROM f GROUP BY vec_id, k",
)
_pair_kernel(
    "coherence_msc", lambda a, b: dsp.coherence(a, b, 16.0, 16, 8)[1], "Magnitude-squared coherence.",
    f"""WITH {_SEG} SELECT a.vec_id // 2 AS pair_id, a.k::INTEGER AS i, round((pow(avg(a.re * b.re + a.im * b.im), 2) + pow(avg(a.re * b.im - a.im * b.re), 2)) / (avg(a.re * a.re + a.im * a.im) * avg(b.re * b.re + b.im * b.im)), 6) AS v
    FROM f a JOIN f b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 AND a.s = b.s AND a.k = b.k GROUP BY a.vec_id, a.k""",
)


@query(Q.SNR)
def spectral_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean power over that of the quietest tenth of the spectrum."""
    snr = struct_kernel(lambda x: {"snr": dsp.signal_snr_db(x)}, "snr: double", F.col("x"))
    return signals(spark, sf_dir).select("vec_id", r(snr["snr"], 4).alias("snr_db"), r(A.peak(F.col("x"))).alias("peak"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic sensor pair for each supplier. The table is one small file, whose rows are dealt out to all cores, 256 a task at most."""
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-ids.count() // 256))
    return synthetic.sensor_pairs(ids.repartition(tasks))


@query()
def correlate_pair_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single sources of a synthetic pair for each supplier: estimate beside truth."""
    p = estimators.locate(_sites(spark, sf_dir))
    return p.select("pair_id", r(F.col("source_m"), 2).alias("truth_m"), r(F.col("from_a"), 2).alias("from_a"), r(F.col("conf"), 3).alias("confidence"), "message")


@query()
def multi_leak_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of a synthetic pair for each supplier, ranked."""
    p = estimators.detect_many(_sites(spark, sf_dir))
    return p.select("pair_id", "place", "band", r(F.col("at"), 2).alias("from_a"), r(F.col("conf"), 3).alias("confidence"))


@query()
def v3_report_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused estimate of a synthetic pair for each supplier with its quality figures."""
    p = estimators.report(_sites(spark, sf_dir))
    return p.select("pair_id", r(F.col("source_m"), 2).alias("truth_m"), *[r(F.col(c), 3).alias(c) for c in ("from_a", "alignment", "coherence", "stability")])


@query(Q.STACKED)
def stacked_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of each label stacked: how many were good enough, and the gain."""
    s = pairs(spark, sf_dir).select(F.col("label").cast("long").alias("pair_id"), F.col("pair_id").alias("recording_id"), "a", "b")
    out = estimators.stack_pairs(s, 16.0)
    return out.select("pair_id", "used", "rejected", r(F.col("gain_db"), 4).alias("gain_db"), F.size("a").alias("n"))


@query()
def synthetic_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled synthetic signal for each supplier, described."""
    s = synthetic.labelled_set(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id")), n=4096)
    return s.select("row_id", "label", r(F.col("resonance_hz"), 3).alias("resonance_hz"), F.size("samples").alias("n"), r(A.rms(F.col("samples").cast("array<double>")), 5).alias("rms"))
