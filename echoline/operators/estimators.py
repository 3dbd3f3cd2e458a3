"""Composite estimators over tables of signal pairs and recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.functions import arrays as A
from echoline.functions import constants as K
from echoline.functions import dsp
from echoline.functions import physics as P
from echoline.operators import relational as R
from echoline.operators.kernels import array_kernel, by_length, struct_kernel

_PEAKS = "array<struct<lag:double,height:double,snr:double,sharpness:double,band:string>>"


def locate(pairs: DataFrame, rate: float = K.SAMPLE_RATE) -> DataFrame:
    """Single source of each pair (pair_id, length, speed, a, b): delay, position, confidence, what speaks against it."""
    prepared = lambda a, b: dsp.gcc(dsp.prepare(a, rate), dsp.prepare(b, rate), "phat", min(a.shape[1] - 1, int(K.MAX_DELAY_S * rate)))
    c = pairs.select("*", array_kernel(prepared, F.col("a"), F.col("b")).alias("c")).drop("a", "b").withColumn("k", A.argmax(F.col("c")))
    corr, k = F.col("c"), F.col("k")
    lag = k - F.floor(F.size(corr) / 2) + A.parabolic_offset(corr, k)
    c = c.withColumns({"height": F.array_max(corr), "snr": A.peak_snr_db(corr, F.array_max(corr)), "sharpness": A.sharpness(corr, k, int(0.01 * rate)), "delay": -lag / rate})
    conf = P.confidence(F.col("height"), F.col("snr"), F.col("sharpness"))
    at = P.position(F.col("length"), F.col("speed"), F.col("delay"))
    message = P.estimate_message(F.col("delay"), conf, F.col("snr"), F.col("sharpness"))
    return c.withColumns({"conf": conf, "from_a": at, "from_b": F.col("length") - at, "message": message}).drop("c", "k")


def _peaks(r: np.ndarray, band: str, gap: int, per_band: int, height: float) -> list[dict[str, object]]:
    """The highest peaks of one correlation, with what an estimate needs."""
    at = dsp.find_peaks(r, height * np.abs(r).max(), gap)
    tail = min(100, len(r) // 4)
    noise = (np.concatenate([r[:tail], r[-tail:]]) ** 2).mean() + 1e-10
    out = []
    for k in at[np.argsort(-r[at], kind="stable")[:per_band]]:
        other = np.abs(np.concatenate([r[: max(0, k - gap)], r[k + gap + 1 :]])).max(initial=0.0)
        bend = 2 * (2 * r[k] - r[k - 1] - r[k + 1])
        shift = (r[k + 1] - r[k - 1]) / bend if abs(bend) > 1e-10 else 0.0
        out.append({"lag": float(k + shift - len(r) // 2), "height": float(r[k]), "snr": float(10 * np.log10(r[k] ** 2 / noise)), "sharpness": float(abs(r[k]) / other) if other > 0 else float("inf"), "band": band})
    return out


def _detect(a: np.ndarray, b: np.ndarray, rate: float, per_band: int, height: float) -> list[list[dict[str, object]]]:
    """Peaks of all bands for a batch of pairs; filters run over all rows at once."""
    out: list[list[dict[str, object]]] = [[] for _ in a]
    most, gap = min(a.shape[1] - 1, int(K.MAX_DELAY_S * rate)), max(1, int(0.01 * rate))
    for band, (low, high) in K.BANDS.items():
        r = dsp.gcc(dsp.bandpass(a, low, high, rate), dsp.bandpass(b, low, high, rate), "phat", most, True)
        for found, row in zip(out, r, strict=True):
            found += _peaks(row, band, gap, per_band, height)
    return out


def detect_many(pairs: DataFrame, rate: float = K.SAMPLE_RATE, per_band: int = 10, keep: int = 10, height: float = K.MIN_PEAK_HEIGHT) -> DataFrame:
    """Several sources a pair: peaks of four bands, those off the pipe dropped, clustered at 5 m, the best of each cluster, the best ``keep``."""

    @F.pandas_udf(_PEAKS)
    def peaks(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list[object] = [None] * len(a)
        for rows, (x, y) in by_length(a, b):
            for i, found in zip(rows, _detect(x, y, rate, per_band, height), strict=True):
                out[i] = found
        return pd.Series(out)

    p = pairs.select("pair_id", "length", "speed", F.explode(peaks("a", "b")).alias("p")).select("pair_id", "length", "speed", "p.*")
    delay = -F.col("lag") / rate
    p = p.withColumn("at", P.raw_position(F.col("length"), F.col("speed"), delay)).filter(F.col("at").between(-K.TOLERANCE_M, F.col("length") + K.TOLERANCE_M))
    p = p.withColumn("conf", P.confidence(F.col("height"), F.col("snr"), F.col("sharpness")))
    c = R.gap_clusters(p, ["pair_id"], "at", K.TOLERANCE_M, "band")
    best = R.first_by(c, ["pair_id", "cluster_id"], F.desc("conf"), F.col("at"), F.col("band"))
    return R.first_by(best, ["pair_id"], F.desc("conf"), F.col("at"), n=keep, rank="place")


def stack_pairs(recordings: DataFrame, rate: float = K.SAMPLE_RATE, least_quality: float = 0.3, align: bool = True, weighted: bool = False) -> DataFrame:
    """Recordings (pair_id, recording_id, a, b) of a pair aligned to the first and averaged.

    Recordings of poor quality are left out and counted; null signals if none is left. A pair's
    recordings are gathered in one task: a survey makes tens of them.
    """
    quality = struct_kernel(lambda a, b: {"qa": dsp.signal_snr_db(a), "qb": dsp.signal_snr_db(b)}, "qa: double, qb: double", F.col("a"), F.col("b"))
    q = recordings.withColumn("q", quality).withColumn("snr", (F.col("q.qa") + F.col("q.qb")) / 2).drop("q")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        good = pdf[np.clip(pdf.snr / 30, 0, 1) >= least_quality].sort_values("recording_id")
        row = {"pair_id": pdf.pair_id.iloc[0], "used": len(good), "rejected": len(pdf) - len(good), "gain_db": float(10 * np.log10(len(good))) if len(good) else 0.0, "a": None, "b": None}
        if len(good):
            a, b = np.stack(good.a.to_list()).astype(float), np.stack(good.b.to_list()).astype(float)
            for i in range(1, len(a) if align else 0):
                by = dsp.alignment_shift(a[0][: 2 * int(rate)], a[i][: 2 * int(rate)])
                a[i], b[i] = dsp.shift(a[i], -by), dsp.shift(b[i], -by)
            w = 10 ** (good.snr.to_numpy() / 10) if weighted else np.ones(len(a))
            row |= {"a": (a * w[:, None]).sum(axis=0) / w.sum(), "b": (b * w[:, None]).sum(axis=0) / w.sum()}
        return pd.DataFrame([row])

    return q.groupBy("pair_id").applyInPandas(run, "pair_id long, used int, rejected int, gain_db double, a array<double>, b array<double>")


def report(pairs: DataFrame, rate: float = K.SAMPLE_RATE) -> DataFrame:
    """Joint position and speed from fused correlations of several methods, with coherence, stability and what the methods agree on."""

    def kernel(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        n = a.shape[1]
        kinds = [dsp.gcc_circular(a, b, w) for w in ("phat", "scot")] + [dsp.coherence_weighted(a, b, rate)]
        kinds = [c / (np.abs(c).max(axis=1, keepdims=True) + 1e-10) for c in kinds]
        fused = np.mean(kinds, axis=0)
        peaks = np.stack([np.abs(c).argmax(axis=1) for c in kinds], axis=1) - n // 2
        coherent = dsp.coherence(a, b, rate)[1].mean(axis=1)
        return {"c": fused, "alignment": np.exp(-peaks.var(axis=1) / 25), "coherence": coherent}

    f = pairs.select("pair_id", "length", "speed", *(["source_m"] if "source_m" in pairs.columns else []), struct_kernel(kernel, "c: array<double>, alignment: double, coherence: double", F.col("a"), F.col("b")).alias("f"))
    f = f.select("*", "f.*").drop("f").withColumn("k", A.argmax(F.col("c")))
    lag = F.col("k") - F.floor(F.size("c") / 2) + A.parabolic_offset(F.col("c"), F.col("k"))
    f = f.withColumns({"delay": -lag / rate, "stability": A.peak_stability(F.col("c"), F.col("k"))})
    return f.withColumn("from_a", P.position(F.col("length"), F.col("speed"), F.col("delay"))).drop("c", "k")


def classify(recordings: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.35, frac: float = 0.25, rate: float = K.SAMPLE_RATE) -> DataFrame:
    """path, samples (and error) to per-long probabilities and a decision.

    The model is linear over the mean log-mel frame of each short segment.
    """

    def run(x: np.ndarray) -> np.ndarray:
        n = int(K.DURATION_S * rate)
        x = np.pad(x, ((0, 0), (0, max(0, n - x.shape[1]))))[:, :n]
        short = x[:, : n // K.LONG_WINDOW * K.LONG_WINDOW].reshape(len(x), -1, K.SHORT_WINDOW)
        mel = dsp.log_mel(short.reshape(-1, K.SHORT_WINDOW), rate)[:, 0]
        p = 1 / (1 + np.exp(-np.clip(mel @ weights + bias, -50, 50)))
        return p.reshape(len(x), -1, K.LONG_WINDOW // K.SHORT_WINDOW).mean(axis=2)

    p = F.col("longs")
    hits = F.size(F.filter(p, lambda v: v >= threshold)) / F.size(p)
    out = recordings.select("path", "error", array_kernel(run, F.col("samples")).alias("longs"))
    return out.withColumns({"mean_p": A.mean(p), "frac": hits, "leak": (hits >= frac) & (hits > 0)})
