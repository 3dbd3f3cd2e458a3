"""Seeded test signals: the generator of each row is keyed by seed and row, so partitions don't matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from echoline.functions import dsp
from echoline.functions.constants import SAMPLE_RATE

LABELS = ("LEAK", "QUIET", "NORMAL", "MECHANICAL", "RANDOM")

#: Textbook elastic modulus (Pa), density (kg/m3) and Poisson's ratio of pipe walls.
WALLS = {"steel": (2.0e11, 7.8e3, 0.3), "iron": (1.1e11, 7.1e3, 0.26), "pvc": (3.0e9, 1.4e3, 0.4)}


def ring_hz(diameter_m: float, wall: str) -> float:
    """Ring frequency of a thin cylinder: the plate's wave speed over its circumference."""
    modulus, density, poisson = WALLS[wall]
    return float(np.sqrt(modulus / (density * (1 - poisson**2))) / (np.pi * diameter_m))


def coloured(rng: np.random.Generator, n: int, gain: np.ndarray) -> np.ndarray:
    """Noise of unit power whose half spectrum follows ``gain``."""
    spec = rng.normal(size=n // 2 + 1) + 1j * rng.normal(size=n // 2 + 1)
    x = np.fft.irfft(spec * gain, n)
    return x / max(float(x.std()), 1e-12)


def make(rng: np.random.Generator, label: str, n: int, rate: int = SAMPLE_RATE) -> tuple[np.ndarray, dict[str, float]]:
    """A signal of a class, and what it was made from."""
    hz = np.fft.rfftfreq(n, 1 / rate)
    wall = sorted(WALLS)[int(rng.integers(len(WALLS)))]
    diameter, distance = float(rng.choice([0.1, 0.15, 0.2, 0.3])), float(rng.uniform(1, 50))
    ring = min(ring_hz(diameter, wall), 0.4 * rate)
    floor = 10 ** rng.uniform(-2.6, -1.4) * rng.normal(size=n)
    if label == "LEAK":
        #: Turbulence falls off above its corner, the wall rings, and the way to the sensor damps high frequencies.
        corner = rng.uniform(300, 900)
        gain = 1 / (1 + (hz / corner) ** 2) + 0.4 / (1 + ((hz - ring) / (0.05 * ring)) ** 2)
        x = 0.25 * coloured(rng, n, gain * np.exp(-2e-5 * hz * distance) * (hz > 40))
    elif label == "QUIET":
        x = np.zeros(n)
    elif label == "NORMAL":
        x = 0.04 * coloured(rng, n, 1 / np.maximum(hz, 1.0))
    elif label == "MECHANICAL":
        turn = rng.uniform(20, 55)
        phase = 2 * np.pi * np.cumsum(turn * (1 + 0.01 * np.sin(2 * np.pi * 0.7 * np.arange(n) / rate))) / rate
        x = 0.25 * sum(np.sin(k * phase + rng.uniform(0, 6)) / k**1.5 for k in range(1, 7))
    else:
        x = 0.05 * rng.normal(size=n)
        clicks = rng.integers(0, n, rng.poisson(3 + n / rate))
        x[clicks] += rng.normal(0, 0.6, len(clicks))
    return np.clip(x + floor, -1, 1), {"diameter_m": diameter, "position_m": distance, "resonance_hz": ring}


def surrogate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A signal with the same spectrum and random phases."""
    spec = np.fft.rfft(x)
    phase = rng.uniform(0, 2 * np.pi, len(spec))
    phase[0] = 0
    if len(x) % 2 == 0:
        phase[-1] = 0
    return np.fft.irfft(np.abs(spec) * np.exp(1j * (phase + np.angle(spec[0]) * (np.arange(len(spec)) == 0))), len(x))


def labelled_set(ids: DataFrame, seed: int = 42, n: int = 10 * SAMPLE_RATE) -> DataFrame:
    """A signal for each row of ``ids`` (id long, not negative), the labels in turn: row_id, label, resonance_hz, position_m, samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch.id:
                label = LABELS[i % len(LABELS)]
                x, made = make(np.random.default_rng([seed, i]), label, n)
                yield pd.DataFrame({"row_id": [i], "label": [label], "resonance_hz": [made["resonance_hz"]], "position_m": [made["position_m"]], "samples": [x.astype(np.float32)]})

    return ids.select("id").mapInPandas(run, "row_id long, label string, resonance_hz double, position_m double, samples array<float>")


def sensor_pairs(ids: DataFrame, seed: int = 42, n: int = 4096, length: float = 100.0, speed: float = 1400.0, rate: int = SAMPLE_RATE) -> DataFrame:
    """A pair for each row of ``ids`` (id long, not negative): pair_id, length, speed, source_m and both sensors' signals: broad-band noise that reaches B by (length - 2x)/speed later."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edge = int(length / speed * rate) + 1
        for batch in (whole[k : k + 256] for whole in batches for k in range(0, len(whole), 256)):
            made = [np.random.default_rng([seed, i]) for i in batch.id]
            at = [rng.uniform(5, length - 5) for rng in made]
            #: One filter run for a batch of 256.
            sources = dsp.bandpass(np.stack([rng.normal(0, 1, n + 2 * edge) for rng in made]), 150, 1400, rate) if made else []
            rows = []
            for i, x, rng, source in zip(batch.id, at, made, sources, strict=True):
                lag = int(round((length - 2 * x) / speed * rate))
                a, b = source[edge : edge + n], source[edge - lag : edge - lag + n]
                hear = lambda s, rng=rng: (s + rng.normal(0, 0.1 * s.std(), n)).astype(np.float32)
                rows.append((i, length, speed, x, hear(a), hear(b)))
            yield pd.DataFrame(rows, columns=["pair_id", "length", "speed", "source_m", "a", "b"])

    return ids.select("id").mapInPandas(run, "pair_id long, length double, speed double, source_m double, a array<float>, b array<float>")
