"""The kernels under SQL names: ``SELECT acoustic_gcc_phat(a, b) FROM pairs``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from echoline.functions import dsp
from echoline.functions.constants import SAMPLE_RATE
from echoline.operators.kernels import by_length

_ONE = {
    "dc_removed": lambda x: x - x.mean(axis=1, keepdims=True),
    "bandpass": lambda x: dsp.bandpass(x, 100, 1500, SAMPLE_RATE),
    "prepare": lambda x: dsp.prepare(x, SAMPLE_RATE),
    "remove_hum": lambda x: dsp.remove_hum(x, SAMPLE_RATE),
    "envelope": dsp.envelope,
    "autocorrelation": dsp.autocorrelation,
    "welch": lambda x: dsp.welch(x, SAMPLE_RATE)[1],
    "log_mel": lambda x: dsp.log_mel(x, SAMPLE_RATE).reshape(len(x), -1),
    "median": dsp.median_filter,
    "wiener": dsp.wiener,
}
_TWO = {
    "xcorr": dsp.cross_basic,
    "gcc_phat": dsp.gcc,
    "gcc_roth": lambda a, b: dsp.gcc_circular(a, b, "roth"),
    "gcc_scot": lambda a, b: dsp.gcc_circular(a, b, "scot"),
    "coherence": lambda a, b: dsp.coherence(a, b, SAMPLE_RATE)[1],
    "xcorr_wavelet": dsp.cross_wavelet,
}


def _batch(f, *columns: pd.Series) -> pd.Series:
    """``f`` on all signals of a length at once; null for null and empty signals."""
    out: list[np.ndarray | None] = [None] * len(columns[0])
    for rows, signals in by_length(*columns):
        for i, y in zip(rows, f(*signals), strict=True):
            out[i] = y
    return pd.Series(out)


def register(spark: SparkSession, prefix: str = "acoustic_") -> list[str]:
    """Registers all functions; returns their names."""

    def one(f):
        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return _batch(f, x)

        return run

    def two(f):
        @F.pandas_udf("array<double>")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return _batch(f, a, b)

        return run

    names = []
    for table, make in ((_ONE, one), (_TWO, two)):
        for name, f in table.items():
            spark.udf.register(prefix + name, make(f))
            names.append(prefix + name)
    return names
