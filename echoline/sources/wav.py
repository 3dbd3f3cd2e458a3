"""Recordings as tables: WAV and headerless PCM in, WAV out. Errors are data: a row that can't be
decoded keeps its path and says why."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.functions import constants as K
from echoline.functions import text as X

SCHEMA = "path string, sample_rate int, n_channels int, bits int, n_frames long, samples array<float>, error string"


def pcm(data: bytes, bits: int) -> np.ndarray:
    """Samples in [-1, 1] of unsigned 8-bit or signed 16-, 24- and 32-bit little-endian PCM."""
    if bits == 8:
        return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3)
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 1:] = raw
        return wide.view("<i4").reshape(-1) / 2.0**31
    if bits in (16, 32):
        return np.frombuffer(data, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    raise ValueError(f"{bits} bits a sample")


def decode(data: bytes, channels: str = "first", rate: int | None = None, seconds: float | None = None, slack: float = 0.1) -> dict[str, object]:
    """One file: ``channels`` is ``first`` or ``mean``; a wrong rate or duration is an error."""
    out: dict[str, object] = {n: None for n in ("sample_rate", "n_channels", "bits", "n_frames", "samples", "error")}
    try:
        with wave.open(io.BytesIO(data)) as f:
            out |= {"sample_rate": f.getframerate(), "n_channels": f.getnchannels(), "bits": 8 * f.getsampwidth(), "n_frames": f.getnframes()}
            x = pcm(f.readframes(f.getnframes()), int(out["bits"])).reshape(-1, f.getnchannels())
        if rate is not None and out["sample_rate"] != rate:
            raise ValueError(f"sample rate {out['sample_rate']}, wanted {rate}")
        if seconds is not None and abs(len(x) / out["sample_rate"] - seconds) > slack:
            raise ValueError(f"duration {len(x) / out['sample_rate']:.2f} s, wanted {seconds} s")
        out["samples"] = (x.mean(axis=1) if channels == "mean" else x[:, 0]).astype(np.float32)
    except (wave.Error, EOFError, ValueError, struct.error) as e:
        out["error"] = str(e) or type(e).__name__
    return out


def encode(samples: np.ndarray, rate: int = K.SAMPLE_RATE, bits: int = 16) -> bytes:
    """A WAV file of 8 (unsigned), 16, 24 or 32 bits, clipped to [-1, 1]; a row a frame where there are several channels."""
    x, top = np.asarray(samples, float), 2.0 ** (bits - 1)
    data = np.clip(np.round(x * top), -top, top - 1).astype("<i4")
    if bits == 8:
        data = (data + 128).astype(np.uint8)
    elif bits == 24:
        data = np.ascontiguousarray(data).view(np.uint8).reshape(-1, 4)[:, :3]
    elif bits == 16:
        data = data.astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1 if x.ndim == 1 else x.shape[1])
        f.setsampwidth(bits // 8)
        f.setframerate(rate)
        f.writeframes(data.tobytes())
    return out.getvalue()


def files(spark: SparkSession, path: str, pattern: str = "*.[wW][aA][vV]") -> DataFrame:
    """path, length, modification time; contents are read only where a plan asks for them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def listing(spark: SparkSession, path: str, sensor_id: str | None = None, least: int = 0, most: int = 2**62) -> DataFrame:
    """Recordings by name with typed parts; names that don't fit are left out only where a sensor is asked for."""
    named = files(spark, path).filter(F.col("length").between(least, most)).select("path", "length", X.parse_filename(F.element_at(F.split("path", "/"), -1)).alias("n"))
    out = named.select("path", "length", "n.sensor_id", "n.recording_id", X.parse_time(F.col("n.timestamp")).alias("ts"), F.col("n.gain_db").try_cast("double").alias("gain"))
    return out if sensor_id is None else out.filter(F.col("sensor_id") == sensor_id)


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """path and label, the name of the folder that holds the file; files in the root itself have none and are left out."""
    root = path.rstrip("/").rsplit("/", 1)[-1]
    return files(spark, path).select("path", F.element_at(F.split("path", "/"), -2).alias("label")).filter(F.col("label") != root)


def decoded(source: DataFrame, kept: Sequence[str] = (), **options: object) -> DataFrame:
    """``source``: path, content and the columns ``kept``. A row for every file, in ``SCHEMA`` and with those columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p} | decode(c, **options) for p, c in zip(batch.path, batch.content, strict=True)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for name in ("sample_rate", "n_channels", "bits", "n_frames"):
                frame[name] = frame[name].astype("Int64")
            for name in kept:
                frame[name] = batch[name].to_numpy()
            yield frame

    slim = source.select("path", "content", *kept)
    return slim.mapInPandas(run, ", ".join([SCHEMA, *(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[2:])]))


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """All WAV files under a folder."""
    return decoded(files(spark, path), **options)


def decoded_raw(source: DataFrame, rate: int = 8000) -> DataFrame:
    """``source``: path, content of headerless 32-bit mono files. path, samples, seconds."""

    @F.pandas_udf("array<float>")
    def samples(content: pd.Series) -> pd.Series:
        return content.map(lambda c: pcm(c[: len(c) // 4 * 4], 32).astype(np.float32))

    out = source.select("path", samples("content").alias("samples"))
    return out.withColumn("seconds", F.size("samples") / F.lit(float(rate)))


def read_raw(spark: SparkSession, path: str, pattern: str = "*.raw", rate: int = 8000) -> DataFrame:
    return decoded_raw(files(spark, path, pattern), rate)


def encoded(samples: Column, rate: int | Column = K.SAMPLE_RATE, bits: int | Column = 16) -> Column:
    """WAV files as binary."""

    @F.pandas_udf("binary")
    def run(x: pd.Series, rate: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else encode(v, int(r), int(b)) for v, r, b in zip(x, rate, bits, strict=True)])

    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return run(samples, lit(rate), lit(bits))


def encoded_pair(a: Column, b: Column, rate: int = K.SAMPLE_RATE, bits: int = 16) -> Column:
    """Two-channel WAV files as binary."""

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else encode(np.stack([x, y], axis=1), rate, bits) for x, y in zip(a, b, strict=True)])

    return run(a, b)


def encoded_raw(samples: Column) -> Column:
    """Headerless 32-bit files as binary."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.clip(np.round(np.asarray(v, float) * 2.0**31), -(2.0**31), 2.0**31 - 1).astype("<i4").tobytes())

    return run(samples)


def integrity(content: Column, light: bool = False) -> Column:
    """Struct (ok, message): header, rate, width and frames, then (unless ``light``) silence, long and trailing runs of zeros."""

    def judge(data: bytes) -> tuple[bool, str]:
        if len(data) < 44:
            return False, "too_small_for_header"
        out = decode(data)
        if out["error"] is not None:
            return False, f"wave_error:{out['error']}"
        if out["sample_rate"] != K.SAMPLE_RATE:
            return False, f"sample_rate_mismatch({out['sample_rate']})"
        if out["bits"] != 16:
            return False, f"sample_width_{out['bits'] // 8}"
        if out["n_channels"] != 1:
            return True, f"non_mono({out['n_channels']})"
        if abs(out["n_frames"] - K.SAMPLE_RATE * K.DURATION_S) > 1:
            return True, f"frames={out['n_frames']}"
        if light:
            return True, "ok"
        zero = out["samples"] == 0
        if zero.all():
            return False, "all_zero"
        edges = np.flatnonzero(np.diff(np.concatenate([[0], zero.view(np.int8), [0]]))).reshape(-1, 2)
        longest = int((edges[:, 1] - edges[:, 0]).max(initial=0))
        trailing = int(edges[-1, 1] - edges[-1, 0]) if len(edges) and edges[-1, 1] == len(zero) else 0
        warnings = ((zero.mean() >= 0.95, f"high_zero_ratio={zero.mean():.3f}"), (longest >= 2048, f"long_zero_run={longest}"), (trailing >= 512, f"trailing_zero_run={trailing}"))
        found = [text for holds, text in warnings if holds]
        return True, ";".join(found) or "ok"

    @F.pandas_udf("ok boolean, message string")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(c) for c in content], columns=["ok", "message"])

    return run(content)
