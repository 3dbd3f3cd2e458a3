"""Labelled folders to segment datasets, standardised recordings, and verified landing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoline.functions import arrays as A
from echoline.functions import constants as K
from echoline.functions import dsp
from echoline.functions import text as X
from echoline.operators.kernels import array_kernel
from echoline.sources import wav

RATIOS = (0.7, 0.2, 0.1)


def check_ratios(ratios: tuple[float, ...]) -> None:
    if min(ratios) < 0 or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must not be negative and must sum to 1")


def segments(recordings: DataFrame, rate: float = K.SAMPLE_RATE) -> DataFrame:
    """path, label (and label_id, split), samples to a row for each short segment: long_idx, short_idx, waveform, mel (64 numbers).

    Recordings are cut or padded to ten seconds: 80 rows each.
    """
    fitted = A.fitted(F.col("samples").cast("array<double>"), int(K.DURATION_S * rate))
    kept = [c for c in recordings.columns if c in ("path", "label", "label_id", "split")]
    s = recordings.select(*kept, F.posexplode(A.windows(fitted, K.LONG_WINDOW, K.LONG_WINDOW)).alias("long_idx", "w"))
    s = s.select(*kept, "long_idx", F.posexplode(A.windows(F.col("w"), K.SHORT_WINDOW, K.SHORT_WINDOW)).alias("short_idx", "w"))
    mel = array_kernel(lambda x: dsp.log_mel(x, rate)[:, 0], F.col("w")).cast("array<float>")
    return s.select(*kept, "long_idx", "short_idx", F.col("w").cast("array<float>").alias("waveform"), mel.alias("mel"))


def label_ids(df: DataFrame) -> DataFrame:
    """label, label_id over all splits: distinct labels in order, from 0."""
    labels = df.select("label").distinct()
    return labels.withColumn("label_id", F.row_number().over(Window.orderBy("label")) - 1)


def build(spark: SparkSession, folders: dict[str, str], out: str) -> DataFrame:
    """Segments of every split to Parquet, partitioned by split; labels are numbered over all of them. Returns the rejects.

    Labels come from the listing alone; files are decoded once, into segments and a table of rejects beside ``out``.
    """
    listed = []
    for split, folder in folders.items():
        found = wav.files(spark, folder).withColumn("label", F.element_at(F.split("path", "/"), -2)).withColumn("split", F.lit(split))
        listed.append(found.filter(F.col("label") != folder.rstrip("/").rsplit("/", 1)[-1]))
    whole = reduce(DataFrame.unionByName, listed)
    ids = label_ids(whole.select("label"))
    read = wav.decoded(whole, channels="mean", kept=("label", "split")).join(F.broadcast(ids), "label")
    good = segments(read.filter("error IS NULL"))
    bad = read.filter("error IS NOT NULL").select("split", "path", "error")
    #: One pass over the files: a rejected file is a row without a segment.
    both = good.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
    both.write.mode("overwrite").partitionBy("split").parquet(out)
    return spark.read.parquet(out).filter("error IS NOT NULL").select("split", "path", "error")


def standardised(labelled: DataFrame, rate: int = K.SAMPLE_RATE, seconds: int = K.DURATION_S) -> DataFrame:
    """Recordings (path, sample_rate, samples and label columns) at one rate and length, with their standard names.

    Long ones give their first and last stretch, short ones are repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b["samples"] = [x if r == rate else dsp.resample(np.asarray(x, float)[None], max(1, int(len(x) * rate / r)))[0].astype(np.float32) for x, r in zip(b.samples, b.sample_rate, strict=True)]
            yield b

    even = labelled.filter(F.size("samples") > 0).mapInPandas(run, labelled.schema)
    width = rate * seconds
    short = F.size("samples") < width
    chunks = A.first_and_last(F.col("samples").cast("array<double>"), width)
    out = even.withColumn("short", short).select("*", F.posexplode(chunks).alias("part", "chunk"), (F.size("samples") > width).alias("many"))
    name = X.standard_name(F.col("leak_found"), F.col("siteid"), F.col("recording_id"), F.col("datetime"), F.col("noise"), F.col("spread"), F.col("repaired_as"), F.when(F.col("many"), F.col("part") + 1), F.col("short"))
    return out.select("path", name.alias("name"), F.col("chunk").cast("array<float>").alias("samples"))


def normalised(recordings: DataFrame, level: float = 0.98) -> DataFrame:
    """path, samples to status, peaks, scale: silence and loud recordings are left as they are."""
    x = F.col("samples").cast("array<double>")
    p = A.peak(x)
    status = F.when(p <= 1e-6, F.lit("skip_zero")).when(p >= 0.9, F.lit("skip_already")).otherwise(F.lit("normalise"))
    out = recordings.filter(~F.col("path").rlike("/_quarantine")).select("path", status.alias("status"), p.alias("peak_before"), x.alias("x"))
    loud = F.col("status") == "normalise"
    return out.select("path", "status", "peak_before", F.when(loud, level / F.col("peak_before")).alias("scale"), F.when(loud, A.scaled_to(F.col("x"), level)).otherwise(F.col("x")).alias("samples"))


def copy_verified(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """path, content, target to a manifest with the content: what exists under ``target`` with the same digest is skipped.

    ``existing``: target, content of what is there. Write the rows that are not skipped, read them back and call this
    again: every row must then be skipped, or ``same`` is false for a bad copy.
    """
    rows = files.withColumn("src_hash", F.sha2("content", 256))
    if existing is None:
        return rows.withColumns({"dest_hash": F.lit(None).cast("string"), "skipped_existing": F.lit(False), "same": F.lit(None).cast("boolean")})
    there = existing.select("target", F.sha2("content", 256).alias("dest_hash"))
    out = rows.join(there, "target", "left")
    same = F.col("src_hash") == F.col("dest_hash")
    return out.withColumns({"skipped_existing": F.coalesce(same, F.lit(False)), "same": same})
