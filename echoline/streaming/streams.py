"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 32, kind: str = "parquet") -> DataFrame:
    """A folder that files land in, ``per_trigger`` files a micro-batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def interval_pairs(a: DataFrame, b: DataFrame, within_s: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Stream-stream form of the interval join. Both sides carry a watermark and the condition bounds the
    times on both, so Spark can drop state that no later row can match. As in batch, time buckets make
    it an equi-join, which streams need.

    ``a``: sensor_a, recording_a, ts_a; ``b``: sensor_b, recording_b, ts_b (TIMESTAMP).
    """
    width = int(within_s * 1_000_000)
    bucket = lambda ts: F.floor(F.unix_micros(ts) / width)
    left = a.withWatermark("ts_a", lateness).withColumn("_bucket", F.explode(F.array(*[bucket("ts_a") + d for d in (-1, 0, 1)])))
    right = b.withWatermark("ts_b", lateness).withColumn("_own", bucket("ts_b"))
    gap = F.expr(f"INTERVAL {int(within_s)} SECONDS")
    meet = (F.col("_bucket") == F.col("_own")) & (F.col("ts_b") >= F.col("ts_a") - gap) & (F.col("ts_b") <= F.col("ts_a") + gap) & (F.col("sensor_a") < F.col("sensor_b"))
    out = left.join(right, meet).drop("_bucket", "_own")
    return out.withColumn("drift_s", F.abs(F.unix_micros("ts_a") - F.unix_micros("ts_b")) / 1e6)


def new_recordings(catalogue: DataFrame, ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Each recording id once, within the watermark."""
    return catalogue.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["id"])


def levels(recordings: DataFrame, ts: str = "ts", every: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Level and count of each sensor in tumbling windows."""
    return (
        recordings.withWatermark(ts, lateness).groupBy(F.window(ts, every), "sensor_id")
        .agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
        .select(F.col("window.start").alias("start"), "sensor_id", "n", "rms")
    )


def sessions(recordings: DataFrame, ts: str = "ts", gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Bursts of recordings of a sensor with no pause over ``gap``."""
    return (
        recordings.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), "sensor_id").agg(F.count("*").alias("n"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "sensor_id", "n")
    )


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends everything available now to Parquet, each row once: the sink's log and the checkpoint make retries harmless."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def land_new(catalogue: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Appends rows whose key the landing table doesn't have: the cursor ingest as micro-batches."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates([key])
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            #: Rows of this very batch, written by an attempt that failed later, don't count as seen.
            seen = spark.read.parquet(path).filter(F.col("_batch") != number).select(key)
            fresh = fresh.join(seen, key, "left_anti")
        fresh.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return catalogue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
