"""Registries, label files and logger catalogues as tables, and results as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.functions import physics as P

REGISTRY = """
sensors map<string, struct<name: string, position: struct<latitude: double, longitude: double, elevation: double, depth_meters: double>, site_id: string, site_name: string,
  logger_id: string, calibration: map<string, double>, temperature_C: double, pressure_bar: double, gain_db: double>>,
sensor_pairs array<struct<sensor_a: string, sensor_b: string, distance_meters: double, pipe_segment: struct<material: string, diameter_mm: double, installation_year: int, condition: string>, wave_speed_mps: double>>
"""

RECORDING = "id string, rst string, siteidtext string, recordingType string, gain string"


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sensors, pairs) of a registry file; missing numbers get their defaults, a missing speed that of the material."""
    return registry_tables(spark.read.schema(REGISTRY).option("multiLine", "true").json(path))


def registry_tables(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sensors, pairs) of registries, a row each in the columns of ``REGISTRY``."""
    s = whole.select(F.explode("sensors").alias("sensor_id", "s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sensors = s.select(
        "sensor_id", F.coalesce("s.name", "sensor_id").alias("name"), zero("s.position.latitude").alias("latitude"), zero("s.position.longitude").alias("longitude"), zero("s.position.elevation").alias("elevation"),
        zero("s.position.depth_meters").alias("depth"), "s.site_id", "s.site_name", "s.logger_id", "s.calibration", F.col("s.temperature_C").alias("temperature"), F.col("s.pressure_bar").alias("pressure"), "s.gain_db",
    )
    p = whole.select(F.explode("sensor_pairs").alias("p")).select("p.*")
    material = F.coalesce("pipe_segment.material", F.lit("ductile_iron"))
    pairs = p.select("sensor_a", "sensor_b", F.col("distance_meters").alias("length"), material.alias("material"), "pipe_segment.diameter_mm", "pipe_segment.installation_year", "pipe_segment.condition", F.coalesce("wave_speed_mps", P.wave_speed(material)).alias("speed"))
    return sensors, pairs


def registry_json(sensors: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row, the registry as JSON. A registry is a configuration file: its size is that of one file."""
    position = F.struct("latitude", "longitude", "elevation", F.col("depth").alias("depth_meters")).alias("position")
    entry = F.struct("sensor_id", F.struct("name", position, "site_id", "site_name", "logger_id", "calibration", F.col("temperature").alias("temperature_C"), F.col("pressure").alias("pressure_bar"), "gain_db"))
    s = sensors.agg(F.map_from_entries(F.collect_list(entry)).alias("sensors"))
    pipe = F.struct("material", "diameter_mm", "installation_year", "condition").alias("pipe_segment")
    p = pairs.agg(F.collect_list(F.struct("sensor_a", "sensor_b", F.col("length").alias("distance_meters"), pipe, F.col("speed").alias("wave_speed_mps"))).alias("sensor_pairs"))
    return s.crossJoin(p).select(F.to_json(F.struct("sensors", "sensor_pairs")).alias("value"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def dangling(pairs: DataFrame, sensors: DataFrame) -> DataFrame:
    """Pairs that name a sensor which isn't there."""
    known = sensors.select(F.col("sensor_id").alias("k"))
    return pairs.join(known, F.col("sensor_a") == F.col("k"), "left_anti").unionByName(pairs.join(known, F.col("sensor_b") == F.col("k"), "left_anti")).distinct()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label file by base name; of rows with one name the last of the file counts."""
    rows = spark.read.option("header", "true").csv(path).withColumn("_at", F.monotonically_increasing_id())
    base = F.regexp_replace(F.element_at(F.split("file", r"[/\\]"), -1), r"\.[^.]*$", "")
    names = [c for c in rows.columns if c != "_at"]
    last = rows.withColumn("base", base).groupBy("base").agg(F.max(F.struct("_at", *names)).alias("r"))
    return last.select("base", *[F.col(f"r.{c}").alias(c) for c in names])


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """A file of paths, one a line, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


def read_loggers(spark: SparkSession, path: str) -> DataFrame:
    """Loggers of an XML catalogue: id, owner."""
    return spark.read.format("xml").option("rowTag", "logger").option("attributePrefix", "").schema("id string, owner string").load(path)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of an XML catalogue, one or many a file."""
    return spark.read.format("xml").option("rowTag", "recording").schema(RECORDING).load(path)


def wanted(recording_type: Column, site: Column, gain: Column) -> Column:
    """What the ingest takes: type 3 with a site or a gain."""
    return F.coalesce(recording_type == "3", F.lit(False)) & ~(site.isNull() & gain.isNull())


def after_cursor(seen: DataFrame, listing: DataFrame, id_: str) -> DataFrame:
    """The ids of a snapshot after an ingest, and which are new: the listing is asked from one before the greatest id seen."""
    last = seen.agg((F.max(id_) - 1).alias("_last"))
    asked = listing.select(id_).crossJoin(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col(id_) > F.col("_last"))).select(id_)
    new = asked.join(seen.select(id_), id_, "left_anti").distinct()
    return seen.select(id_, F.lit(False).alias("new")).unionByName(new.select(id_, F.lit(True).alias("new")))


def write_results(results: DataFrame, path: str, by: list[str]) -> None:
    """JSON documents in a folder for each key."""
    results.write.mode("overwrite").partitionBy(*by).json(path)


def classification_rows(scored: DataFrame) -> DataFrame:
    """filepath, is_leak, leak_conf_mean, per_long_probs_json, long_pos_frac, notes; failures are rows with a note."""
    ok = F.col("error").isNull()
    return scored.select(
        F.col("path").alias("filepath"), F.when(ok, F.col("leak").cast("int")).otherwise(F.lit(0)).alias("is_leak"), F.when(ok, F.round("mean_p", 6)).otherwise(F.lit(0.0)).alias("leak_conf_mean"),
        F.coalesce(F.to_json("longs"), F.lit("[]")).alias("per_long_probs_json"), F.when(ok, F.round("frac", 6)).otherwise(F.lit(0.0)).alias("long_pos_frac"), F.when(ok, F.lit("")).otherwise(F.concat(F.lit("error:"), "error")).alias("notes"),
    )
