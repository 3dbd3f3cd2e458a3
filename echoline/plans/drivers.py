"""Queries of files, registries and drivers: recordings encoded and read back, registry documents, matching through
the registry, batches whose failures stay as rows, audits, manifests and dataset layouts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.functions import arrays as A
from echoline.functions import constants as K
from echoline.functions import dsp
from echoline.functions import physics as P
from echoline.functions import text as X
from echoline.operators import meetings
from echoline.operators import relational as R
from echoline.operators.kernels import array_kernel, struct_kernel
from echoline.plans import kernel_sql as Q
from echoline.plans import network, signals
from echoline.plans.network import _NAME_LIST, _NAMES, _PAIRS, _SENSORS
from echoline.plans.registry import query, table
from echoline.plans.signals import _METHODS, _SPEC, E, S, _gcc_sql, long, pairs
from echoline.sources import catalogues, datasets, wav

r = P.rounded


def _pick(values: list[object], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


# Recordings as files.


def _quantised(v: str, bits: str) -> str:
    return f"(greatest(least(round_even({v} * pow(2, {bits} - 1), 0), pow(2, {bits} - 1) - 1), -pow(2, {bits} - 1)) / pow(2, {bits} - 1))"


@query(f"""
WITH {E}, q AS (SELECT *, [8, 16, 24, 32][vec_id % 4 + 1] AS bits, vec_id % 7 = 0 AS bad FROM e), y AS (SELECT *, {_quantised('v', 'bits')}::FLOAT::DOUBLE AS y FROM q)
SELECT vec_id, any_value(CASE WHEN NOT bad THEN bits END)::INTEGER AS bits, any_value(CASE WHEN NOT bad THEN 64 END)::BIGINT AS n_frames, any_value(bad) AS bad,
       round(max(CASE WHEN NOT bad AND i = 0 THEN y END), 6) AS head, round(max(CASE WHEN NOT bad AND i = 63 THEN y END), 6) AS tail, round(sum(CASE WHEN NOT bad THEN y END), 5) AS total FROM y GROUP BY vec_id
""")
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as files of four widths and back; files that were cut off stay as rows with an error."""
    x = F.col("x")
    content = wav.encoded(x, bits=_pick([8, 16, 24, 32], F.col("vec_id")))
    files = signals.signals(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), F.when(F.col("vec_id") % 7 == 0, F.substring(content, 1, 20)).otherwise(content).alias("content"))
    y = F.col("samples").cast("array<double>")
    return wav.decoded(files).select(
        F.col("path").cast("long").alias("vec_id"), "bits", "n_frames", F.col("error").isNotNull().alias("bad"),
        r(F.element_at(y, 1)).alias("head"), r(F.element_at(y, -1)).alias("tail"), r(F.when(y.isNotNull(), A.total(y)), 5).alias("total"),
    )


@query(f"""
WITH {E}, q AS (SELECT vec_id // 2 AS pair_id, vec_id % 2 AS side, i, {_quantised('v', '16')} AS y FROM e), p AS (SELECT a.pair_id, a.i, a.y AS first, (a.y + b.y) / 2 AS mean FROM q a JOIN q b ON a.side = 0 AND b.side = 1 AND a.pair_id = b.pair_id AND a.i = b.i)
SELECT pair_id, round(sum(first::FLOAT::DOUBLE), 5) AS first_total, round(sum(mean::FLOAT::DOUBLE), 5) AS mean_total FROM p GROUP BY pair_id
""")
def wav_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-channel files read by their first channel and by the mean of both."""
    files = pairs(spark, sf_dir).select(F.col("pair_id").cast("string").alias("path"), wav.encoded_pair(F.col("a"), F.col("b")).alias("content"))
    one = lambda how: wav.decoded(files, channels=how).select("path", r(A.total(F.col("samples").cast("array<double>")), 5).alias(f"{how}_total"))
    return one("first").join(one("mean"), "path").select(F.col("path").cast("long").alias("pair_id"), "first_total", "mean_total")


@query(f"WITH {E} SELECT vec_id, 64 / 8000.0::DOUBLE AS seconds, round(sum({_quantised('v', '32')}::FLOAT::DOUBLE), 5) AS total FROM e GROUP BY vec_id")
def raw_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless 32-bit files at 8 kHz."""
    files = signals.signals(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), wav.encoded_raw(F.col("x")).alias("content"))
    return wav.decoded_raw(files).select(F.col("path").cast("long").alias("vec_id"), "seconds", r(A.total(F.col("samples").cast("array<double>")), 5).alias("total"))


_FILES = """
f AS (SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'all_zero' WHEN 2 THEN 'frames=64' WHEN 3 THEN 'sample_rate_mismatch(8000)' WHEN 4 THEN 'sample_width_4' WHEN 5 THEN 'too_small_for_header' WHEN 6 THEN 'trailing_zero_run=600' ELSE 'long_zero_run=3000' END AS message FROM supplier)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, with one of eight things right or wrong."""
    k = F.col("s_suppkey") % 8
    of = lambda n, v=0.25: F.array_repeat(F.lit(v), n)
    n = K.SAMPLE_RATE * K.DURATION_S
    x = F.when(k == 1, of(n, 0.0)).when(k == 2, of(64)).when(k == 6, F.concat(of(n - 600), of(600, 0.0))).when(k == 7, F.concat(of(3000, 0.0), of(n - 3000))).otherwise(of(n))
    content = wav.encoded(x, F.when(k == 3, F.lit(8000)).otherwise(F.lit(K.SAMPLE_RATE)), F.when(k == 4, F.lit(32)).otherwise(F.lit(16)))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", content.alias("content"))
    return rows.withColumn("content", F.when(k == 5, F.substring("content", 1, 20)).otherwise(F.col("content")))


@query(f"WITH {_FILES} SELECT s_suppkey, s_suppkey % 8 NOT IN (1, 3, 4, 5) AS ok, message FROM f")
def wav_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, rate, width, length, silence and runs of zeros of every file."""
    return _stored(spark, sf_dir).select("s_suppkey", wav.integrity(F.col("content")).alias("i")).select("s_suppkey", "i.ok", "i.message")


@query(f"WITH {_FILES} SELECT s_suppkey, s_suppkey % 8 NOT IN (3, 4, 5) AS ok, CASE WHEN s_suppkey % 8 IN (1, 6, 7) THEN 'ok' ELSE message END AS message FROM f")
def wav_integrity_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header alone."""
    return _stored(spark, sf_dir).select("s_suppkey", wav.integrity(F.col("content"), light=True).alias("i")).select("s_suppkey", "i.ok", "i.message")


@query(f"WITH {_FILES} SELECT count(*) AS files, count_if(s_suppkey % 8 IN (1, 3, 4, 5)) AS bad, count_if(s_suppkey % 8 IN (2, 6, 7)) AS warned, (CASE WHEN count_if(s_suppkey % 8 IN (1, 3, 4, 5)) > 0 THEN 2 ELSE 0 END)::INTEGER AS exit_code FROM f")
def wav_validation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a validation run; any bad file makes its exit code 2."""
    i = _stored(spark, sf_dir).select(wav.integrity(F.col("content")).alias("i")).select("i.*")
    out = i.agg(F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("bad"), F.count_if(F.col("ok") & (F.col("message") != "ok")).alias("warned"))
    return out.withColumn("exit_code", F.when(F.col("bad") > 0, F.lit(2)).otherwise(F.lit(0)))


@query(f"""
WITH {S}, p AS (SELECT vec_id, list_transform(x, lambda v: v * [0.0, 1e-8, 1.0, 3.0, 6.0][vec_id % 5 + 1]) AS x, vec_id % 9 = 0 AS aside FROM s), m AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM p WHERE NOT aside),
t AS (SELECT *, CASE WHEN peak <= 1e-6 THEN 'skip_zero' WHEN peak >= 0.9 THEN 'skip_already' ELSE 'normalise' END AS status FROM m)
SELECT vec_id, status, round(peak, 6) AS peak_before, round(CASE WHEN status = 'normalise' THEN 0.98 / peak END, 5) AS scale, round(CASE WHEN status = 'normalise' THEN 0.98 ELSE peak END, 6) AS peak_after FROM t
""")
def normalisation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the normaliser did to each recording; quarantined folders are left out."""
    k = F.col("vec_id")
    gain = _pick([0.0, 1e-8, 1.0, 3.0, 6.0], k)
    rows = signals.signals(spark, sf_dir).select(
        F.concat(F.when(k % 9 == 0, F.lit("a/_quarantine/")).otherwise(F.lit("a/")), k.cast("string")).alias("path"), F.transform("x", lambda v: v * gain).alias("samples")
    )
    out = datasets.normalised(rows)
    return out.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("vec_id"), "status", r(F.col("peak_before")).alias("peak_before"), r(F.col("scale"), 5).alias("scale"), r(A.peak(F.col("samples"))).alias("peak_after"))


@query("""
WITH p AS (SELECT page_id, html, CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 6 = 0 THEN html || 'x' ELSE html END END AS there FROM pages)
SELECT page_id, sha256(html) AS src_hash, sha256(there) AS dest_hash, coalesce(there = html, false) AS skipped_existing, there = html AS same FROM p
""")
def copy_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verified copy: what is there with the same digest is skipped, a bad copy is not the same."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    files = p.select(k, F.col("html").cast("binary").alias("content"), k.cast("string").alias("target"))
    there = p.filter(k % 2 == 0).select(k.cast("string").alias("target"), F.when(k % 6 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")).cast("binary").alias("content"))
    return datasets.copy_verified(files, there).select("page_id", "src_hash", "dest_hash", "skipped_existing", "same")


@query(f"""
WITH n AS (SELECT event_id, {_NAME_LIST}[(event_id % 8) + 1] AS name FROM events), p AS (SELECT *, string_split(regexp_replace(name, '\\.[^.]*$', ''), '~') AS parts FROM n)
SELECT event_id, CASE WHEN len(parts) >= 4 THEN try_cast(parts[4] AS DOUBLE) END AS gain FROM p
""")
def viewer_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The viewer's reading of names: the fourth of four parts or more."""
    return table(spark, sf_dir, "events").select("event_id", X.viewer_gain(_pick(_NAMES, F.col("event_id"))).alias("gain"))


@query("SELECT event_id, 'out/' || user_id || '/' || event_id || '.wav' AS path FROM events WHERE (user_id, event_id % 50) NOT IN (SELECT (user_id, event_id % 50) FROM events WHERE event_id % 11 = 0)")
def landing_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads whose target is not there yet; the listing of the landing zone takes part as a table of paths."""
    e = table(spark, sf_dir, "events")
    slot = F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 50).cast("string"))
    listing = e.filter("event_id % 11 = 0").select(slot.alias("slot")).distinct()
    return e.withColumn("slot", slot).join(listing, "slot", "left_anti").select("event_id", F.concat(F.lit("out/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".wav")).alias("path"))


# Registries as documents.


def _registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON registry for each supplier, from which fields are missing in turn."""
    k = F.col("s_suppkey")
    gone = lambda n, c: F.when(k % n != 0, c)
    sensor = F.struct(gone(3, F.col("s_name")).alias("name"), gone(5, F.struct((k % 90 * 0.25).alias("latitude"), gone(2, k % 70 * 0.5).alias("longitude"))).alias("position"), gone(4, F.lit("site")).alias("site_id"))
    pipe = F.struct(gone(4, _pick(list(K.WAVE_SPEEDS), k)).alias("material"), (k % 40 * 10.0).alias("diameter_mm"))
    pair = F.struct(k.cast("string").alias("sensor_a"), (k + 1).cast("string").alias("sensor_b"), (k % 200 * 1.5).alias("distance_meters"), pipe.alias("pipe_segment"), gone(2, k % 6000 * 1.0).alias("wave_speed_mps"))
    text = F.to_json(F.struct(F.create_map(k.cast("string"), sensor).alias("sensors"), F.array(pair).alias("sensor_pairs")))
    return table(spark, sf_dir, "supplier").select(F.from_json(text, catalogues.REGISTRY).alias("z")).select("z.*")


@query("""
SELECT s_suppkey::VARCHAR AS sensor_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE s_suppkey::VARCHAR END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 90 * 0.25::DOUBLE ELSE 0 END AS latitude,
       CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 2 <> 0 THEN s_suppkey % 70 * 0.5::DOUBLE ELSE 0 END AS longitude, 0::DOUBLE AS elevation, CASE WHEN s_suppkey % 4 <> 0 THEN 'site' END AS site_id FROM supplier
""")
def registry_sensors_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors of registry documents; what is missing takes its default."""
    return catalogues.registry_tables(_registries(spark, sf_dir))[0].select("sensor_id", "name", "latitude", "longitude", "elevation", "site_id")


@query(f"""
WITH {_PAIRS}, k AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey % 4 <> 0 THEN [{', '.join(repr(m) for m in K.WAVE_SPEEDS)}][s_suppkey % {len(K.WAVE_SPEEDS)} + 1] ELSE 'ductile_iron' END AS material FROM supplier)
SELECT n::VARCHAR AS sensor_a, (n + 1)::VARCHAR AS sensor_b, n % 200 * 1.5::DOUBLE AS length, material, n % 40 * 10.0::DOUBLE AS diameter_mm, CASE WHEN n % 2 <> 0 THEN n % 6000 * 1.0::DOUBLE ELSE speed END AS speed FROM k LEFT JOIN speeds ON material_key = material
""")
def registry_pairs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of registry documents; a missing speed is that of the material."""
    return catalogues.registry_tables(_registries(spark, sf_dir))[1].select("sensor_a", "sensor_b", "length", "material", "diameter_mm", "speed")


@query("SELECT s_suppkey::VARCHAR AS sensor_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE s_suppkey::VARCHAR END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 90 * 0.25::DOUBLE ELSE 0 END AS latitude FROM supplier WHERE s_suppkey % 10 = 1")
def registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry written as one document and read again."""
    sensors, links = catalogues.registry_tables(_registries(spark, sf_dir))
    some = F.col("sensor_id").cast("long") % 10 == 1
    text = catalogues.registry_json(sensors.filter(some), links.filter(F.col("sensor_a").cast("long") % 10 == 1))
    again = catalogues.registry_tables(text.select(F.from_json("value", catalogues.REGISTRY).alias("z")).select("z.*"))[0]
    return again.select("sensor_id", "name", "latitude")


@query("SELECT s_suppkey AS sensor_id, CASE WHEN s_suppkey % 7 = 0 THEN 'new ' || s_suppkey ELSE s_name END AS name FROM supplier UNION ALL SELECT -s_suppkey, 'added' FROM supplier WHERE s_suppkey % 50 = 0")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries replace those of the same id."""
    s = network.sensors(spark, sf_dir).select("sensor_id", "name")
    new = s.filter("sensor_id % 7 = 0").select("sensor_id", F.concat(F.lit("new "), F.col("sensor_id").cast("string")).alias("name"))
    added = s.filter("sensor_id % 50 = 0").select((-F.col("sensor_id")).alias("sensor_id"), F.lit("added").alias("name"))
    return catalogues.upsert(s, new.unionByName(added), "sensor_id")


# Matching through the registry, and batches.

_REGISTERED = f"""{_PAIRS},
m AS (SELECT p.*, s.speed, a.event_id AS event_id_a, b.event_id AS event_id_b, a.value AS value_a, b.value AS value_b, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6::DOUBLE AS drift_s
  FROM pairs p LEFT JOIN speeds s ON s.material_key = translate(lower(p.material), ' -', '__') JOIN events a ON a.user_id = p.sensor_a JOIN events b ON b.user_id = p.sensor_b AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000)"""


def registered(spark: SparkSession, sf_dir: str, within_s: float = 60.0) -> DataFrame:
    """Recordings of the registry's pairs within a minute: sensors and time buckets are the join's key, so no bucket of the whole network meets."""
    p = network.pairs(spark, sf_dir).withColumn("speed", P.wave_speed(F.col("material")))
    a, b = network.recordings(spark, sf_dir, "a"), network.recordings(spark, sf_dir, "b")
    left = p.join(a, F.col("sensor_a") == F.col("user_id_a"))
    return R.interval_join(left, b, "ts_a", "ts_b", within_s, on=[("sensor_b", "user_id_b")])


@query(f"""
WITH {_REGISTERED}, k AS (SELECT *, row_number() OVER (PARTITION BY sensor_a, sensor_b ORDER BY drift_s, event_id_a, event_id_b) AS place FROM m)
SELECT sensor_a, sensor_b, event_id_a, event_id_b, length, speed, round(drift_s, 6) AS drift_s, place::INTEGER AS place FROM k WHERE place <= {K.MAX_BATCH_PAIRS}
""")
def registry_pair_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synchronised recordings of the registry's pairs with the pipe between them, the best first, up to the limit of a batch."""
    best = R.first_by(registered(spark, sf_dir), ["sensor_a", "sensor_b"], F.col("drift_s"), F.col("event_id_a"), F.col("event_id_b"), n=K.MAX_BATCH_PAIRS, rank="place")
    return best.select("sensor_a", "sensor_b", "event_id_a", "event_id_b", "length", "speed", r(F.col("drift_s")).alias("drift_s"), "place")


_BATCH = f"""{_REGISTERED}, g AS (SELECT sensor_a, sensor_b, count(*) AS matches, min(drift_s) AS best FROM m GROUP BY sensor_a, sensor_b), h AS (SELECT DISTINCT user_id FROM events),
batch AS (SELECT p.sensor_a, p.sensor_b, coalesce(matches, 0) AS matches, best, CASE WHEN s.speed IS NULL THEN 'unknown material' WHEN ha.user_id IS NULL THEN 'no recordings of sensor A' WHEN hb.user_id IS NULL THEN 'no recordings of sensor B' WHEN matches IS NULL THEN 'no synchronised recordings' END AS error
  FROM pairs p LEFT JOIN speeds s ON s.material_key = translate(lower(p.material), ' -', '__') LEFT JOIN h ha ON ha.user_id = p.sensor_a LEFT JOIN h hb ON hb.user_id = p.sensor_b LEFT JOIN g USING (sensor_a, sensor_b))"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = table(spark, sf_dir, "events").select("user_id").distinct()
    has = lambda x: heard.select(F.col("user_id").alias(f"sensor_{x}"), F.lit(True).alias(f"has_{x}"))
    found = registered(spark, sf_dir).groupBy("sensor_a", "sensor_b").agg(F.count("*").alias("matches"), F.min("drift_s").alias("best"))
    p = network.pairs(spark, sf_dir).join(has("a"), "sensor_a", "left").join(has("b"), "sensor_b", "left").join(found, ["sensor_a", "sensor_b"], "left")
    error = (
        F.when(P.wave_speed(F.col("material")).isNull(), F.lit("unknown material")).when(F.col("has_a").isNull(), F.lit("no recordings of sensor A"))
        .when(F.col("has_b").isNull(), F.lit("no recordings of sensor B")).when(F.col("matches").isNull(), F.lit("no synchronised recordings"))
    )
    return p.select("sensor_a", "sensor_b", F.coalesce("matches", F.lit(0)).alias("matches"), "best", error.alias("error"))


@query(f"WITH {_BATCH} SELECT sensor_a, sensor_b, matches, round(best, 6) AS best_drift_s, error FROM batch")
def registry_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every registered pair: what it has to correlate, or why it can't."""
    return _batch(spark, sf_dir).select("sensor_a", "sensor_b", "matches", r(F.col("best")).alias("best_drift_s"), "error")


@query(f"WITH {_BATCH} SELECT count(*) AS pairs, count_if(error IS NULL) AS succeeded, count_if(error IS NOT NULL) AS failed, sum(CASE WHEN error IS NULL THEN matches ELSE 0 END)::BIGINT AS recordings, coalesce(mode(error), '') IS NOT NULL AS done FROM batch")
def registry_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a batch with its failures."""
    ok = F.col("error").isNull()
    return _batch(spark, sf_dir).agg(F.count("*").alias("pairs"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("matches")).otherwise(F.lit(0))).alias("recordings"), F.lit(True).alias("done"))


@query("""
WITH k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 1000 DESC, event_id) AS place FROM events)
SELECT user_id, event_id, place::INTEGER AS place, round(value * 3 - 100, 6) AS spot FROM k WHERE place <= 10 AND value * 3 - 100 BETWEEN -5 AND 105
""")
def peaks_in_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best peaks of each sensor first, then those off the pipe dropped."""
    best = R.first_by(table(spark, sf_dir, "events"), ["user_id"], F.desc(F.col("event_id") * 7919 % 1000), F.col("event_id"), n=10, rank="place")
    at = F.col("value") * 3 - 100
    return best.filter(at.between(-K.TOLERANCE_M, 100 + K.TOLERANCE_M)).select("user_id", "event_id", "place", r(at).alias("spot"))


# Scalars.


@query("SELECT event_id, trunc((value / 10 - 3) * 4096)::INTEGER AS samples, round(event_id / 4096.0::DOUBLE, 6) AS seconds, round(value / 1400, 6) AS delay_s, round(value / 100 * 1400, 4) AS metres FROM events")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, seconds and metres into each other; samples are cut off towards zero."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", P.seconds_to_samples(v / 10 - 3).alias("samples"), r(P.samples_to_seconds(F.col("event_id"))).alias("seconds"),
        r(P.distance_to_delay(v, F.lit(1400.0))).alias("delay_s"), r(P.delay_to_distance(v / 100, F.lit(1400.0)), 4).alias("metres"),
    )


@query("SELECT event_id, round((100 - (200 + user_id * 30) * (value / 1000 - 0.05)) / 2, 5) AS spot, round(value / 1000 - 0.05, 6) + 0 AS delay_s FROM events")
def delay_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay to position and back at any speed."""
    speed, delay = F.lit(200.0) + F.col("user_id") * 30, F.col("value") / 1000 - 0.05
    x = P.raw_position(F.lit(100.0), speed, delay)
    return table(spark, sf_dir, "events").select("event_id", r(x, 5).alias("spot"), r(P.delay_of(x, F.lit(100.0), speed)).alias("delay_s"))


@query("""
WITH x AS (SELECT value * 3 - 100 AS x FROM events) SELECT CASE WHEN x < -5 THEN 'before sensor A' WHEN x > 105 THEN 'beyond sensor B' WHEN x < 0 OR x > 100 THEN 'within tolerance' ELSE 'ok' END AS message, count(*) AS n FROM x GROUP BY 1
""")
def distance_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions against the pipe's ends, 5 m tolerated."""
    x = F.col("value") * 3 - 100
    return table(spark, sf_dir, "events").groupBy(P.position_message(x, F.lit(100.0)).alias("message")).agg(F.count("*").alias("n"))


@query("SELECT event_id, round(20 * log10(greatest(value - 20, 1e-10)), 5) AS amplitude_db, round(10 * log10(greatest(value - 20, 1e-10)), 5) AS power_db FROM events")
def decibels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") - 20
    return table(spark, sf_dir, "events").select("event_id", r(P.decibel(v), 5).alias("amplitude_db"), r(P.decibel(v, 2), 5).alias("power_db"))


@query("""
WITH c AS (SELECT p_partkey, p_size * 100.0::DOUBLE AS low, p_retailprice * 2 AS high, (p_partkey % 13) / 10.0::DOUBLE AS conf, CASE WHEN p_partkey % 5 = 0 THEN 8192 ELSE 4096 END AS rate, ['phat', 'scot', 'roth', 'magic'][p_partkey % 4 + 1] AS method FROM part)
SELECT p_partkey, concat_ws('; ', CASE WHEN rate <> 4096 THEN 'sample rate differs' END, CASE WHEN method = 'magic' THEN 'unknown method' END, CASE WHEN low >= high THEN 'band is empty' END, CASE WHEN high > 2048 THEN 'band passes Nyquist' END, CASE WHEN conf > 1 THEN 'confidence out of range' END) AS problems FROM c
""")
def config_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each configuration; an empty text if nothing is."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(
        k, (F.col("p_size") * 100.0).alias("low"), (F.col("p_retailprice") * 2).alias("high"), (k % 13 / 10).alias("conf"),
        F.when(k % 5 == 0, F.lit(8192)).otherwise(F.lit(4096)).alias("rate"), _pick(["phat", "scot", "roth", "magic"], k).alias("method"),
    )
    return c.select("p_partkey", P.config_problems(F.col("rate"), F.col("method"), F.col("low"), F.col("high"), F.col("conf")).alias("problems"))


# Signals.

_PSD = f"{_SPEC}, n AS (SELECT vec_id, k, p, lag(p) OVER w AS b, lead(p) OVER w AS a, max(p) OVER (PARTITION BY vec_id) AS top FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY k))"


@query(f"WITH {_PSD}, t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS place FROM n WHERE p > b AND p > a AND p >= 0.1 * top) SELECT vec_id, k * 64.0::DOUBLE AS hz, round(p * 1e6, 4) AS micro, place::INTEGER AS place FROM t WHERE place <= 5")
def dominant_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five peaks of the density that reach a tenth of the highest bin."""
    p = signals.signals(spark, sf_dir).select("vec_id", array_kernel(lambda x: dsp.welch(x, 4096.0, 64)[1], F.col("x")).alias("p"))
    at = lambda i: F.element_at("p", i + 1)
    peak = lambda i: (at(i) > at(i - 1)) & (at(i) > at(i + 1)) & (at(i) >= 0.1 * F.array_max("p"))
    ranked = F.slice(F.array_sort(F.transform(F.filter(F.sequence(F.lit(1), F.lit(31)), peak), lambda i: F.struct((-at(i)).alias("d"), i.alias("i")))), 1, 5)
    t = p.select("vec_id", F.posexplode(ranked).alias("k", "z"))
    return t.select("vec_id", (F.col("z.i") * 64.0).alias("hz"), r(-F.col("z.d") * 1e6, 4).alias("micro"), (F.col("k") + 1).alias("place"))


@query(f"""
WITH {signals._FEATURES}, m AS (SELECT vec_id, avg(v) AS mean FROM e GROUP BY vec_id),
k AS (SELECT e.vec_id, avg(pow(v - mean, 4)) / pow(avg(pow(v - mean, 2)), 2) - 3 AS kurtosis, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak, abs(any_value(mean)) AS dc FROM e JOIN m USING (vec_id) GROUP BY e.vec_id),
b AS (SELECT f.*, k.*, f.vec_id // 2 AS pair_id FROM features f JOIN k ON f.vec_id = k.vec_id),
j AS (SELECT a.pair_id, a.band_ratio > 0.35 AS r1, a.kurtosis > 2 AS r2, a.dominant_hz BETWEEN 100 AND 1500 AS r3, a.rms / (c.rms + 1e-12) > 1.2 AS r4, a.entropy / (c.entropy + 1e-12) < 0.9 AS r5,
             CASE WHEN a.peak > 0.95 THEN 0.5 ELSE 1 END * CASE WHEN a.rms < 0.01 THEN 0.6 ELSE 1 END * CASE WHEN a.dc > 0.1 THEN 0.8 ELSE 1 END * CASE WHEN a.kurtosis > 20 THEN 0.7 ELSE 1 END AS quality FROM b a JOIN b c ON a.vec_id % 2 = 0 AND c.vec_id = a.vec_id + 1),
tt AS (SELECT *, (CASE WHEN r1 THEN 0.3 ELSE 0 END + CASE WHEN r2 THEN 0.2 ELSE 0 END + CASE WHEN r3 THEN 0.15 ELSE 0 END + CASE WHEN r4 THEN 0.2 ELSE 0 END + CASE WHEN r5 THEN 0.15 ELSE 0 END)::DOUBLE * CASE WHEN quality < 0.5 THEN 0.5 ELSE 1 END AS conf FROM j)
SELECT pair_id, round(conf, 6) AS confidence, (r1 OR r2 OR r4 OR r5) AND round(conf, 9) >= 0.5 AS detected, concat_ws('; ', CASE WHEN r1 THEN 'band power' END, CASE WHEN r2 THEN 'impulsive' END, CASE WHEN r3 THEN 'dominant in band' END, CASE WHEN r4 THEN 'louder than baseline' END, CASE WHEN r5 THEN 'more structured than baseline' END) AS reason FROM tt
""")
def baseline_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensor against its known good recording: rules on the level and entropy ratios take the place of absolute ones."""
    x = F.col("x")
    f = signals.features(spark, sf_dir).withColumns({"kurtosis": A.excess_kurtosis(x), "rms": A.rms(x), "peak": A.peak(x), "dc": F.abs(A.mean(x)), "pair_id": F.floor(F.col("vec_id") / 2)})
    base = f.filter("vec_id % 2 = 1").select("pair_id", F.col("rms").alias("base_rms"), F.col("entropy").alias("base_entropy"))
    j = f.filter("vec_id % 2 = 0").join(base, "pair_id")
    rules = [
        ("band power", F.col("band_ratio") > 0.35, 0.3), ("impulsive", F.col("kurtosis") > 2, 0.2), ("dominant in band", F.col("dominant_hz").between(100, 1500), 0.15),
        ("louder than baseline", F.col("rms") / (F.col("base_rms") + 1e-12) > 1.2, 0.2), ("more structured than baseline", F.col("entropy") / (F.col("base_entropy") + 1e-12) < 0.9, 0.15),
    ]
    factor = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(1.0))
    quality = factor(F.col("peak") > 0.95, 0.5) * factor(F.col("rms") < 0.01, 0.6) * factor(F.col("dc") > 0.1, 0.8) * factor(F.col("kurtosis") > 20, 0.7)
    conf = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for _, c, w in rules), F.lit(0.0)) * factor(quality < 0.5, 0.5)
    flag = rules[0][1] | rules[1][1] | rules[3][1] | rules[4][1]
    return j.select("pair_id", r(conf).alias("confidence"), (flag & (F.round(conf, 9) >= 0.5)).alias("detected"), F.concat_ws("; ", *[F.when(c, F.lit(n)) for n, c, _ in rules]).alias("reason"))


@query(f"""
WITH {E}, w AS (SELECT vec_id, i // 16 AS w, i % 16 AS j, v FROM e), l AS (SELECT vec_id, w, sqrt(avg(v * v)) AS rms FROM w GROUP BY vec_id, w),
d AS (SELECT vec_id, w, j, (v - avg(v) OVER (PARTITION BY vec_id, w)) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS v FROM w),
f AS (SELECT vec_id, w, k, (pow(sum(v * cos(2 * pi() * ((k * j) % 16) / 16)), 2) + pow(sum(v * sin(2 * pi() * ((k * j) % 16) / 16)), 2)) / (4096 * 6.0) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END AS p FROM d, (SELECT unnest(range(9)) AS k) GROUP BY vec_id, w, k),
q AS (SELECT *, p / (sum(p) OVER (PARTITION BY vec_id, w) + 1e-12) + 1e-12 AS q FROM f), u AS (SELECT vec_id, w, q / sum(q) OVER (PARTITION BY vec_id, w) AS u FROM q), h AS (SELECT vec_id, w, -sum(u * ln(u)) AS entropy FROM u GROUP BY vec_id, w),
c AS (SELECT vec_id, stddev_pop(rms) / (avg(rms) + 1e-12) AS rms_cv, stddev_pop(entropy) / (avg(entropy) + 1e-12) AS entropy_cv FROM l JOIN h USING (vec_id, w) GROUP BY vec_id)
SELECT vec_id, round(rms_cv, 6) AS rms_variation, round(entropy_cv, 6) AS spectral_variation, round(1 / (1 + rms_cv + entropy_cv), 6) AS consistency FROM c
""")
def temporal_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How steady level and spectral entropy are over the windows of a recording."""

    def entropies(x: np.ndarray) -> np.ndarray:
        w = x.reshape(len(x), -1, 16)
        return dsp.spectral_features(w.reshape(-1, 16), 4096.0)["entropy"].reshape(len(x), -1)

    s = signals.signals(spark, sf_dir).select("vec_id", F.transform(A.windows(F.col("x"), 16, 16), A.rms).alias("rms"), array_kernel(entropies, F.col("x")).alias("h"))
    cv = lambda c: F.sqrt(A.moment(F.col(c), 2)) / (A.mean(F.col(c)) + 1e-12)
    s = s.select("vec_id", cv("rms").alias("a"), cv("h").alias("b"))
    return s.select("vec_id", r(F.col("a")).alias("rms_variation"), r(F.col("b")).alias("spectral_variation"), r(1 / (1 + F.col("a") + F.col("b"))).alias("consistency"))


@query(f"""
WITH {E}, w AS (SELECT vec_id, s // 8 AS k, sqrt(avg(v * v)) AS rms FROM e JOIN (SELECT unnest(range(0, 49, 8)) AS s) ON i >= s AND i < s + 16 GROUP BY vec_id, s),
p AS (SELECT *, CASE WHEN rms > 0.1 THEN least(0.9, 2 * rms) ELSE 0.3 END AS p, (rms - min(rms) OVER o) / (max(rms) OVER o - min(rms) OVER o + 1e-12) AS snr FROM w WINDOW o AS (PARTITION BY vec_id)),
u AS (SELECT *, sqrt(p) * pow(snr, 0.3) AS u FROM p), g AS (SELECT vec_id, k, CASE WHEN sum(u) OVER o < 1e-10 THEN 1.0 / count(*) OVER o ELSE u / sum(u) OVER o END AS weight FROM u WINDOW o AS (PARTITION BY vec_id)),
c AS (SELECT a.vec_id // 2 AS pair_id, t.k, l.lag, sum(a.v * b.v) AS v FROM (SELECT unnest(range(7)) AS k) t, (SELECT unnest(range(-8, 8)) AS lag) l, e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1
  WHERE a.i BETWEEN 8 * t.k AND 8 * t.k + 15 AND b.i BETWEEN 8 * t.k AND 8 * t.k + 15 AND (b.i - 8 * t.k + l.lag + 16) % 16 = a.i - 8 * t.k GROUP BY a.vec_id // 2, t.k, l.lag)
SELECT c.pair_id, c.lag::INTEGER AS lag, round(sum(v * (x.weight + y.weight) / 2), 6) + 0 AS v FROM c JOIN g x ON x.vec_id = 2 * c.pair_id AND x.k = c.k JOIN g y ON y.vec_id = 2 * c.pair_id + 1 AND y.k = c.k GROUP BY c.pair_id, c.lag
""")
def gated_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular correlations of windows, weighted by the mean of both sensors' gates."""
    s = signals.gates(spark, sf_dir).select("vec_id", "weights")
    g = lambda x, y: s.select(F.col("vec_id").alias(f"v{y}"), F.col("weights").alias(x))

    def kernel(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> np.ndarray:
        cut = lambda x: np.lib.stride_tricks.sliding_window_view(x, 16, axis=1)[:, ::8]
        spec = np.fft.rfft(cut(a), axis=2) * np.conj(np.fft.rfft(cut(b), axis=2))
        return (np.fft.fftshift(np.fft.irfft(spec, 16, axis=2), axes=2) * ((wa + wb) / 2)[:, :, None]).sum(axis=1)

    p = pairs(spark, sf_dir).join(g("wa", "a"), F.col("va") == 2 * F.col("pair_id")).join(g("wb", "b"), F.col("vb") == 2 * F.col("pair_id") + 1)
    out = long(p, ["pair_id"], array_kernel(kernel, *map(F.col, ("a", "b", "wa", "wb"))))
    return out.select("pair_id", (F.col("i") - 8).alias("lag"), "v")


def _edge_band(name: str, clamp: bool) -> None:
    @query(Q.filtered([dsp.butterworth(4, 0.01 if clamp else 5 / 2048, 1500 / 2048)]), name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long(signals.signals(spark, sf_dir), ["vec_id"], array_kernel(lambda x: dsp.bandpass(x, 5, 1500, 4096.0, clamp=clamp), F.col("x")))


_edge_band("bandpass_clamped", True)
_edge_band("bandpass_unclamped", False)


@query(f"WITH {_gcc_sql(256, 'phat', -32, 32)} SELECT pair_id, lag::INTEGER AS lag, round(v, 6) + 0 AS v FROM c")
def gcc_phat_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PHAT as the detector takes it: padded to twice the full length, lags cut to the largest delay."""
    c = signals.correlated(spark, sf_dir, lambda a, b: dsp.gcc(a, b, "phat", 32, True), -32)
    return signals._lags(c)


@query(Q.MEL.replace("20 * log10", "10 * log10"))
def mel_power_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-mel frames in the classifier's scale."""
    return long(signals.signals(spark, sf_dir), ["vec_id"], array_kernel(lambda x: dsp.log_mel(x, 4096.0, 16, 32, 16, db=10.0).reshape(len(x), -1), F.col("x")))


@query(f"WITH {signals._FULL} SELECT pair_id, -arg_max(lag, (round(v, 9), lag))::INTEGER AS shift FROM c WHERE lag BETWEEN -31 AND 32 GROUP BY pair_id")
def alignment_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many samples the second recording of a pair lies after the first."""
    found = struct_kernel(lambda a, b: {"shift": np.array([dsp.alignment_shift(x, y) for x, y in zip(a, b, strict=True)], float)}, "shift: double", F.col("a"), F.col("b"))
    return pairs(spark, sf_dir).select("pair_id", found["shift"].cast("int").alias("shift"))


@query(f"WITH {S}, p AS (SELECT a.vec_id // 2 AS pair_id, CASE WHEN a.vec_id % 10 = 0 THEN []::DOUBLE[] ELSE a.x END AS a, CASE WHEN a.vec_id % 6 = 0 THEN b.x[1:60] ELSE b.x END AS b FROM s a JOIN s b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1) SELECT pair_id, len(a) > 0 AND len(a) = len(b) AS usable FROM p")
def correlation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the signals of a pair can be correlated: equal lengths, not empty."""
    k = F.col("pair_id") * 2
    p = pairs(spark, sf_dir).select("pair_id", F.when(k % 10 == 0, F.array().cast("array<double>")).otherwise(F.col("a")).alias("a"), F.when(k % 6 == 0, F.slice("b", 1, 60)).otherwise(F.col("b")).alias("b"))
    return p.select("pair_id", ((F.size("a") > 0) & (F.size("a") == F.size("b"))).alias("usable"))


@query(f"""
WITH {E}, g AS (SELECT vec_id, i, v * CASE WHEN vec_id % 6 = 0 THEN 0 ELSE 1 END AS v FROM e), m AS (SELECT vec_id, avg(v) AS mean, max(abs(v)) AS peak FROM g GROUP BY vec_id), n AS (SELECT vec_id, max(abs(v - mean)) AS top, any_value(peak) < 1e-6 AS silent FROM g JOIN m USING (vec_id) GROUP BY vec_id),
y AS (SELECT vec_id, i, CASE WHEN silent THEN 0 ELSE (v - mean) / top END AS y, silent FROM g JOIN m USING (vec_id) JOIN n USING (vec_id)), f AS (SELECT vec_id, k, sqrt(pow(sum(y * cos(2 * pi() * ((k * i) % 64) / 64)), 2) + pow(sum(y * sin(2 * pi() * ((k * i) % 64) / 64)), 2)) AS a FROM y, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k),
z AS (SELECT vec_id, any_value(silent) AS silent, sum(y * y) FILTER (i < 16) AS head_energy FROM y GROUP BY vec_id)
SELECT vec_id, any_value(silent) AS silent, round(any_value(head_energy), 6) AS head_energy, round(max(a), 6) AS top_magnitude, round(CASE WHEN any_value(silent) THEN 0 ELSE max(20 * log10(greatest(a, 1e-12))) END, 5) AS top_db FROM f JOIN z USING (vec_id) GROUP BY vec_id
""")
def viewer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the viewer shows of each file; silent files take zeros and skip the transforms."""
    x = F.transform("x", lambda v: v * F.when(F.col("vec_id") % 6 == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    s = signals.signals(spark, sf_dir).select("vec_id", x.alias("x")).withColumn("silent", A.peak(F.col("x")) < 1e-6)
    s = s.withColumn("y", F.when(F.col("silent"), F.col("x")).otherwise(A.peak_normalised(F.col("x"))))
    spec = array_kernel(lambda y: np.abs(np.fft.rfft(y, axis=1)), F.when(~F.col("silent"), F.col("y")))
    top = F.coalesce(F.array_max("a"), F.lit(0.0))
    s = s.withColumn("a", spec)
    energy = A.total(F.transform(F.slice("y", 1, 16), lambda v: v * v))
    return s.select("vec_id", "silent", r(energy).alias("head_energy"), r(top).alias("top_magnitude"), r(F.when(F.col("silent"), F.lit(0.0)).otherwise(20 * F.log10(F.greatest(top, F.lit(1e-12)))), 5).alias("top_db"))


# Results as documents.


@query(f"""
WITH {_SENSORS}, c AS (SELECT *, 0.5::DOUBLE + (sensor_id * 13 % 50) / 100.0::DOUBLE AS conf FROM sensors),
g AS (SELECT site_id, count(*) AS n, sum(conf * latitude) / sum(conf) AS la, sum(conf * conf) / sum(conf) AS c FROM c GROUP BY site_id HAVING count(*) >= 3)
SELECT site_id, '{{"sensors":' || n || ',"latitude":' || round(la, 5)::DECIMAL(18, 5)::VARCHAR || ',"confidence":' || round(c, 3)::DECIMAL(18, 3)::VARCHAR || '}}' AS json FROM g
""")
def triangulation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangulated positions as rounded documents."""
    s = network.sensors(spark, sf_dir).withColumn("conf", 0.5 + F.col("sensor_id") * 13 % 50 / F.lit(100.0))
    g = s.groupBy("site_id").agg(F.count("*").alias("n"), (F.sum(F.col("conf") * F.col("latitude")) / F.sum("conf")).alias("la"), (F.sum(F.col("conf") * F.col("conf")) / F.sum("conf")).alias("c")).filter("n >= 3")
    fixed = lambda c, d: F.round(c, d).cast(f"decimal(18,{d})")
    return g.select("site_id", F.to_json(F.struct(F.col("n").alias("sensors"), fixed(F.col("la"), 5).alias("latitude"), fixed(F.col("c"), 3).alias("confidence"))).alias("json"))


@query(f"""
WITH {network.LOCATED}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id_a, user_id_b ORDER BY round(conf, 9) DESC, event_id_a, event_id_b) AS place FROM located)
SELECT user_id_a, user_id_b, '{{"leaks":[' || string_agg('{{"distance_m":' || round(round(spot, 6)::DECIMAL(18, 6), 2)::DECIMAL(18, 2)::VARCHAR || ',"confidence":' || round(round(conf, 6)::DECIMAL(18, 6), 3)::DECIMAL(18, 3)::VARCHAR || '}}', ',' ORDER BY place) || ']}}' AS json FROM k WHERE place <= 10 GROUP BY user_id_a, user_id_b
""")
def leaks_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten surest results of each pair as one document."""
    return meetings.by_sensor_pair(table(spark, sf_dir, "events"), 60.0, lambda m: meetings.surest(m, 10), "user_id_a long, user_id_b long, json string")


# Datasets.


@query("WITH l AS (SELECT DISTINCT event_type AS label, event_id % 3 AS k FROM events), d AS (SELECT DISTINCT label FROM l) SELECT ['train', 'val', 'test'][l.k + 1] AS split, l.label, (SELECT count(*) FROM d WHERE d.label < l.label)::INTEGER AS label_id FROM l")
def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the union of all splits' listings, numbered over all of them."""
    parts = [table(spark, sf_dir, "events").filter(F.col("event_id") % 3 == k).select(F.lit(n).alias("split"), F.col("event_type").alias("label")) for k, n in enumerate(("train", "val", "test"))]
    listed = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return listed.join(F.broadcast(datasets.label_ids(listed)), "label").select("split", "label", F.col("label_id").cast("int").alias("label_id"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN upper(event_type) ELSE 'UNCLASSIFIED' END || '/' || event_id || '.wav' AS path FROM events")
def label_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where recordings are saved by label; labels that aren't known share a folder."""
    known = F.when(F.col("event_type").isin("click", "view", "purchase"), F.upper("event_type")).otherwise(F.lit("UNCLASSIFIED"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(known, F.lit("/"), F.col("event_id").cast("string"), F.lit(".wav")).alias("path"))


@query("SELECT l_orderkey * 7 + l_linenumber AS idx, (l_orderkey * 7 + l_linenumber) // 80 AS file_idx, ((l_orderkey * 7 + l_linenumber) % 80) // 2 AS long_idx, (l_orderkey * 7 + l_linenumber) % 2 AS short_idx FROM lineitem")
def segment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's number to file, long and short window, 40 by 2 a file."""
    idx = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(idx.alias("idx"), F.floor(idx / 80).alias("file_idx"), F.floor(idx % 80 / 2).alias("long_idx"), (idx % 2).alias("short_idx"))


@query("SELECT vec_id AS file_idx, k::INTEGER AS long_idx, label % 2 AS target FROM embeddings, (SELECT unnest(range(4)) AS k)")
def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's label on each of its long windows, leak or not."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    windows = signals.signals(spark, sf_dir).select(F.col("vec_id").alias("file_idx"), F.posexplode(A.windows(F.col("x"), 16, 16)).alias("long_idx", "w")).drop("w")
    return windows.join(s, F.col("file_idx") == F.col("vec_id")).select("file_idx", "long_idx", (F.col("label") % 2).alias("target"))


@query("SELECT doc_id, (lang = 'en')::INTEGER AS target FROM documents WHERE lang IS NOT NULL")
def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label against all others."""
    return table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select("doc_id", (F.col("lang") == "en").cast("int").alias("target"))


# Ingest.


@query("""
WITH seen AS (SELECT event_id FROM events WHERE event_id < 600 AND event_id % 10 < 8), c AS (SELECT max(event_id) - 1 AS last FROM seen)
SELECT event_id, false AS new FROM seen UNION ALL SELECT DISTINCT event_id, true FROM events, c WHERE event_id > last AND event_id NOT IN (SELECT event_id FROM seen)
""")
def cursor_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after an ingest that begins one before the greatest id seen and takes each unseen id once."""
    ids = table(spark, sf_dir, "events").select("event_id")
    seen = ids.filter("event_id < 600 AND event_id % 10 < 8")
    return catalogues.after_cursor(seen, ids, "event_id")


@query(r"""
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1' ELSE '3' END AS kind, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'L' || user_id || ' null here' ELSE 'L' || user_id || ' S9' END AS site, CASE WHEN event_id % 7 <> 0 THEN '9' END AS gain, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_ FROM events),
w AS (SELECT *, list_concat(list_filter(regexp_split_to_array(coalesce(site, ''), '\s+'), lambda v: v <> ''), ['OFF', 'OFF', 'OFF', 'OFF'])[1:2] AS w FROM t WHERE kind = '3' AND NOT (site IS NULL AND gain IS NULL)),
n AS (SELECT *, list_transform(w, lambda v: CASE WHEN lower(v) IN ('null', 'none', '0') THEN 'OFF' ELSE v END) AS names FROM w)
SELECT event_id, names[1] || '/' || names[2] || '/' || event_id || '~' || regexp_replace(at_, '[<>:"/\\|?*\s]+', '_', 'g') || '~' || coalesce(gain, '0') || '.wav' AS path FROM n WHERE event_id % 11 <> 0
""")
def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows that the ingest wants, each with the place where its file goes, without those that are there."""
    i = F.col("event_id")
    logger = F.concat(F.lit("L"), F.col("user_id").cast("string"))
    t = table(spark, sf_dir, "events").select(
        i, F.when(i % 4 == 0, F.lit("1")).otherwise(F.lit("3")).alias("kind"), F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 5 == 1, F.concat(logger, F.lit(" null here"))).otherwise(F.concat(logger, F.lit(" S9"))).alias("site"),
        F.when(i % 7 != 0, F.lit("9")).alias("gain"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
    )
    t = t.filter(catalogues.wanted(F.col("kind"), F.col("site"), F.col("gain"))).withColumn("names", X.site_tokens(F.col("site")))
    there = table(spark, sf_dir, "events").filter("event_id % 11 = 0").select("event_id")
    path = X.output_path(F.concat_ws("/", F.col("names")[0], F.col("names")[1]), i.cast("string"), F.lit("wav"), F.col("time"), F.coalesce("gain", F.lit("0")))
    return t.join(there, "event_id", "left_anti").select("event_id", path.alias("path"))


@query("""
WITH l AS (SELECT vec_id, vec_id % 9 = 0 AS bad, list_transform(range(4), lambda k: ((vec_id + k) % 5) / 4.0::DOUBLE) AS p FROM embeddings), s AS (SELECT *, list_avg(p) AS mean, len(list_filter(p, lambda v: v >= 0.35)) / 4.0::DOUBLE AS frac FROM l)
SELECT vec_id::VARCHAR AS filepath, (CASE WHEN NOT bad AND frac >= 0.25 THEN 1 ELSE 0 END)::INTEGER AS is_leak, CASE WHEN bad THEN 0 ELSE round(mean, 6) END AS leak_conf_mean, CASE WHEN bad THEN '[]' ELSE '[' || array_to_string(p, ',') || ']' END AS per_long_probs_json,
       CASE WHEN bad THEN 0 ELSE round(frac, 6) END AS long_pos_frac, CASE WHEN bad THEN 'error:unreadable' ELSE '' END AS notes FROM s
""")
def classification_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classification run writes; files that failed are rows with a note."""
    k, bad = F.col("vec_id"), F.col("vec_id") % 9 == 0
    longs = F.when(~bad, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: (k + j) % 5 / 4))
    s = table(spark, sf_dir, "embeddings").select(k.cast("string").alias("path"), F.when(bad, F.lit("unreadable")).alias("error"), longs.alias("longs"))
    p = F.col("longs")
    s = s.withColumn("mean_p", A.mean(p)).withColumn("frac", F.size(F.filter(p, lambda v: v >= 0.35)) / F.size(p))
    return catalogues.classification_rows(s.withColumn("leak", F.col("frac") >= 0.25))
