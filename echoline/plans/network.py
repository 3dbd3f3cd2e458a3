"""Sensor network queries: matching, registry, geography, names. Test tables stand in for
registries: suppliers are sensors, events are recordings of the sensor ``user_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.functions import constants as K
from echoline.functions import physics as P
from echoline.functions import text as X
from echoline.operators import meetings
from echoline.operators import relational as R
from echoline.plans.registry import query, table

r = P.rounded


def recordings(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(*[F.col(c).alias(f"{c}_{suffix}") for c in ("event_id", "user_id", "ts", "value", "event_type")])


def matched(spark: SparkSession, sf_dir: str, within_s: float = 60.0) -> DataFrame:
    a, b = recordings(spark, sf_dir, "a"), recordings(spark, sf_dir, "b")
    return R.interval_join(a, b, "ts_a", "ts_b", within_s, keep=F.col("user_id_a") < F.col("user_id_b"))


_MATCHED = """
m AS (
  SELECT a.event_id AS event_id_a, b.event_id AS event_id_b, a.user_id AS user_id_a, b.user_id AS user_id_b, a.value AS value_a, b.value AS value_b,
         a.event_type AS event_type_a, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6::DOUBLE AS drift_s
  FROM events a JOIN events b ON a.user_id < b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000)"""


@query(f"WITH {_MATCHED} SELECT event_id_a, event_id_b, user_id_a, user_id_b, round(drift_s, 6) AS drift_s FROM m")
def interval_pair_match_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of recordings of different sensors within a minute."""
    return matched(spark, sf_dir).select("event_id_a", "event_id_b", "user_id_a", "user_id_b", r(F.col("drift_s")).alias("drift_s"))


@query(f"""
WITH {_MATCHED}, k AS (
  SELECT *, row_number() OVER (PARTITION BY user_id_a, user_id_b ORDER BY drift_s, event_id_a, event_id_b) AS place FROM m)
SELECT event_id_a, event_id_b, user_id_a, user_id_b, round(drift_s, 6) AS drift_s, place::INTEGER AS place FROM k WHERE place <= {K.MAX_BATCH_PAIRS}
""")
def interval_pair_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best synchronised recordings of each sensor pair, up to the limit of a batch."""

    def best(m: meetings.Columns) -> meetings.Columns:
        at, place = meetings.first_of(m["pair"], (m["drift"], m["event_id_a"], m["event_id_b"]), K.MAX_BATCH_PAIRS)
        return {n: m[n][at] for n in ("event_id_a", "event_id_b", "user_id_a", "user_id_b")} | {"drift_s": m["drift"][at] / 1e6, "place": place}

    schema = "event_id_a long, event_id_b long, user_id_a long, user_id_b long, drift_s double, place int"
    return meetings.by_sensor_pair(table(spark, sf_dir, "events"), 60.0, best, schema, values=False)


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors with a position, a depth and, for some, the water's state."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("sensor_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("site_id"),
        (F.lit(40.0) + (k * 37 % 1700) / F.lit(100000.0)).alias("latitude"), (F.lit(-74.0) + (k * 91 % 3500) / F.lit(100000.0)).alias("longitude"),
        (k * 7 % 50).cast("double").alias("elevation"), F.when(k % 3 != 0, (k % 11).cast("double")).alias("depth"),
        F.when(k % 4 != 0, (F.lit(5) + k % 20).cast("double")).alias("temperature"), F.when(k % 5 != 0, (F.lit(1) + k % 7).cast("double")).alias("pressure"),
    )


_SENSORS = """
sensors AS (
  SELECT s_suppkey AS sensor_id, s_name AS name, s_nationkey AS site_id, 40.0::DOUBLE + (s_suppkey * 37 % 1700) / 100000.0::DOUBLE AS latitude,
         -74.0::DOUBLE + (s_suppkey * 91 % 3500) / 100000.0::DOUBLE AS longitude, (s_suppkey * 7 % 50)::DOUBLE AS elevation,
         CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 11)::DOUBLE END AS depth, CASE WHEN s_suppkey % 4 <> 0 THEN (5 + s_suppkey % 20)::DOUBLE END AS temperature,
         CASE WHEN s_suppkey % 5 <> 0 THEN (1 + s_suppkey % 7)::DOUBLE END AS pressure
  FROM supplier)"""

_MATERIALS = list(K.WAVE_SPEEDS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring sensors, with the pipe between them."""
    k = F.col("s_suppkey")
    material = F.element_at(F.array(*[F.lit(m.replace("_", " ").title()) for m in _MATERIALS]), (k % len(_MATERIALS) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("sensor_a"), (k + 1).alias("sensor_b"), (F.lit(5.0) + (k * 53 % 1200)).alias("length"), F.when(k % 10 == 7, F.lit("glass")).otherwise(material).alias("material")
    )


_PAIRS = f"""
pairs AS (
  SELECT s_suppkey AS sensor_a, s_suppkey + 1 AS sensor_b, 5.0::DOUBLE + (s_suppkey * 53 % 1200) AS length,
         CASE WHEN s_suppkey % 10 = 7 THEN 'glass' ELSE [{', '.join(repr(m.replace('_', ' ').title()) for m in _MATERIALS)}][s_suppkey % 9 + 1] END AS material
  FROM supplier),
speeds AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {v}.0::DOUBLE)" for m, v in K.WAVE_SPEEDS.items())}) t(material_key, speed))"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with both sensors' columns, suffixed."""
    s = sensors(spark, sf_dir)
    a, b = (s.select(*[F.col(c).alias(f"{c}_{x}") for c in s.columns]) for x in "ab")
    return pairs(spark, sf_dir).join(a, F.col("sensor_a") == F.col("sensor_id_a")).join(b, F.col("sensor_b") == F.col("sensor_id_b"))


def _hav(a: str = "a", b: str = "b") -> str:
    h = f"(pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


_SIDES = "pairs p JOIN sensors a ON p.sensor_a = a.sensor_id JOIN sensors b ON p.sensor_b = b.sensor_id"


def ends() -> list[list[Column]]:
    """Latitude, longitude and elevation of both sides."""
    return [[F.col(f"{c}_{x}") for c in ("latitude", "longitude", "elevation")] for x in "ab"]


@query(f"WITH {_SENSORS}, {_PAIRS} SELECT sensor_a, sensor_b, round({_hav()}, 4) AS gps_m FROM {_SIDES}")
def haversine_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ends()
    return sides(spark, sf_dir).select("sensor_a", "sensor_b", r(P.haversine(a[0], a[1], b[0], b[1]), 4).alias("gps_m"))


@query(f"WITH {_SENSORS}, {_PAIRS} SELECT sensor_a, sensor_b, round(sqrt(pow({_hav()}, 2) + pow(coalesce(b.depth, 0) - coalesce(a.depth, 0), 2)), 4) AS slant_m FROM {_SIDES}")
def geo_3d_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ends()
    flat = P.haversine(a[0], a[1], b[0], b[1])
    return sides(spark, sf_dir).select("sensor_a", "sensor_b", r(P.distance_3d(flat, F.col("depth_a"), F.col("depth_b")), 4).alias("slant_m"))


@query(f"""
WITH {_SENSORS}, {_PAIRS}, g AS (
  SELECT sensor_a, sensor_b, a.latitude AS la, a.longitude AS oa, b.latitude AS lb, b.longitude AS ob, a.elevation AS ea, b.elevation AS eb, {_hav()} / 6371000.0::DOUBLE AS d,
         unnest([0.0, 0.3, 0.5, 1.0, 1.2])::DOUBLE AS share FROM {_SIDES}),
w AS (SELECT *, sin((1 - share) * d) / sin(d) AS wa, sin(share * d) / sin(d) AS wb FROM g),
c AS (
  SELECT *, wa * cos(radians(la)) * cos(radians(oa)) + wb * cos(radians(lb)) * cos(radians(ob)) AS x,
         wa * cos(radians(la)) * sin(radians(oa)) + wb * cos(radians(lb)) * sin(radians(ob)) AS y, wa * sin(radians(la)) + wb * sin(radians(lb)) AS z FROM w)
SELECT sensor_a, sensor_b, share, CASE WHEN share <= 1 THEN round(degrees(atan2(z, sqrt(x * x + y * y))), 6) END AS latitude,
       CASE WHEN share <= 1 THEN round(degrees(atan2(y, x)), 6) END AS longitude, CASE WHEN share <= 1 THEN round(ea + share * (eb - ea), 6) END AS elevation
FROM c
""")
def leak_position_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.explode(F.array(*map(F.lit, (0.0, 0.3, 0.5, 1.0, 1.2)))).alias("share")
    at = sides(spark, sf_dir).select("*", share).withColumn("gps", P.interpolate(*ends(), F.col("share")))
    return at.select("sensor_a", "sensor_b", "share", *[r(F.col(f"gps.{c}")).alias(c) for c in ("latitude", "longitude", "elevation")])


@query(f"""
WITH {_SENSORS}, {_PAIRS}
SELECT sensor_a, sensor_b, p.material, s.speed,
       round(s.speed + 2.4::DOUBLE * ((coalesce(a.temperature, 20.0) + coalesce(b.temperature, 20.0)) / 2 - 20.0) + 0.16::DOUBLE * ((coalesce(a.pressure, 1.0) + coalesce(b.pressure, 1.0)) / 2 - 1.0), 6) AS speed_now
FROM {_SIDES} LEFT JOIN speeds s ON s.material_key = translate(lower(p.material), ' -', '__')
""")
def wave_speed_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wave speed by material and by the mean state of the water at both ends; null for unknown materials."""
    mean = lambda c, d: (F.coalesce(f"{c}_a", F.lit(d)) + F.coalesce(f"{c}_b", F.lit(d))) / 2
    speed = P.wave_speed(F.col("material"))
    now = P.environmental_speed(speed, mean("temperature", K.REFERENCE_TEMPERATURE_C), mean("pressure", K.REFERENCE_PRESSURE_BAR))
    return sides(spark, sf_dir).select("sensor_a", "sensor_b", "material", speed.alias("speed"), r(now).alias("speed_now"))


@query(f"""
WITH {_PAIRS}, d AS (
  SELECT sensor_a, sensor_b, length, coalesce(s.speed, 1400.0) AS speed, unnest([-0.9, -0.2, -0.01, 0.0, 0.02, 0.0281, 0.3, 2.0])::DOUBLE AS delay
  FROM pairs p LEFT JOIN speeds s ON s.material_key = translate(lower(p.material), ' -', '__')),
x AS (SELECT *, (length - speed * delay) / 2 AS raw FROM d),
q AS (SELECT *, CASE WHEN raw < -5.0 OR raw > length + 5.0 THEN least(greatest(raw, 0.0), length) ELSE raw END AS spot FROM x)
SELECT sensor_a, sensor_b, delay, round(spot, 4) AS from_a, round(length - spot, 4) AS from_b, round((length - 2 * spot) / speed, 6) AS delay_back,
       CASE WHEN raw < -5.0 THEN 'before sensor A' WHEN raw > length + 5.0 THEN 'beyond sensor B' WHEN raw < 0 OR raw > length THEN 'within tolerance' ELSE 'ok' END AS message,
       trunc(delay * 4096)::INTEGER AS delay_samples, round(length / speed, 6) AS max_delay
FROM q
""")
def leak_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = F.explode(F.array(*map(F.lit, (-0.9, -0.2, -0.01, 0.0, 0.02, 0.0281, 0.3, 2.0)))).alias("delay")
    d = pairs(spark, sf_dir).withColumn("speed", F.coalesce(P.wave_speed(F.col("material")), F.lit(1400.0))).select("*", delay)
    x = P.position(F.col("length"), F.col("speed"), F.col("delay"))
    return d.select(
        "sensor_a", "sensor_b", "delay", r(x, 4).alias("from_a"), r(F.col("length") - x, 4).alias("from_b"),
        r(P.delay_of(x, F.col("length"), F.col("speed"))).alias("delay_back"),
        P.position_message(P.raw_position(F.col("length"), F.col("speed"), F.col("delay")), F.col("length")).alias("message"),
        P.seconds_to_samples(F.col("delay")).alias("delay_samples"), r(P.distance_to_delay(F.col("length"), F.col("speed"))).alias("max_delay"),
    )


@query(f"""
WITH {_SENSORS}, {_PAIRS}, v AS (
  SELECT 'missing site' AS rule, sensor_id, NULL::BIGINT AS other FROM sensors LEFT JOIN nation ON site_id = n_nationkey AND n_regionkey <> 2 WHERE n_nationkey IS NULL
  UNION ALL SELECT 'position out of range', sensor_id, NULL FROM sensors WHERE NOT latitude BETWEEN -90 AND 90 OR NOT longitude BETWEEN -180 AND 180
  UNION ALL SELECT 'unknown sensor', sensor_a, sensor_b FROM pairs WHERE sensor_b NOT IN (SELECT sensor_id FROM sensors)
  UNION ALL SELECT 'separation', sensor_a, sensor_b FROM pairs WHERE NOT length BETWEEN 10 AND 1000
  UNION ALL SELECT 'unknown material', sensor_a, sensor_b FROM pairs WHERE translate(lower(material), ' -', '__') NOT IN (SELECT material_key FROM speeds)
  UNION ALL SELECT 'distance disagrees', sensor_a, sensor_b FROM {_SIDES} WHERE abs({_hav()} - length) > 5)
SELECT rule, sensor_id, other FROM v
""")
def registry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every rule that a sensor or pair breaks."""
    s, p, both = sensors(spark, sf_dir), pairs(spark, sf_dir), sides(spark, sf_dir)
    known = table(spark, sf_dir, "nation").filter("n_regionkey <> 2")
    a, b = ends()
    one = lambda df, rule, *c: df.select(F.lit(rule).alias("rule"), F.col(c[0]).alias("sensor_id"), (F.col(c[1]) if len(c) > 1 else F.lit(None).cast("long")).alias("other"))
    both_ids = ("sensor_a", "sensor_b")
    found = [
        one(s.join(known, F.col("site_id") == F.col("n_nationkey"), "left_anti"), "missing site", "sensor_id"),
        one(s.filter(~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180)), "position out of range", "sensor_id"),
        one(p.join(s, F.col("sensor_b") == F.col("sensor_id"), "left_anti"), "unknown sensor", *both_ids),
        one(p.filter(~F.col("length").between(K.MIN_SEPARATION_M, K.MAX_SEPARATION_M)), "separation", *both_ids),
        one(p.filter(P.wave_speed(F.col("material")).isNull()), "unknown material", *both_ids),
        one(both.filter(F.abs(P.haversine(a[0], a[1], b[0], b[1]) - F.col("length")) > K.TOLERANCE_M), "distance disagrees", *both_ids),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query("""
WITH e AS (SELECT least(user_id, user_id * 7 % 150) AS lo, greatest(user_id, user_id * 7 % 150) AS hi, event_id, value FROM events WHERE user_id <> user_id * 7 % 150),
f AS (SELECT lo, hi, arg_min(value, event_id) AS first_value, count(*) AS n, min(event_id) AS first_event FROM e GROUP BY lo, hi)
SELECT lo AS key_lo, hi AS key_hi, round(first_value, 6) AS first_value, n, first_event, lo = 3 OR hi = 3 AS touches_3 FROM f
""")
def pair_lookup_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in either orientation under one key; the first entry wins; which touch sensor 3."""
    e = table(spark, sf_dir, "events").withColumn("other", F.col("user_id") * 7 % 150).filter("user_id <> other")
    e = e.select("*", *R.unordered_key("user_id", "other"))
    best = e.groupBy("key_lo", "key_hi").agg(F.min(F.struct("event_id", "value")).alias("first"), F.count("*").alias("n"))
    touches = (F.col("key_lo") == 3) | (F.col("key_hi") == 3)
    return best.select("key_lo", "key_hi", r(F.col("first.value")).alias("first_value"), "n", F.col("first.event_id").alias("first_event"), touches.alias("touches_3"))


@query("""
WITH p AS (SELECT event_id, user_id, value, abs(hash_k) AS conf FROM (SELECT *, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS hash_k FROM events)),
g AS (SELECT *, CASE WHEN value - lag(value) OVER w > 5.0 THEN 1 ELSE 0 END AS begins FROM p WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
c AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS cluster_id FROM g),
b AS (SELECT *, count(*) OVER (PARTITION BY user_id, cluster_id) AS members, row_number() OVER (PARTITION BY user_id, cluster_id ORDER BY conf DESC, event_id) AS k FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conf DESC, event_id) AS place FROM b WHERE k = 1)
SELECT user_id, cluster_id::INTEGER AS cluster_id, event_id, round(value, 6) AS spot, conf, members, place::INTEGER AS place FROM t WHERE place <= 10
""")
def peak_cluster_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks along a pipe clustered at 5 m, the best of each cluster, the ten best of each sensor."""
    e = table(spark, sf_dir, "events").withColumn("conf", F.col("event_id") * 7919 % 1000 / F.lit(1000.0))
    c = R.gap_clusters(e, ["user_id"], "value", K.TOLERANCE_M, "event_id")
    size = c.groupBy("user_id", "cluster_id").agg(F.count("*").alias("members"), F.max(F.struct("conf", (-F.col("event_id")).alias("e"), "value")).alias("best"))
    best = size.select("user_id", F.col("cluster_id").cast("int").alias("cluster_id"), (-F.col("best.e")).alias("event_id"), r(F.col("best.value")).alias("spot"), F.col("best.conf").alias("conf"), "members")
    return R.first_by(best, ["user_id"], F.desc("conf"), F.col("event_id"), n=10, rank="place")


@query("""
WITH e AS (SELECT user_id, ts, event_id, value < 20 AS zero, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
z AS (SELECT *, place - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e WHERE zero),
g AS (SELECT user_id, run, count(*) AS len, max(place) AS last, any_value(n) AS n FROM z GROUP BY user_id, run),
s AS (SELECT user_id, max(len) AS longest, coalesce(max(len) FILTER (last = n), 0) AS trailing_run, sum(len)::BIGINT AS zeros, any_value(n) AS n FROM g GROUP BY user_id)
SELECT user_id, longest, trailing_run, round(zeros / n::DOUBLE, 6) AS zero_ratio,
       concat_ws(';', CASE WHEN zeros / n::DOUBLE >= 0.5 THEN 'high_zero_ratio' END, CASE WHEN longest >= 4 THEN 'long_zero_run' END, CASE WHEN trailing_run >= 1 THEN 'trailing_zero_run' END) AS messages
FROM s
""")
def zero_run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest and trailing run of silent samples of each sensor, with the warnings that they raise."""
    z = R.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 20)
    s = z.groupBy("user_id").agg(
        F.max("run_length").alias("longest"), F.coalesce(F.max(F.when(F.col("last_place") == F.col("n_rows"), F.col("run_length"))), F.lit(0)).alias("trailing_run"),
        (F.sum("run_length") / F.first("n_rows")).alias("ratio"),
    )
    messages = F.concat_ws(";", F.when(F.col("ratio") >= 0.5, F.lit("high_zero_ratio")), F.when(F.col("longest") >= 4, F.lit("long_zero_run")), F.when(F.col("trailing_run") >= 1, F.lit("trailing_zero_run")))
    return s.select("user_id", "longest", "trailing_run", r(F.col("ratio")).alias("zero_ratio"), messages.alias("messages"))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched recordings with the position that their drift would put a source at."""
    m = matched(spark, sf_dir)
    length, speed = F.lit(100.0) + (F.col("user_id_a") * 31 + F.col("user_id_b") * 17) % 900, F.lit(1400.0)
    delay = (F.col("value_a") - F.col("value_b")) / 1000
    x = P.position(length, speed, delay)
    conf = P.confidence(F.col("value_a") / 100, F.col("value_b") / 3, F.lit(1.0) + F.col("drift_s") / 10)
    return m.select("event_id_a", "event_id_b", "user_id_a", "user_id_b", F.col("event_type_a").alias("band"), length.alias("length"), x.alias("spot"), conf.alias("conf"), "drift_s")


LOCATED = f"""{_MATCHED},
located AS (
  SELECT event_id_a, event_id_b, user_id_a, user_id_b, event_type_a AS band, length, conf, drift_s, CASE WHEN raw < -5 OR raw > length + 5 THEN least(greatest(raw, 0.0), length) ELSE raw END AS spot
  FROM (
    SELECT *, (length - 1400.0 * ((value_a - value_b) / 1000)) / 2 AS raw,
           0.3::DOUBLE * least(greatest(abs(value_a / 100), 0.0), 1.0) + 0.4::DOUBLE * least(greatest(value_b / 3 / 30, 0.0), 1.0) + 0.3::DOUBLE * least(greatest((1.0 + drift_s / 10 - 1) / 9, 0.0), 1.0) AS conf
    FROM (SELECT *, 100.0::DOUBLE + (user_id_a * 31 + user_id_b * 17) % 900 AS length FROM m)))"""


@query(f"""
WITH {LOCATED},
g AS (SELECT *, CASE WHEN spot - lag(spot) OVER w > 5.0 THEN 1 ELSE 0 END AS begins FROM located WINDOW w AS (PARTITION BY user_id_a, user_id_b ORDER BY spot, event_id_a, event_id_b)),
c AS (SELECT *, sum(begins) OVER (PARTITION BY user_id_a, user_id_b ORDER BY spot, event_id_a, event_id_b ROWS UNBOUNDED PRECEDING)::INTEGER AS cluster_id FROM g),
b AS (SELECT *, count(*) OVER k AS members, row_number() OVER (PARTITION BY user_id_a, user_id_b, cluster_id ORDER BY conf DESC, event_id_a, event_id_b) AS first FROM c WINDOW k AS (PARTITION BY user_id_a, user_id_b, cluster_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id_a, user_id_b ORDER BY conf DESC, event_id_a, event_id_b)::INTEGER AS place FROM b WHERE first = 1)
SELECT user_id_a, user_id_b, event_id_a, event_id_b, cluster_id, members, place, round(spot, 4) AS spot, round(conf, 4) AS conf FROM t WHERE place <= 10
""")
def located_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: match, locate, score, cluster at 5 m, best of each cluster, ten best of each pair."""
    kernel = lambda m: meetings.located_clusters(m, K.TOLERANCE_M, 10)
    schema = "user_id_a long, user_id_b long, event_id_a long, event_id_b long, cluster_id int, members long, place int, spot double, conf double"
    return meetings.by_sensor_pair(table(spark, sf_dir, "events"), 60.0, kernel, schema)


_NAMES = [
    "S001~R123~20250118120530~100.wav", "12345~67890~2025-01-18_12-05-30~95.wav", "SENSOR_A~REC001~20250118_120530~110.WAV", "S1~R2~2025-01-18_12_05_30~90.wav",
    "S1~R2~20250118120530.wav", "S1~R2~20250118120530~1~2.wav", "S1~R2~20250118120530~100.flac", "S1~R2~tomorrow~100.wav",
]
_NAME_LIST = "[" + ", ".join(repr(n) for n in _NAMES) + "]"


@query(f"""
WITH e AS (SELECT event_id, replace({_NAME_LIST}[(event_id % 8) + 1], 'R', 'R' || user_id) AS name FROM events),
p AS (SELECT *, string_split(regexp_replace(name, '\\.wav$', '', 'i'), '~') AS parts, regexp_matches(name, '\\.wav$', 'i') AS wav FROM e)
SELECT event_id, name, CASE WHEN wav AND len(parts) = 4 THEN parts[1] END AS sensor_id, CASE WHEN wav AND len(parts) = 4 THEN parts[2] END AS recording_id,
       CASE WHEN wav AND len(parts) = 4 THEN parts[3] END AS stamp, CASE WHEN wav AND len(parts) = 4 THEN try_cast(parts[4] AS DOUBLE) END AS gain,
       CASE WHEN wav AND len(parts) = 4 THEN coalesce(try_strptime(parts[3], '%Y%m%d%H%M%S'), try_strptime(parts[3], '%Y-%m-%d_%H-%M-%S'), try_strptime(parts[3], '%Y%m%d_%H%M%S'), try_strptime(parts[3], '%Y-%m-%d_%H_%M_%S')) END AS ts
FROM p
""")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording names to typed parts; nulls where a name or time doesn't fit."""
    pick = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 8 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", F.replace(pick, F.lit("R"), F.concat(F.lit("R"), F.col("user_id").cast("string"))).alias("name"))
    e = e.withColumn("p", X.parse_filename(F.col("name")))
    return e.select("event_id", "name", "p.sensor_id", "p.recording_id", F.col("p.timestamp").alias("stamp"), F.col("p.gain_db").try_cast("double").alias("gain"), X.parse_time(F.col("p.timestamp")).alias("ts"))


@query("""
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y%m%d%H%M%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d_%H-%M-%S') WHEN 2 THEN strftime(ts, '%Y%m%d_%H%M%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d_%H_%M_%S') ELSE 'never' END AS stamp, date_trunc('second', ts) AS wanted FROM events),
p AS (SELECT *, coalesce(try_strptime(stamp, '%Y%m%d%H%M%S'), try_strptime(stamp, '%Y-%m-%d_%H-%M-%S'), try_strptime(stamp, '%Y%m%d_%H%M%S'), try_strptime(stamp, '%Y-%m-%d_%H_%M_%S')) AS ts FROM e)
SELECT event_id, stamp, ts, abs(epoch_us(ts) - epoch_us(wanted)) / 1e6::DOUBLE AS drift_s, coalesce(abs(epoch_us(ts) - epoch_us(wanted)) <= 5000000, false) AS synced FROM p
""")
def timestamp_multi_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, k = F.col("ts"), F.col("event_id") % 5
    stamp = F.when(k == 0, F.date_format(ts, "yyyyMMddHHmmss")).when(k == 1, F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")).when(k == 2, F.date_format(ts, "yyyyMMdd_HHmmss")).when(k == 3, F.date_format(ts, "yyyy-MM-dd_HH_mm_ss")).otherwise(F.lit("never"))
    e = table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"), F.date_trunc("second", ts.cast("timestamp")).cast("timestamp_ntz").alias("wanted"))
    drift = X.drift_s(X.parse_time(F.col("stamp")), F.col("wanted"))
    return e.select("event_id", "stamp", X.parse_time(F.col("stamp")).alias("ts"), drift.alias("drift_s"), F.coalesce(drift <= K.MAX_DRIFT_S, F.lit(False)).alias("synced"))


@query(r"""
WITH s AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN s_name WHEN 2 THEN '  ' || s_name || ' null  0 None extra' WHEN 3 THEN 'a b c d e f' ELSE s_name || ' Site 9' END AS t FROM supplier),
w AS (SELECT s_suppkey, list_concat(list_filter(regexp_split_to_array(coalesce(t, ''), '\s+'), lambda v: v <> ''), ['OFF', 'OFF', 'OFF', 'OFF'])[1:4] AS w FROM s),
n AS (SELECT s_suppkey, list_transform(w, lambda v: CASE WHEN lower(v) IN ('null', 'none', '0') THEN 'OFF' ELSE v END) AS w FROM w)
SELECT s_suppkey, w[1] AS logger, w[2] AS site_id, w[3] AS site_name, w[4] AS station FROM n
""")
def siteid_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey") % 5, F.col("s_name")
    text = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, name).when(k == 2, F.concat(F.lit("  "), name, F.lit(" null  0 None extra"))).when(k == 3, F.lit("a b c d e f")).otherwise(F.concat(name, F.lit(" Site 9")))
    t = table(spark, sf_dir, "supplier").select("s_suppkey", X.site_tokens(text).alias("w"))
    return t.select("s_suppkey", *[F.col("w")[i].alias(n) for i, n in enumerate(("logger", "site_id", "site_name", "station"))])


_REPAIRS = [*K.REPAIRED_AS, " Main ", "", "Other"]
_REPAIR_LIST = "[" + ", ".join(repr(x) for x in _REPAIRS) + "]"
_REPAIR_CASE = "CASE trim(rep) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.REPAIRED_AS.items()) + " ELSE 'unknown' END"


@query(rf"""
WITH e AS (
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' YES ' WHEN 1 THEN 'no' END AS leak, 'site/' || user_id AS site, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-1' WHEN 2 THEN ' 7*5 ' ELSE '12' END AS noise,
         {_REPAIR_LIST}[event_id % {len(_REPAIRS)} + 1] AS rep, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'on 3:4' END AS stamp, CASE WHEN event_id % 5 < 2 THEN event_id % 5 END AS part, event_id % 7 = 0 AS padded
  FROM events)
SELECT event_id, CASE WHEN lower(trim(leak)) = 'yes' THEN 'leak' ELSE 'noleak' END || '~' || regexp_replace(site, '[\\/:"*?<>|]+', '_', 'g') || '~' || event_id || '~' || translate(stamp, '-: ', '___') || '~100~'
       || CASE WHEN trim(noise) IN ('', '-1') THEN '0' ELSE regexp_replace(trim(noise), '[\\/:"*?<>|]+', '_', 'g') END || '~0~' || {_REPAIR_CASE} || coalesce('_part' || part, '') || CASE WHEN padded THEN '_padded' ELSE '' END || '.wav' AS name
FROM e
""")
def std_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", X.standard_name(
        F.when(i % 3 == 0, F.lit(" YES ")).when(i % 3 == 1, F.lit("no")), F.concat(F.lit("site/"), F.col("user_id").cast("string")), i.cast("string"),
        F.when(i % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("on 3:4")),
        F.when(i % 4 == 0, F.lit("")).when(i % 4 == 1, F.lit("-1")).when(i % 4 == 2, F.lit(" 7*5 ")).otherwise(F.lit("12")), F.lit(None).cast("string"),
        F.element_at(F.array(*map(F.lit, _REPAIRS)), (i % len(_REPAIRS) + 1).cast("int")), F.when(i % 5 < 2, i % 5), i % 7 == 0,
    ).alias("name"))


@query(r"""
WITH p AS (SELECT page_id, url, length(html)::BIGINT AS n FROM pages), b AS (SELECT *, (n * power(17, page_id % 6))::DOUBLE AS size FROM p)
SELECT page_id, regexp_replace(url, '[<>:"/\\|?*\s]+', '_', 'g') AS path_part, regexp_replace(url, '[\\/:"*?<>|]+', '_', 'g') AS file_part,
       upper(replace(url, ' ', '-')) AS folder, upper(replace(url, ' ', '_')) AS file,
       CASE page_id % 4 WHEN 0 THEN 'out/' || page_id || '.json' WHEN 1 THEN 'out/' || page_id || '.flot.json' WHEN 2 THEN 'out/' || page_id || '.csv' ELSE 'out/' || page_id || '~12_05~9_.wav' END AS path,
       CASE WHEN size < 1024 THEN printf('%.2f B', size) WHEN size < 1048576 THEN printf('%.2f KB', size / 1024) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576) WHEN size < 1099511627776 THEN printf('%.2f GB', size / 1073741824) ELSE printf('%.2f TB', size / 1099511627776) END AS size
FROM b
""")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised path and file parts, labels, output paths and readable sizes."""
    k = F.col("page_id") % 4
    kind = F.when(k == 0, F.lit("json")).when(k == 1, F.lit("json_flot")).when(k == 2, F.lit("csv")).otherwise(F.lit("wav"))
    size = F.length("html") * F.pow(F.lit(17), F.col("page_id") % 6)
    return table(spark, sf_dir, "pages").select(
        "page_id", X.sanitize_path(F.col("url")).alias("path_part"), X.sanitize_filename(F.col("url")).alias("file_part"), X.folder_label(F.col("url")).alias("folder"), X.file_label(F.col("url")).alias("file"),
        X.output_path(F.lit("out"), F.col("page_id").cast("string"), kind, F.lit("12:05"), F.lit("9?")).alias("path"), X.bytes_human(size).alias("size"),
    )
