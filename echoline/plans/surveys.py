"""Further relational queries: pair validity, survey distances, baselines, priors, permutations, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.functions import arrays as A
from echoline.functions import constants as K
from echoline.functions import physics as P
from echoline.operators import relational as R
from echoline.plans import network
from echoline.plans.registry import query, table
from echoline.plans.signals import N, E, S, _PHAT, long, phat, signals

r = P.rounded


@query(f"""
WITH {network._MATCHED}
SELECT event_id_a, event_id_b, nullif(concat_ws('; ', CASE WHEN value_a < 10 THEN 'signal A too weak' END, CASE WHEN value_b < 10 THEN 'signal B too weak' END, CASE WHEN drift_s > 5 THEN 'drift over 5 s' END, CASE WHEN user_id_a % 10 = user_id_b % 10 THEN 'same site' END), '') AS errors FROM m
""")
def pair_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is wrong with a pair of recordings, in one text; null if nothing is."""
    rules = [
        (F.col("value_a") < 10, "signal A too weak"), (F.col("value_b") < 10, "signal B too weak"), (F.col("drift_s") > K.MAX_DRIFT_S, "drift over 5 s"),
        (F.col("user_id_a") % 10 == F.col("user_id_b") % 10, "same site"),
    ]
    errors = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules])), "; ")
    return network.matched(spark, sf_dir).select("event_id_a", "event_id_b", F.when(errors != "", errors).alias("errors"))


@query(f"WITH {network._SENSORS} SELECT a.site_id, a.sensor_id AS sensor_a, b.sensor_id AS sensor_b, round({network._hav()}, 3) AS metres FROM sensors a JOIN sensors b ON a.site_id = b.site_id AND a.sensor_id < b.sensor_id")
def survey_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sensors of one site; a site has tens of them."""
    s = network.sensors(spark, sf_dir).select("site_id", "sensor_id", "latitude", "longitude")
    b = s.select("site_id", F.col("sensor_id").alias("sensor_b"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"))
    p = s.join(b, "site_id").filter("sensor_id < sensor_b")
    return p.select("site_id", F.col("sensor_id").alias("sensor_a"), "sensor_b", r(P.haversine(F.col("latitude"), F.col("longitude"), F.col("lat_b"), F.col("lon_b")), 3).alias("metres"))


@query("""
WITH b AS (SELECT user_id, sqrt(avg(value * value)) AS rms, avg(value) AS mean, var_pop(value) AS v FROM events WHERE event_id % 5 = 0 GROUP BY user_id),
n AS (SELECT user_id, sqrt(avg(value * value)) AS rms, avg(value) AS mean, var_pop(value) AS v FROM events WHERE event_id % 5 <> 0 GROUP BY user_id)
SELECT n.user_id, round(n.rms / (b.rms + 1e-12), 6) AS rms_ratio, round(n.mean / (b.mean + 1e-12), 6) AS mean_ratio, b.user_id IS NULL AS no_baseline FROM n LEFT JOIN b USING (user_id)
""")
def baseline_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels against the sensor's own baseline; both sides of the split come from one pass."""
    base = F.col("event_id") % 5 == 0
    v = F.col("value")
    level = lambda c, f: f(F.when(c, v))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.sqrt(level(base, lambda x: F.avg(x * x))).alias("b_rms"), level(base, F.avg).alias("b_mean"), F.sqrt(level(~base, lambda x: F.avg(x * x))).alias("rms"), level(~base, F.avg).alias("mean")
    ).filter("rms IS NOT NULL")
    return g.select("user_id", r(F.col("rms") / (F.col("b_rms") + 1e-12)).alias("rms_ratio"), r(F.col("mean") / (F.col("b_mean") + 1e-12)).alias("mean_ratio"), F.col("b_rms").isNull().alias("no_baseline"))


@query("""
WITH k AS (SELECT epoch, event_id, row_number() OVER (PARTITION BY epoch, event_type ORDER BY md5((7 # epoch)::VARCHAR || '/' || event_id), event_id) AS place, event_type FROM events, (VALUES (1), (2)) t(epoch))
SELECT epoch::INTEGER AS epoch, event_type, event_id, place::INTEGER AS place FROM k WHERE place > 3
""".replace("(7 # epoch)", "xor(7, epoch)"))
def epoch_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new seeded order of every class each epoch (seed xor epoch), resumed after its third row."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("epoch"))
    seed = F.lit(7).bitwiseXOR(F.col("epoch")).cast("string")
    order = F.md5(F.concat(seed, F.lit("/"), F.col("event_id").cast("string")))
    k = R.ranks(e.withColumn("d", order), ["epoch", "event_type"], F.substring("d", 1, 3), F.col("d"), F.col("event_id"))
    return k.filter("place > 3").select("epoch", "event_type", "event_id", F.col("place").cast("int").alias("place"))


@query(f"""
WITH x AS (SELECT k, k * 0.5::DOUBLE AS x FROM (SELECT unnest(range(41)) AS k)), w AS (SELECT 'uniform' AS kind, k, 1.0::DOUBLE AS w FROM x UNION ALL SELECT 'gaussian', k, exp(-pow(x - 10, 2) / 5000) FROM x UNION ALL SELECT 'informed', k, exp(-pow(x - 8, 2) / 50) + 0.1 FROM x)
SELECT kind, k::INTEGER AS k, round(w / sum(w) OVER (PARTITION BY kind), 8) AS p FROM w
""")
def priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform, Gaussian and informed priors over positions, each summing to one."""
    x = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: k * 0.5)
    shapes = {"uniform": lambda v: F.lit(1.0), "gaussian": lambda v: F.exp(-F.pow(v - 10, F.lit(2)) / 5000), "informed": lambda v: F.exp(-F.pow(v - 8, F.lit(2)) / 50) + 0.1}
    one = [F.struct(F.lit(n).alias("kind"), A.let(F.transform(x, f), lambda w: A.let(A.total(w), lambda s: F.transform(w, lambda v: v / s))).alias("p")) for n, f in shapes.items()]
    out = spark.range(1).select(F.explode(F.array(*one)).alias("z")).select("z.kind", F.posexplode("z.p").alias("k", "p"))
    return out.select("kind", "k", r(F.col("p"), 8).alias("p"))


@query(f"WITH {E} SELECT vec_id, (i // 7)::INTEGER AS i, round(v, 6) + 0 AS v FROM e WHERE i % 7 = 0")
def downsample_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten samples at even steps from first to last."""
    x = F.col("x")
    at = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.element_at(x, (F.floor(k * (F.size(x) - 1) / 9) + 1).cast("int")))
    return long(signals(spark, sf_dir), ["vec_id"], at)


@query(f"""
WITH {E}, m AS (SELECT vec_id, i - 16 AS i, v FROM e WHERE i BETWEEN 16 AND 47),
f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * ((k * i) % 32) / 32)) AS re, sum(v * sin(2 * pi() * ((k * i) % 32) / 32)) AS im FROM m, (SELECT unnest(range(17)) AS k) GROUP BY vec_id, k)
SELECT vec_id, arg_max(k * 128.0::DOUBLE, (round(sqrt(re * re + im * im), 9), -k)) AS hz FROM f GROUP BY vec_id
""")
def centre_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant frequency of the middle segment, by magnitude; the sums are written out as array expressions."""
    s = signals(spark, sf_dir).select("vec_id", F.slice("x", 17, 32).alias("m"))
    part = lambda wave, k: A.total(F.transform("m", lambda v, i: v * wave(i * k * (2 * 3.141592653589793 / 32))))
    power = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: F.round(F.sqrt(F.pow(part(F.cos, k), 2) + F.pow(part(F.sin, k), 2)), 9))
    return s.select("vec_id", (A.argmax(power) * 128.0).alias("hz"))


@query("SELECT doc_id, n_chars // 1024 * 80 AS segments, (n_chars // 1024 * 80) * (512 * 4 + 64 * 1 * 2) + 2 AS bytes FROM documents")
def dataset_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a file's block in a dataset: waveforms, half-precision mel frames and a label."""
    segments = F.floor(F.col("n_chars") / 1024) * 80
    return table(spark, sf_dir, "documents").select("doc_id", segments.alias("segments"), (segments * (512 * 4 + 64 * 1 * 2) + 2).alias("bytes"))


@query(f"""
WITH {_PHAT}, k AS (SELECT pair_id, lag, v, row_number() OVER (PARTITION BY pair_id ORDER BY round(v, 9) DESC, lag) AS k FROM c)
SELECT pair_id, lag::INTEGER AS lag, round(v, 6) AS v, k::INTEGER AS place FROM k WHERE k <= 3
""")
def top_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three greatest lags of each pair, ranked inside the row."""
    ranked = F.slice(F.array_sort(F.transform("c", lambda v, i: F.struct((-F.round(v, 9)).alias("d"), (i + (1 - N)).alias("lag"), v.alias("v")))), 1, 3)
    t = phat(spark, sf_dir).select("pair_id", F.posexplode(ranked).alias("k", "z"))
    return t.select("pair_id", F.col("z.lag").cast("int").alias("lag"), r(F.col("z.v")).alias("v"), (F.col("k") + 1).alias("place"))


@query("""
WITH b AS (SELECT event_type AS band, user_id, value, event_id FROM events), u AS (SELECT *, row_number() OVER (PARTITION BY user_id, band ORDER BY value DESC, event_id) AS k FROM b)
SELECT user_id, band, event_id, round(value, 6) AS value FROM u WHERE k <= 2 UNION ALL SELECT user_id, 'full', event_id, round(value, 6) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 2
""")
def band_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best peaks of every band and of the full band; a row goes to both in its own task."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.explode(F.array(F.col("event_type"), F.lit("full"))).alias("band"))
    return R.first_by(e, ["user_id", "band"], F.desc("value"), F.col("event_id"), n=2).select("user_id", "band", "event_id", r(F.col("value")).alias("value"))


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, length(html)::BIGINT AS n FROM pages)
SELECT host, count(*) AS n, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.95), 4) AS p95, count_if(n BETWEEN 500 AND 3000)::BIGINT AS in_range FROM p GROUP BY host HAVING count(*) > 1
""")
def listing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by folder: mean, 95th percentile, and how many are in range."""
    n = F.length("html")
    g = table(spark, sf_dir, "pages").groupBy(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("host")).agg(
        F.count("*").alias("n"), r(F.avg(n), 4).alias("mean"), r(F.percentile(n, F.lit(0.95)), 4).alias("p95"), F.count_if(n.between(500, 3000)).alias("in_range")
    )
    return g.filter("n > 1")


@query(f"""
WITH {S}, w AS (SELECT s.vec_id, s.label, k, sqrt(list_sum(list_transform(s.x[k * 16 + 1 : k * 16 + 16], lambda v: v * v)) / 16) AS rms FROM s, (SELECT unnest(range(4)) AS k) t),
c AS (SELECT vec_id, any_value(label) AS label, stddev_pop(rms) / avg(rms) AS cv FROM w GROUP BY vec_id)
SELECT label, count(*) AS n, round(avg(1 / (1 + cv)), 6) AS steadiness FROM c GROUP BY label
""")
def station_steadiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How steady the level is inside recordings, by station."""
    w = signals(spark, sf_dir).select("label", F.transform(A.windows(F.col("x"), 16, 16), A.rms).alias("w"))
    cv: Column = F.sqrt(A.moment(F.col("w"), 2)) / A.mean(F.col("w"))
    return w.groupBy("label").agg(F.count("*").alias("n"), r(F.avg(1 / (1 + cv))).alias("steadiness"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY THEN 'in' ELSE 'out' END AS side FROM orders
""")
def rolling_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a request window of 365 days before the latest one holds."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    inside = F.col("o_orderdate") >= F.col("last") - F.expr("INTERVAL 365 DAYS")
    return o.crossJoin(F.broadcast(last)).select("o_orderkey", F.when(inside, F.lit("in")).otherwise(F.lit("out")).alias("side"))
