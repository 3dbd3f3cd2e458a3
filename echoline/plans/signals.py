"""Signal queries: statistics, windows, stacking, correlation, delays, posteriors. The vectors of ``embeddings``
stand in for recordings, vectors 2k and 2k + 1 for the two sensors of pair k, labels for stations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoline.functions import arrays as A
from echoline.functions import dsp
from echoline.functions import physics as P
from echoline.operators import relational as R
from echoline.operators.kernels import array_kernel, struct_kernel
from echoline.plans import kernel_sql
from echoline.plans.registry import query, table

r = P.rounded

S = "s AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
E = f"{S}, e AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM s)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, a, b; joined on ids, so only vectors move."""
    s = signals(spark, sf_dir)
    a = s.filter("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("pair_id"), "label", F.col("x").alias("a"))
    b = s.filter("vec_id % 2 = 1").select(((F.col("vec_id") - 1) / 2).cast("long").alias("pair_id"), F.col("x").alias("b"))
    return a.join(b, "pair_id")


def long(df: DataFrame, keys: list[str], array: Column, value: str = "v", at: str = "i") -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias(at, value)).select(*keys, at, r(F.col(value)).alias(value))


@query(f"""
WITH {E}, c AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS mean FROM e),
m AS (SELECT vec_id, sqrt(avg(v * v)) AS rms, any_value(mean) AS mean, avg(pow(v - mean, 2)) AS m2, avg(pow(v - mean, 3)) AS m3, avg(pow(v - mean, 4)) AS m4, max(abs(v)) AS peak, median(v) AS median FROM c GROUP BY vec_id)
SELECT vec_id, round(rms, 6) AS rms, round(mean, 6) + 0 AS mean, round(m4 / (m2 * m2) - 3, 6) AS kurtosis, round(m3 / pow(m2, 1.5), 6) AS skewness, round(peak, 6) AS peak, round(median, 6) + 0 AS median FROM m
""")
def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return signals(spark, sf_dir).select("vec_id", *[r(f(x)).alias(n) for n, f in (("rms", A.rms), ("mean", A.mean), ("kurtosis", A.excess_kurtosis), ("skewness", A.skewness), ("peak", A.peak), ("median", A.median))])


@query("""
WITH m AS (SELECT user_id, avg(value) AS mean, var_pop(value) AS m2 FROM events GROUP BY user_id),
c AS (SELECT e.user_id, value, mean, m2, pow(value - mean, 3) AS d3, pow(value - mean, 4) AS d4 FROM events e JOIN m USING (user_id))
SELECT user_id, count(*) AS n, round(max(abs(value)), 6) AS peak, round(sqrt(any_value(m2)), 6) AS rms, round(min(value), 6) AS low, round(max(value), 6) AS high, round(median(value), 6) AS median, round(any_value(mean), 6) AS mean,
       round(CASE WHEN sqrt(any_value(m2)) > 1e-8 THEN avg(d3) / pow(any_value(m2), 1.5) ELSE 0 END, 6) AS skew, round(CASE WHEN sqrt(any_value(m2)) > 1e-8 THEN avg(d4) / pow(any_value(m2), 2) - 3 ELSE 0 END, 6) AS kurtosis
FROM c GROUP BY user_id
""")
def viewer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    guarded = lambda c: F.when(F.stddev_pop(v) > 1e-8, c).otherwise(F.lit(0.0))
    stats = [("peak", F.max(F.abs(v))), ("rms", F.stddev_pop(v)), ("low", F.min(v)), ("high", F.max(v)), ("median", F.percentile(v, F.lit(0.5))), ("mean", F.avg(v)), ("skew", guarded(F.skewness(v))), ("kurtosis", guarded(F.kurtosis(v)))]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), *[r(c).alias(n) for n, c in stats])


@query(f"""
WITH {E}, q AS (SELECT vec_id, max(abs(v * (1 + vec_id % 5))) AS peak, sqrt(avg(pow(v * (1 + vec_id % 5), 2))) AS rms, avg(v * (1 + vec_id % 5)) AS dc FROM e GROUP BY vec_id)
SELECT vec_id, peak > 0.99 AS clipping, rms < 0.2 AS silence, CASE WHEN peak <= 1e-6 THEN 'skip_zero' WHEN peak >= 0.9 THEN 'skip_already' ELSE 'normalise' END AS route,
       round((CASE WHEN peak > 0.95 THEN 0.5 ELSE 1.0 END * CASE WHEN rms < 0.01 THEN 0.6 ELSE 1.0 END * CASE WHEN abs(dc) > 0.1 THEN 0.8 ELSE 1.0 END)::DOUBLE, 6) AS quality
FROM q
""")
def signal_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipping, silence, the normaliser's route and the quality score of signals at five gains."""
    g = F.lit(1.0) + F.col("vec_id") % 5
    s = signals(spark, sf_dir).select("vec_id", F.transform("x", lambda v: v * g).alias("x"))
    q = s.select("vec_id", A.peak(F.col("x")).alias("peak"), A.rms(F.col("x")).alias("rms"), A.mean(F.col("x")).alias("dc"), F.exists("x", lambda v: F.abs(v) > 0.99).alias("clipping"))
    factor = lambda c, f: F.when(c, F.lit(f)).otherwise(F.lit(1.0))
    quality = factor(F.col("peak") > 0.95, 0.5) * factor(F.col("rms") < 0.01, 0.6) * factor(F.abs("dc") > 0.1, 0.8)
    route = F.when(F.col("peak") <= 1e-6, F.lit("skip_zero")).when(F.col("peak") >= 0.9, F.lit("skip_already")).otherwise(F.lit("normalise"))
    return q.select("vec_id", "clipping", (F.col("rms") < 0.2).alias("silence"), route.alias("route"), r(quality).alias("quality"))


@query("""
WITH e AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS w FROM events),
g AS (SELECT user_id, w, sqrt(avg(value * value)) AS rms FROM e GROUP BY user_id, w)
SELECT user_id, count(*) AS windows, CASE WHEN count(*) >= 2 THEN round(stddev_pop(rms) / avg(rms), 6) ELSE 0 END AS rms_cv, CASE WHEN count(*) >= 2 THEN round(1 / (1 + stddev_pop(rms) / avg(rms)), 6) ELSE 0 END AS consistency
FROM g GROUP BY user_id
""")
def temporal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How steady the level of each sensor is over windows of ten recordings."""
    e = R.first_by(table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), F.col("event_id"), n=2**31 - 1, rank="k")
    g = e.groupBy("user_id", F.floor((F.col("k") - 1) / 10).alias("w")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    cv, many = F.stddev_pop("rms") / F.avg("rms"), F.count("*") >= 2
    some = lambda c: F.when(many, r(c)).otherwise(F.lit(0.0))
    return g.groupBy("user_id").agg(F.count("*").alias("windows"), some(cv).alias("rms_cv"), some(1 / (1 + cv)).alias("consistency"))


@query(f"WITH {E} SELECT vec_id, (i // 16)::INTEGER AS long_idx, (i % 16 // 8)::INTEGER AS short_idx, count(*)::INTEGER AS n, round(sum(v), 6) + 0 AS total FROM e GROUP BY ALL")
def two_stage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long windows of 16 samples in short ones of 8, without overlap."""
    s = signals(spark, sf_dir).select("vec_id", F.posexplode(A.windows(F.col("x"), 16, 16)).alias("long_idx", "w"))
    s = s.select("vec_id", "long_idx", F.posexplode(A.windows(F.col("w"), 8, 8)).alias("short_idx", "w"))
    return s.select("vec_id", "long_idx", "short_idx", F.size("w").alias("n"), r(A.total(F.col("w"))).alias("total"))


@query(f"WITH {E}, w AS (SELECT unnest(range(0, 49, 8)) AS s) SELECT vec_id, (s // 8)::INTEGER AS k, round(avg(v), 6) + 0 AS mean FROM e JOIN w ON i >= s AND i < s + 16 GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select("vec_id", F.posexplode(A.overlapping(F.col("x"), 16, 0.5)).alias("k", "w"))
    return s.select("vec_id", "k", r(A.mean(F.col("w"))).alias("mean"))


@query(f"WITH {S}, p AS (SELECT vec_id, n, list_concat(x, list_transform(range(80), lambda k: 0.0::DOUBLE))[1:n] AS y FROM s, (VALUES (50), (80)) t(n)) SELECT vec_id, n::INTEGER AS n, len(y)::INTEGER AS size, round(list_sum(y), 6) + 0 AS total, round(y[n], 6) + 0 AS final FROM p")
def pad_or_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    one = lambda n: s.select("vec_id", F.lit(n).alias("n"), A.fitted(F.col("x"), n).alias("y"))
    return one(50).unionByName(one(80)).select("vec_id", "n", F.size("y").alias("size"), r(A.total(F.col("y"))).alias("total"), r(F.element_at("y", -1)).alias("final"))


@query(f"""
WITH {S}, c AS (SELECT vec_id, 0 AS k, x[1:40] AS y FROM s UNION ALL SELECT vec_id, 1, x[25:64] FROM s UNION ALL SELECT vec_id, 2, list_concat(x, x)[1:100] FROM s
  UNION ALL SELECT vec_id, 3, x[1:24] FROM s UNION ALL SELECT vec_id, 4, x[25:48] FROM s UNION ALL SELECT vec_id, 5, list_concat(x[49:64], [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) FROM s)
SELECT vec_id, k::INTEGER AS k, len(y)::INTEGER AS size, round(list_sum(y), 6) + 0 AS total FROM c
""")
def first_last_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last chunk of long signals, short ones repeated, and tumbling segments with a padded tail."""
    x = F.col("x")
    parts = F.concat(A.first_and_last(x, 40), A.first_and_last(x, 100), A.padded_segments(x, 24))
    s = signals(spark, sf_dir).select("vec_id", F.posexplode(parts).alias("k", "y"))
    return s.select("vec_id", "k", F.size("y").alias("size"), r(A.total(F.col("y"))).alias("total"))


@query(f"WITH {E}, w AS (SELECT unnest(range(0, 54, 5)) AS s) SELECT vec_id, (s // 5)::INTEGER AS k, round(sum(v * v) / 10, 6) AS energy FROM e JOIN w ON i >= s AND i < s + 10 GROUP BY ALL")
def short_time_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(signals(spark, sf_dir), ["vec_id"], A.frame_energy(F.col("x"), 10, 5), "energy", "k")


@query(f"WITH {E} SELECT vec_id, i::INTEGER AS i, round(v - 0.9::DOUBLE * coalesce(lag(v) OVER (PARTITION BY vec_id ORDER BY i), 0), 6) + 0 AS v FROM e")
def prewhiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(signals(spark, sf_dir), ["vec_id"], A.prewhitened(F.col("x")))


@query(f"WITH {E} SELECT vec_id, i::INTEGER AS i, round(v - avg(v) OVER (PARTITION BY vec_id), 6) + 0 AS v FROM e")
def dc_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(signals(spark, sf_dir), ["vec_id"], A.dc_removed(F.col("x")))


@query(f"""
WITH {E}, c AS (SELECT *, v - avg(v) OVER (PARTITION BY vec_id) AS d FROM e)
SELECT vec_id, i::INTEGER AS i, round(d / max(abs(d)) OVER (PARTITION BY vec_id), 6) + 0 AS v, round(v * (0.98::DOUBLE / max(abs(v)) OVER (PARTITION BY vec_id)), 6) + 0 AS w FROM c
""")
def peak_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    s = signals(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(A.peak_normalised(x).alias("v"), A.scaled_to(x).alias("w"))).alias("i", "z"))
    return s.select("vec_id", "i", r(F.col("z.v")).alias("v"), r(F.col("z.w")).alias("w"))


@query(f"WITH {E}, k AS (SELECT *, (vec_id % 11 - 5) AS by FROM e) SELECT a.vec_id, a.i::INTEGER AS i, round(coalesce(b.v, 0), 6) + 0 AS v FROM k a LEFT JOIN k b ON a.vec_id = b.vec_id AND b.i = a.i - a.by")
def shift_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(signals(spark, sf_dir), ["vec_id"], A.shifted(F.col("x"), (F.col("vec_id") % 11 - 5).cast("int")))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a sample; grouping by (label, i) then sums on the map side, whatever the size of a group."""
    return signals(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("i", "v"))


@query(f"WITH {E} SELECT label, i::INTEGER AS i, count(*) AS n, round(avg(v), 6) + 0 AS v, round(10 * log10(count(*)), 6) AS gain_db FROM e GROUP BY label, i")
def stack_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).groupBy("label", "i").agg(F.count("*").alias("n"), r(F.avg("v")).alias("v"), r(10 * F.log10(F.count("*"))).alias("gain_db"))


@query(f"WITH {E}, w AS (SELECT *, pow(10, (vec_id % 30) / 10.0::DOUBLE) AS w FROM e) SELECT label, i::INTEGER AS i, round(sum(w * v) / sum(w), 6) + 0 AS v FROM w GROUP BY label, i")
def stack_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 10^(snr/10)."""
    w = F.pow(F.lit(10.0), F.col("vec_id") % 30 / F.lit(10.0))
    return _samples(spark, sf_dir).withColumn("w", w).groupBy("label", "i").agg(r(F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


@query(f"""
WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY v, vec_id) AS k, count(*) OVER (PARTITION BY label, i) AS n, 1.0::DOUBLE + vec_id % 3 AS w FROM e)
SELECT label, i::INTEGER AS i, round(sum(w * v) / sum(w), 6) + 0 AS v FROM k WHERE k > trunc(n * 0.1) AND k <= n - trunc(n * 0.1) GROUP BY label, i
""")
def stack_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means of each sample without the lowest and highest tenth, ranked sample by sample."""
    by = Window.partitionBy("label", "i")
    s = _samples(spark, sf_dir).withColumn("k", F.row_number().over(by.orderBy("v", "vec_id"))).withColumn("n", F.count("*").over(by)).withColumn("w", F.lit(1.0) + F.col("vec_id") % 3)
    cut = F.floor(F.col("n") * 0.1)
    s = s.filter((F.col("k") > cut) & (F.col("k") <= F.col("n") - cut))
    return s.groupBy("label", "i").agg(r(F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


@query(f"WITH {E} SELECT label, i::INTEGER AS i, round(median(v), 6) + 0 AS v FROM e GROUP BY label, i")
def stack_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).groupBy("label", "i").agg(r(F.percentile("v", F.lit(0.5))).alias("v"))


def _huber_sql(rounds: int) -> str:
    steps = [f"WITH {E}, h0 AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i)"]
    for k in range(rounds):
        steps.append(f"h{k + 1} AS (SELECT e.label, e.i, sum(least(1.0, 0.05::DOUBLE / greatest(abs(v - m), 1e-300)) * v) / sum(least(1.0, 0.05::DOUBLE / greatest(abs(v - m), 1e-300))) AS m FROM e JOIN h{k} h ON e.label = h.label AND e.i = h.i GROUP BY e.label, e.i)")
    return ", ".join(steps) + f" SELECT label, i::INTEGER AS i, round(m, 6) + 0 AS v FROM h{rounds}"


@query(_huber_sql(4))
def stack_huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds of reweighting with delta 0.05; a round is a sum on the map side, whatever the size of a group."""
    s = _samples(spark, sf_dir)
    mean = s.groupBy("label", "i").agg(F.avg("v").alias("m"))
    for _ in range(4):
        w = F.least(F.lit(1.0), 0.05 / F.greatest(F.abs(F.col("v") - F.col("m")), F.lit(1e-300)))
        mean = s.join(mean, ["label", "i"]).withColumn("w", w).groupBy("label", "i").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    return mean.select("label", "i", r(F.col("m")).alias("v"))


@query("""
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), k AS (SELECT least(floor((value - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, value FROM events, b)
SELECT bin, count(*) AS n, round(avg(value), 6) AS mean FROM k GROUP BY bin
""")
def histogram_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty equal bins, the last one closed; the range is one row, sent to all tasks."""
    e = table(spark, sf_dir, "events").select("value")
    b = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bin_ = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19)).cast("int")
    return e.crossJoin(F.broadcast(b)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("""
WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, p, round(value, 6) AS value FROM k, (VALUES (0.25::DOUBLE), (0.5), (0.95)) t(p) WHERE k = floor(p * n) + 1
""")
def percentile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sorted[int(p n)], without interpolation; rows are ranked inside bins of the value."""
    events, bin_ = R.even_bins(table(spark, sf_dir, "events").select("event_type", "value", "event_id"), ["event_type"], "value")
    e = R.ranks(events, ["event_type"], bin_, F.col("value"), F.col("event_id"), rank="k")
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.95)))).alias("p"), "n")
    return e.join(F.broadcast(n), "event_type").filter(F.col("k") == F.floor(F.col("p") * F.col("n")) + 1).select("event_type", "p", r(F.col("value")).alias("value"))


_LINE = "regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS base"


@query(f"""
WITH f AS (SELECT l_returnflag, {_LINE}, avg(l_extendedprice) AS mean FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(any_value(slope), 4) AS slope, round(any_value(base), 4) AS base,
       round(1 - sum(pow(l_extendedprice - base - slope * l_quantity, 2)) / (sum(pow(l_extendedprice - mean, 2)) + 1e-12), 6) AS r2
FROM lineitem JOIN f USING (l_returnflag) GROUP BY l_returnflag
""")
def linear_fit_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and R² of each group from one pass of sums."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base"), F.regr_syy(y, x).alias("yy"), F.regr_sxx(y, x).alias("xx"), F.regr_sxy(y, x).alias("xy")
    )
    left = F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")
    return g.select("l_returnflag", r(F.col("slope"), 4).alias("slope"), r(F.col("base"), 4).alias("base"), r(1 - left / (F.col("yy") + 1e-12)).alias("r2"))


@query("SELECT l_shipmode_proxy AS part, round(corr(l_quantity, l_extendedprice), 6) AS rho FROM (SELECT *, l_partkey % 7 AS l_shipmode_proxy FROM lineitem) GROUP BY 1")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 7).alias("part")).agg(r(F.corr("l_quantity", "l_extendedprice")).alias("rho"))


# Correlation. The SQL works out discrete Fourier transforms and lag sums one by one.

N = 64


def _gcc_sql(size: int, weight: str, low: int, high: int) -> str:
    """CTEs up to c(pair_id, lag, v)."""
    over = {"none": "1", "phat": "(sqrt(re * re + im * im) + 1e-10)", "roth": "(pa + 1e-10)", "scot": "(sqrt(pa * pb) + 1e-10)"}[weight]
    return f"""{E},
f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * ((k * i) % {size}) / {size})) AS re, -sum(v * sin(2 * pi() * ((k * i) % {size}) / {size})) AS im FROM e, (SELECT unnest(range({size})) AS k) GROUP BY vec_id, k),
g AS (SELECT a.vec_id // 2 AS pair_id, a.k, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, a.re * a.re + a.im * a.im AS pa, b.re * b.re + b.im * b.im AS pb
      FROM f a JOIN f b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 AND a.k = b.k),
w AS (SELECT pair_id, k, re / {over} AS re, im / {over} AS im FROM g),
c AS (SELECT pair_id, lag, sum(re * cos(2 * pi() * ((k * lag) % {size}) / {size}) - im * sin(2 * pi() * ((k * lag) % {size}) / {size})) / {size} AS v
      FROM w, (SELECT unnest(range({low}, {high} + 1)) AS lag) GROUP BY pair_id, lag)"""


_FULL = f"""{E}, c AS (SELECT a.vec_id // 2 AS pair_id, a.i - b.i AS lag, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 GROUP BY ALL)"""


def correlated(spark: SparkSession, sf_dir: str, kernel, lag0: int) -> DataFrame:
    """pair_id, label, lag0, c."""
    return pairs(spark, sf_dir).select("pair_id", "label", F.lit(lag0).alias("lag0"), array_kernel(kernel, F.col("a"), F.col("b")).alias("c"))


def _lags(df: DataFrame) -> DataFrame:
    out = df.select("pair_id", "lag0", F.posexplode("c").alias("i", "v"))
    return out.select("pair_id", (F.col("i") + F.col("lag0")).cast("int").alias("lag"), r(F.col("v")).alias("v"))


@query(f"""
WITH {_FULL}, d AS (SELECT vec_id, stddev_pop(v) AS sd FROM e GROUP BY vec_id)
SELECT pair_id, lag::INTEGER AS lag, round(c.v / (a.sd * b.sd * 64), 6) + 0 AS v FROM c JOIN d a ON a.vec_id = 2 * pair_id JOIN d b ON b.vec_id = 2 * pair_id + 1
""")
def xcorr_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(correlated(spark, sf_dir, dsp.cross_basic, 1 - N))


@query(f"WITH {_FULL} SELECT pair_id, lag::INTEGER AS lag, round(v, 6) + 0 AS v FROM c WHERE lag BETWEEN -32 AND 31")
def xcorr_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(correlated(spark, sf_dir, dsp.cross_same, -N // 2))


@query(f"WITH {_FULL} SELECT pair_id, lag::INTEGER AS lag, round(v / (max(abs(v)) OVER (PARTITION BY pair_id) + 1e-10), 6) + 0 AS v FROM c")
def xcorr_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(correlated(spark, sf_dir, dsp.cross_normalised, 1 - N))


def _circular(name: str, weight: str) -> None:
    @query(f"WITH {_gcc_sql(N, weight, -32, 31)} SELECT pair_id, lag::INTEGER AS lag, round(v, 6) + 0 AS v FROM c", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lags(correlated(spark, sf_dir, lambda a, b: dsp.gcc_circular(a, b, weight), -N // 2))


for _name, _weight in (("xcorr_circular", "none"), ("gcc_phat_circular", "phat"), ("gcc_roth", "roth"), ("gcc_scot", "scot")):
    _circular(_name, _weight)

_PHAT = _gcc_sql(128, "phat", 1 - N, N - 1)


def phat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlated(spark, sf_dir, dsp.gcc, 1 - N)


@query(f"WITH {_PHAT} SELECT pair_id, lag::INTEGER AS lag, round(v, 6) + 0 AS v FROM c")
def gcc_phat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(phat(spark, sf_dir))


_PEAK = f"""{_PHAT}, m AS (SELECT pair_id, arg_max(lag, (v, -lag)) AS lag, max(v) AS height FROM c GROUP BY pair_id),
n AS (SELECT m.pair_id, m.lag, m.height, a.v AS before, b.v AS after FROM m LEFT JOIN c a ON a.pair_id = m.pair_id AND a.lag = m.lag - 1 LEFT JOIN c b ON b.pair_id = m.pair_id AND b.lag = m.lag + 1),
t AS (SELECT pair_id, avg(v * v) AS tail FROM c WHERE lag < -63 + 31 OR lag > 63 - 31 GROUP BY pair_id),
o AS (SELECT c.pair_id, max(abs(v)) AS other FROM c JOIN m ON m.pair_id = c.pair_id AND abs(c.lag - m.lag) > 4 GROUP BY c.pair_id),
q AS (SELECT n.*, 10 * log10(height * height / (tail + 1e-10)) AS snr, abs(height) / other AS sharp,
             CASE WHEN before IS NULL OR after IS NULL OR abs(2 * (2 * height - before - after)) < 1e-10 THEN 0 ELSE (after - before) / (2 * (2 * height - before - after)) END AS parabolic
      FROM n JOIN t USING (pair_id) JOIN o USING (pair_id))"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak of each pair with everything an estimate says of it."""
    c, k = F.col("c"), F.col("k")
    p = phat(spark, sf_dir).withColumn("k", A.argmax(c)).withColumn("height", F.array_max(c))
    p = p.withColumns({"lag": (F.col("lag0") + k).cast("int"), "snr": A.peak_snr_db(c, F.col("height")), "sharp": A.sharpness(c, k, 4), "parabolic": A.parabolic_offset(c, k), "gaussian": A.gaussian_offset(c, k)})
    return p.withColumn("conf", P.confidence(F.col("height"), F.col("snr"), F.col("sharp")))


@query(f"WITH {_PEAK} SELECT pair_id, lag::INTEGER AS lag, round(height, 6) AS height FROM m")
def delay_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks(spark, sf_dir).select("pair_id", "lag", r(F.col("height")).alias("height"))


@query(f"WITH {_PEAK} SELECT pair_id, round(-(lag + parabolic) / 4096, 8) + 0 AS delay_s FROM q")
def delay_parabolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay t_B - t_A is minus the refined lag."""
    return peaks(spark, sf_dir).select("pair_id", r(-(F.col("lag") + F.col("parabolic")) / 4096, 8).alias("delay_s"))


@query(f"""
WITH {_PEAK}, l AS (SELECT pair_id, lag, ln(greatest(abs(height), 1e-10)) AS h, ln(greatest(abs(before), 1e-10)) AS b, ln(greatest(abs(after), 1e-10)) AS a, before IS NULL OR after IS NULL AS edge FROM q)
SELECT pair_id, round(-(lag + CASE WHEN edge OR abs(2 * (2 * h - b - a)) < 1e-10 THEN 0 ELSE (a - b) / (2 * (2 * h - b - a)) END) / 4096, 8) + 0 AS delay_s FROM l
""")
def delay_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks(spark, sf_dir).select("pair_id", r(-(F.col("lag") + F.col("gaussian")) / 4096, 8).alias("delay_s"))


@query(kernel_sql.spline_delay(_PHAT))
def delay_sinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay from a cubic spline ten times as fine around the peak."""
    p = peaks(spark, sf_dir)
    at = array_kernel(lambda c: np.array([[dsp.spline_peak(x, int(x.argmax()))] for x in c]), F.col("c"))[0]
    return p.select("pair_id", r(-(F.col("lag0") + at) / 4096, 8).alias("delay_s"))


_CONF = "(0.3::DOUBLE * least(greatest(abs(height), 0.0), 1.0) + 0.4::DOUBLE * least(greatest(snr / 30, 0.0), 1.0) + 0.3::DOUBLE * least(greatest((sharp - 1) / 9, 0.0), 1.0))"


@query(f"WITH {_PEAK} SELECT pair_id, round(snr, 5) AS snr_db, round(sharp, 5) AS sharpness, round({_CONF}, 5) AS confidence FROM q")
def delay_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNR, sharpness and confidence of the peak."""
    return peaks(spark, sf_dir).select("pair_id", r(F.col("snr"), 5).alias("snr_db"), r(F.col("sharp"), 5).alias("sharpness"), r(F.col("conf"), 5).alias("confidence"))


@query(f"""
WITH {_PEAK}, z AS (SELECT *, {_CONF} AS conf, -(lag + parabolic) / 4096 * 500 AS delay FROM q)
SELECT CASE WHEN abs(delay) > 5 THEN 'delay' WHEN conf < 0.7 THEN 'confidence' WHEN snr < 10 THEN 'snr' WHEN sharp < 1.5 THEN 'sharpness' ELSE 'valid' END AS message,
       CASE WHEN conf > 0.8 THEN 'high' WHEN conf > 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM z GROUP BY ALL
""")
def estimate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many estimates break which rule first; delays are stretched by 500."""
    delay = -(F.col("lag") + F.col("parabolic")) / 4096 * 500
    return peaks(spark, sf_dir).groupBy(P.estimate_message(delay, F.col("conf"), F.col("snr"), F.col("sharp")).alias("message"), P.confidence_band(F.col("conf")).alias("band")).agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE {_PHAT}, mx AS (SELECT pair_id, max(abs(v)) AS top FROM c GROUP BY pair_id), tl AS (SELECT pair_id, avg(v * v) AS tail FROM c WHERE lag < -63 + 31 OR lag > 63 - 31 GROUP BY pair_id),
nb AS (SELECT pair_id, lag, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM c WINDOW w AS (PARTITION BY pair_id ORDER BY lag)),
cand AS (SELECT pair_id, list({{'v': v, 'spot': lag}} ORDER BY v DESC) AS rest FROM nb JOIN mx USING (pair_id) WHERE v > b AND v > a AND v >= 0.3 * top GROUP BY pair_id),
pick AS (SELECT pair_id, 0 AS k, []::BIGINT[] AS picks, rest FROM cand UNION ALL SELECT pair_id, k + 1, list_append(picks, rest[1].spot), list_filter(rest, lambda z: abs(z.spot - rest[1].spot) >= 4) FROM pick WHERE k < 5 AND len(rest) > 0),
l AS (SELECT pair_id, unnest(arg_max(picks, k)) AS spot FROM pick GROUP BY pair_id),
q AS (SELECT l.pair_id, l.spot, max(c.v) FILTER (c.lag = l.spot) AS height, max(abs(c.v)) FILTER (abs(c.lag - l.spot) > 4) AS other FROM l JOIN c USING (pair_id) GROUP BY l.pair_id, l.spot),
z AS (SELECT pair_id, spot, round(height, 6) AS height, round(0.3::DOUBLE * least(greatest(abs(height), 0.0), 1.0) + 0.4::DOUBLE * least(greatest(10 * log10(height * height / (tail + 1e-10)) / 30, 0.0), 1.0) + 0.3::DOUBLE * least(greatest((abs(height) / other - 1) / 9, 0.0), 1.0), 6) AS conf FROM q JOIN tl USING (pair_id))
SELECT pair_id, spot::INTEGER AS lag, height, conf, (row_number() OVER (PARTITION BY pair_id ORDER BY conf DESC, spot))::INTEGER AS place FROM z
""")
def multi_peak_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five peaks of each pair, four lags apart, by confidence."""

    def top(c: np.ndarray) -> np.ndarray:
        out = np.full((len(c), 5), -1.0)
        for row, x in zip(out, c, strict=True):
            at = dsp.find_peaks(x, 0.3 * np.abs(x).max(), 4)
            at = at[np.argsort(-x[at], kind="stable")[:5]]
            row[: len(at)] = at
        return out

    p = phat(spark, sf_dir).select("pair_id", "lag0", "c", F.explode(F.filter(array_kernel(top, F.col("c")), lambda v: v >= 0)).alias("k")).withColumn("k", F.col("k").cast("int"))
    height = F.element_at("c", F.col("k") + 1)
    conf = P.confidence(height, A.peak_snr_db(F.col("c"), height), A.sharpness(F.col("c"), F.col("k"), 4))
    p = p.select("pair_id", (F.col("lag0") + F.col("k")).alias("lag"), r(height).alias("height"), r(conf).alias("conf"))
    return R.first_by(p, ["pair_id"], F.desc("conf"), F.col("lag"), n=5, rank="place")


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id and the circular correlation by four methods."""
    kinds = ("none", "phat", "roth", "scot")
    found = lambda a, b: {w: dsp.gcc_circular(a, b, w) for w in kinds}
    m = pairs(spark, sf_dir).select("pair_id", struct_kernel(found, ", ".join(f"{w}: array<double>" for w in kinds), F.col("a"), F.col("b")).alias("m"))
    return m.select("pair_id", *[F.col(f"m.{w}").alias(w) for w in kinds])


_METHODS = f"""{E},
f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, -sum(v * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM e, (SELECT unnest(range(64)) AS k) GROUP BY vec_id, k),
g AS (SELECT a.vec_id // 2 AS pair_id, a.k, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, a.re * a.re + a.im * a.im AS pa, b.re * b.re + b.im * b.im AS pb FROM f a JOIN f b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 AND a.k = b.k),
w AS (SELECT pair_id, k, method, CASE method WHEN 0 THEN 1.0 WHEN 1 THEN sqrt(re * re + im * im) + 1e-10 WHEN 2 THEN pa + 1e-10 ELSE sqrt(pa * pb) + 1e-10 END AS d, re, im FROM g, (SELECT unnest(range(4)) AS method)),
c AS (SELECT pair_id, method, lag, sum(re / d * cos(2 * pi() * ((k * lag) % 64) / 64) - im / d * sin(2 * pi() * ((k * lag) % 64) / 64)) / 64 AS v FROM w, (SELECT unnest(range(-32, 32)) AS lag) GROUP BY pair_id, method, lag),
p AS (SELECT pair_id, method, arg_max(lag, (round(abs(v), 9), -lag)) AS lag, max(abs(v)) / (avg(abs(v)) + 1e-12) AS snr FROM c GROUP BY pair_id, method)"""
_KINDS = ("none", "phat", "roth", "scot")


@query(f"WITH {_METHODS} SELECT pair_id, lag::INTEGER AS lag, round(avg(v), 6) + 0 AS v FROM c GROUP BY pair_id, lag")
def fuse_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = methods(spark, sf_dir)
    out = m.select("pair_id", F.lit(-32).alias("lag0"), F.transform(F.arrays_zip(*_KINDS), lambda z: (z["none"] + z["phat"] + z["roth"] + z["scot"]) / 4).alias("c"))
    return _lags(out)


def _level(c: Column) -> Column:
    return A.peak(c) / (A.mean(F.transform(c, F.abs)) + 1e-12)


def _peak_lag(c: Column) -> Column:
    """Lag of the greatest magnitude; magnitudes count as equal at nine decimals."""
    return A.argmax(F.transform(c, lambda v: F.round(F.abs(v), 9))) - 32


@query(f"WITH {_METHODS} SELECT pair_id, arg_max(method, (round(snr, 9), -method))::INTEGER AS method, round(max(snr), 5) AS snr FROM p GROUP BY pair_id")
def fuse_best_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = [F.struct(F.round(_level(F.col(w)), 9).alias("snr"), F.lit(-i).alias("m")) for i, w in enumerate(_KINDS)]
    best = methods(spark, sf_dir).select("pair_id", F.greatest(*ranked).alias("b"))
    return best.select("pair_id", (-F.col("b.m")).alias("method"), r(F.col("b.snr"), 5).alias("snr"))


@query(f"""
WITH {_METHODS}, m AS (SELECT pair_id, trunc(median(lag + 32))::INTEGER AS middle FROM p GROUP BY pair_id)
SELECT pair_id, any_value(middle - 32)::INTEGER AS median_lag, arg_min(lag, abs(lag + 32 - middle) * 10 + method)::INTEGER AS lag FROM p JOIN m USING (pair_id) GROUP BY pair_id
""")
def fuse_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method whose peak is nearest to the median of all peaks; the first of equal ones."""
    m = methods(spark, sf_dir).select("pair_id", F.array(*[_peak_lag(F.col(w)) + 32 for w in _KINDS]).alias("at"))
    m = m.withColumn("middle", A.median(F.transform("at", lambda v: v.cast("double"))).cast("int"))
    near = F.array_min(F.transform("at", lambda v, i: F.struct((F.abs(v - F.col("middle")) * 10 + i).alias("far"), v.alias("v"))))
    return m.select("pair_id", (F.col("middle") - 32).alias("median_lag"), (near["v"] - 32).cast("int").alias("lag"))


@query(f"""
WITH {_PHAT}, m AS (SELECT pair_id, arg_max(lag, (v, -lag)) AS p, max(v) AS h FROM c GROUP BY pair_id),
ps AS (SELECT m.pair_id, any_value(p) AS p, any_value(h) AS h, coalesce(max(abs(v)) FILTER ((lag - p >= -20 AND lag - p < -10) OR (lag - p >= 10 AND lag - p < 20)), 0) AS side, any_value(v) FILTER (lag = p - 1) AS b, any_value(v) FILTER (lag = p + 1) AS a FROM m JOIN c USING (pair_id) GROUP BY m.pair_id)
SELECT pair_id, round(0.6 * tanh(abs(h) / (side + 1e-12) / 3) + 0.4 * coalesce(tanh(10 * abs(h - 0.5 * (a + b))), 0.5), 6) AS stability FROM ps
""")
def peak_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phat(spark, sf_dir).select("pair_id", r(A.peak_stability(F.col("c"), A.argmax(F.col("c")), 10)).alias("stability"))


@query(f"WITH {_METHODS} SELECT pair_id, round(exp(-var_pop(lag) / 25), 6) AS alignment FROM p GROUP BY pair_id")
def band_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the peaks of several correlations of a pair agree."""
    m = methods(spark, sf_dir).select("pair_id", F.array(*[_peak_lag(F.col(w)).cast("double") for w in _KINDS]).alias("at"))
    return m.select("pair_id", r(F.exp(-A.moment(F.col("at"), 2) / 25)).alias("alignment"))


# Spectra of one 64-sample segment.

_SPEC = f"""{E},
d AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM e),
f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, sum(v * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM d, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k),
p AS (SELECT vec_id, k, k * 64.0::DOUBLE AS hz, (re * re + im * im) / (4096 * 24.0) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM f)"""


@query(f"WITH {_SPEC} SELECT vec_id, k::INTEGER AS k, round(p * 1e6, 5) AS micro FROM p")
def spectrum_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch density in millionths."""
    s = signals(spark, sf_dir).select("vec_id", F.posexplode(array_kernel(lambda x: dsp.welch(x, 4096.0, 64)[1], F.col("x"))).alias("k", "p"))
    return s.select("vec_id", "k", r(F.col("p") * 1e6, 5).alias("micro"))


_FEATURES = f"""{_SPEC}, t AS (SELECT vec_id, sum(p) AS total FROM p GROUP BY vec_id),
q AS (SELECT vec_id, k, hz, p, total, p / (total + 1e-12) + 1e-12 AS w FROM p JOIN t USING (vec_id)),
z AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS u FROM q),
features AS (SELECT vec_id, -sum(u * ln(u)) AS entropy, arg_max(hz, p) AS dominant_hz, sum(p) FILTER (hz BETWEEN 100 AND 1500) / (any_value(total) + 1e-12) AS band_ratio, sum(p * hz) / (any_value(total) + 1e-12) AS centroid_hz FROM z GROUP BY vec_id)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Welch density a signal gives all features."""
    fields = "entropy: double, dominant_hz: double, dominant_power: double, band_ratio: double, centroid_hz: double"
    s = signals(spark, sf_dir).select("vec_id", "label", "x", struct_kernel(lambda x: dsp.spectral_features(x, 4096.0), fields, F.col("x")).alias("f"))
    return s.select("vec_id", "label", "x", "f.*")


@query(f"WITH {_FEATURES} SELECT vec_id, round(entropy, 6) AS entropy, dominant_hz, round(band_ratio, 6) AS band_ratio, round(centroid_hz, 4) AS centroid_hz FROM features")
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral entropy, dominant frequency, band power share and centroid."""
    return features(spark, sf_dir).select("vec_id", r(F.col("entropy")).alias("entropy"), "dominant_hz", r(F.col("band_ratio")).alias("band_ratio"), r(F.col("centroid_hz"), 4).alias("centroid_hz"))


@query(f"""
WITH {_FEATURES}, m AS (SELECT vec_id, avg(v) AS mean FROM e GROUP BY vec_id),
k AS (SELECT e.vec_id, avg(pow(v - mean, 4)) / pow(avg(pow(v - mean, 2)), 2) - 3 AS kurtosis, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak, abs(any_value(mean)) AS dc FROM e JOIN m USING (vec_id) GROUP BY e.vec_id),
j AS (SELECT *, CASE WHEN band_ratio > 0.35 THEN 0.3 ELSE 0 END + CASE WHEN kurtosis > 2 THEN 0.2 ELSE 0 END + CASE WHEN dominant_hz BETWEEN 100 AND 1500 THEN 0.15 ELSE 0 END + CASE WHEN entropy < 8 THEN 0.1 ELSE 0 END + CASE WHEN rms > 0.1 THEN 0.1 ELSE 0 END AS score,
             CASE WHEN peak > 0.95 THEN 0.5 ELSE 1 END * CASE WHEN rms < 0.01 THEN 0.6 ELSE 1 END * CASE WHEN dc > 0.1 THEN 0.8 ELSE 1 END * CASE WHEN kurtosis > 20 THEN 0.7 ELSE 1 END AS quality FROM features JOIN k USING (vec_id))
SELECT vec_id, round(score::DOUBLE * CASE WHEN quality < 0.5 THEN 0.5 ELSE 1 END, 6) AS confidence, round(quality::DOUBLE, 6) AS quality, (score >= 0.3 AND score * CASE WHEN quality < 0.5 THEN 0.5 ELSE 1 END >= 0.5) AS detected,
       concat_ws('; ', CASE WHEN band_ratio > 0.35 THEN 'band power' END, CASE WHEN kurtosis > 2 THEN 'impulsive' END, CASE WHEN dominant_hz BETWEEN 100 AND 1500 THEN 'dominant in band' END, CASE WHEN entropy < 8 THEN 'tonal' END, CASE WHEN rms > 0.1 THEN 'loud' END) AS reason
FROM j
""")
def single_sensor_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive rules without a baseline, the quality score, and why."""
    x = F.col("x")
    f = features(spark, sf_dir).withColumns({"kurtosis": A.excess_kurtosis(x), "rms": A.rms(x), "peak": A.peak(x), "dc": F.abs(A.mean(x))})
    rules = [("band power", F.col("band_ratio") > 0.35, 0.3), ("impulsive", F.col("kurtosis") > 2, 0.2), ("dominant in band", F.col("dominant_hz").between(100, 1500), 0.15), ("tonal", F.col("entropy") < 8, 0.1), ("loud", F.col("rms") > 0.1, 0.1)]
    score = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for _, c, w in rules), F.lit(0.0))
    factor = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(1.0))
    f = f.withColumn("quality", factor(F.col("peak") > 0.95, 0.5) * factor(F.col("rms") < 0.01, 0.6) * factor(F.col("dc") > 0.1, 0.8) * factor(F.col("kurtosis") > 20, 0.7))
    f = f.withColumn("score", F.round(score, 9)).withColumn("conf", F.col("score") * factor(F.col("quality") < 0.5, 0.5))
    return f.select("vec_id", r(F.col("conf")).alias("confidence"), r(F.col("quality")).alias("quality"), ((F.col("score") >= 0.3) & (F.col("conf") >= 0.5)).alias("detected"), F.concat_ws("; ", *[F.when(c, F.lit(n)) for n, c, _ in rules]).alias("reason"))


@query(f"""
WITH {E}, g AS (SELECT vec_id, i, abs(v) AS c, abs(v) > 0.1 AS over FROM e), z AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS run FROM g WHERE over),
b AS (SELECT vec_id, min(i) * 64 AS lo, max(i) * 64 AS hi, avg(c) AS mean FROM z GROUP BY vec_id, run), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(mean, 9) DESC, lo DESC) AS place FROM b WHERE hi - lo >= 50)
SELECT vec_id, lo, hi, round(mean, 6) AS mean, place::INTEGER AS place FROM k WHERE place <= 5
""")
def coherent_band_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous bands over a floor, 50 Hz wide at least, the five strongest; bins are 64 Hz."""
    e = _samples(spark, sf_dir).withColumn("c", F.abs("v"))
    runs = R.runs(e, ["vec_id"], ["i"], F.col("c") > 0.1)
    inside = e.filter("c > 0.1").join(runs, "vec_id").filter(F.col("i").between(F.col("first_place") - 1, F.col("last_place") - 1))
    b = inside.groupBy("vec_id", "run_id", "first_place", "last_place").agg(F.avg("c").alias("mean"))
    b = b.select("vec_id", ((F.col("first_place") - 1) * 64).cast("long").alias("lo"), ((F.col("last_place") - 1) * 64).cast("long").alias("hi"), F.col("mean")).filter("hi - lo >= 50")
    b = R.first_by(b.withColumn("_m", F.round("mean", 9)), ["vec_id"], F.desc("_m"), F.desc("lo"), n=5, rank="place").drop("_m")
    return b.withColumn("mean", r(F.col("mean")))


# Positions from correlation functions.

_GRID_X, _LENGTH, _SPEED = 0.5, 20.0, 1400.0


@query(f"""
WITH {_PHAT}, x AS (SELECT k * 0.5::DOUBLE AS x FROM (SELECT unnest(range(41)) AS k)), v AS (SELECT 200.0::DOUBLE + 50 * k AS v FROM (SELECT unnest(range(117)) AS k)),
grid AS (SELECT x, v, -trunc((20 - 2 * x) / v * 4096)::INTEGER AS lag FROM x, v), l AS (SELECT DISTINCT lag FROM grid),
gs AS (SELECT p.pair_id, l.lag, coalesce(c.v, 0) AS score FROM (SELECT DISTINCT pair_id FROM c) p CROSS JOIN l LEFT JOIN c ON c.pair_id = p.pair_id AND c.lag = l.lag),
m AS (SELECT pair_id, max(score) AS best FROM gs GROUP BY pair_id), h AS (SELECT pair_id, max(abs(v)) AS top FROM c GROUP BY pair_id),
win AS (SELECT s.pair_id, min((g.x, g.v)) AS spot, any_value(best) AS best FROM gs s JOIN m ON m.pair_id = s.pair_id AND s.score = m.best JOIN grid g ON g.lag = s.lag GROUP BY s.pair_id)
SELECT pair_id, spot[1] AS x, spot[2] AS speed, round(best, 6) AS score, round(best / (top + 1e-10), 6) AS confidence FROM (SELECT pair_id, [struct_extract(spot, 1), struct_extract(spot, 2)] AS spot, best FROM win) JOIN h USING (pair_id)
""")
def joint_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best position and speed of each pair over the whole grid, worked out inside the row: no cells are shuffled."""
    found = lambda c: dict(zip(("x", "speed", "score", "confidence"), np.array([dsp.joint_search(row, 1 - N, _LENGTH, 4096.0, _GRID_X) for row in c]).T, strict=True))
    p = phat(spark, sf_dir).select("pair_id", struct_kernel(found, "x: double, speed: double, score: double, confidence: double", F.col("c")).alias("j"))
    return p.select("pair_id", "j.x", "j.speed", r(F.col("j.score")).alias("score"), r(F.col("j.confidence")).alias("confidence"))


@query("""
WITH f AS (SELECT user_id, event_type, avg(value) AS c, CASE event_type WHEN 'click' THEN 225 WHEN 'view' THEN 600 WHEN 'purchase' THEN 1150 ELSE 800 END::DOUBLE AS hz FROM events GROUP BY user_id, event_type),
l AS (SELECT user_id, regr_slope(c, hz) AS alpha, regr_intercept(c, hz) AS c0, avg(c) AS mean, count(*) AS n FROM f GROUP BY user_id HAVING regr_sxx(c, hz) > 0)
SELECT user_id, round(any_value(alpha), 6) AS alpha, round(any_value(c0), 4) AS c0, round(1 - sum(pow(c - c0 - alpha * hz, 2)) / (sum(pow(c - mean, 2)) + 1e-12), 5) AS r2 FROM f JOIN l USING (user_id) GROUP BY user_id
""")
def dispersion_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed against frequency of each sensor: c = c0 + alpha f, from per-band means."""
    t = F.col("event_type")
    hz = F.when(t == "click", F.lit(225.0)).when(t == "view", F.lit(600.0)).when(t == "purchase", F.lit(1150.0)).otherwise(F.lit(800.0))
    f = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("c")).withColumn("hz", hz)
    g = f.groupBy("user_id").agg(*[getattr(F, f"regr_{n}")("c", "hz").alias(n) for n in ("slope", "intercept", "syy", "sxx", "sxy")]).filter("sxx > 0")
    left = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    return g.select("user_id", r(F.col("slope")).alias("alpha"), r(F.col("intercept"), 4).alias("c0"), r(1 - left / (F.col("syy") + 1e-12), 5).alias("r2"))


_POST = f"""{_PHAT}, lim AS (SELECT pair_id, min(v) AS lo, max(v) AS hi FROM c GROUP BY pair_id),
x AS (SELECT k, k * 0.5::DOUBLE AS x, -trunc((20 - 2 * (k * 0.5::DOUBLE)) / 1400 * 4096)::INTEGER AS lag FROM (SELECT unnest(range(41)) AS k)),
like_ AS (SELECT l.pair_id, x.k, x.x, CASE WHEN c.v IS NULL THEN 1e-10 ELSE exp(5 * (c.v - lo) / (hi - lo + 1e-12)) END AS l, exp(-pow(x.x - 10, 2) / 5000) AS prior FROM lim l CROSS JOIN x LEFT JOIN c ON c.pair_id = l.pair_id AND c.lag = x.lag),
post AS (SELECT pair_id, k, x, l * prior / sum(l * prior) OVER (PARTITION BY pair_id) AS p FROM like_)"""


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id and the posterior over positions as an array: Gaussian prior at the middle, likelihood exp(5 r)."""
    c, n = F.col("c"), int(_LENGTH / _GRID_X) + 1

    def cell(k: Column, z: Column) -> Column:
        x = k * _GRID_X
        at = (-((F.lit(_LENGTH) - 2 * x) / _SPEED * 4096).cast("int") + (N - 1)).cast("int")
        like = F.when((at >= 0) & (at < 2 * N - 1), F.exp(5 * (F.try_element_at(c, at + 1) - z["lo"]) / (z["hi"] - z["lo"] + 1e-12))).otherwise(F.lit(1e-10))
        return like * F.exp(-F.pow(x - _LENGTH / 2, F.lit(2)) / 5000)

    raw = A.let(F.struct(F.array_min(c).alias("lo"), F.array_max(c).alias("hi")), lambda z: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: cell(k, z)))
    shares = A.let(raw, lambda w: A.let(A.total(w), lambda s: F.transform(w, lambda v: v / s)))
    return phat(spark, sf_dir).select("pair_id", shares.alias("p"))


@query(f"WITH {_POST} SELECT pair_id, k::INTEGER AS k, round(p, 7) AS p FROM post")
def bayes_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = posterior(spark, sf_dir).select("pair_id", F.posexplode("p").alias("k", "p"))
    return s.select("pair_id", "k", r(F.col("p"), 7).alias("p"))


@query(f"""
WITH {_POST}, hp AS (SELECT *, sum(p) OVER (PARTITION BY pair_id ORDER BY round(p, 12) DESC, k ROWS UNBOUNDED PRECEDING) - p AS before FROM post)
SELECT pair_id, arg_max(x, (round(p, 12), -k)) AS map_x, min(x) FILTER (before < 0.95) AS lo, max(x) FILTER (before < 0.95) AS hi, round(-sum(p * ln(p + 1e-12)), 5) AS entropy,
       round(1 / (1 - sum(p * ln(p + 1e-12))), 5) AS confidence, round(1 + sum(p * ln(p + 1e-12)) / ln(41), 5) AS certainty FROM hp GROUP BY pair_id
""")
def bayes_map_hpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most probable position, smallest set with 95 %, entropy and both confidences, without leaving the row."""
    p = F.col("p")
    ranked = F.array_sort(F.transform(p, lambda v, i: F.struct((-F.round(v, 12)).alias("d"), i.alias("k"), v.alias("p"))))
    taken = F.aggregate(
        "ranked", F.struct(F.lit(0.0).alias("sum"), F.lit(1 << 30).alias("lo"), F.lit(-1).alias("hi")),
        lambda a, z: F.when(a["sum"] < 0.95, F.struct((a["sum"] + z["p"]).alias("sum"), F.least(a["lo"], z["k"]).alias("lo"), F.greatest(a["hi"], z["k"]).alias("hi"))).otherwise(a),
    )
    h = -A.total(F.transform(p, lambda v: v * F.log(v + 1e-12)))
    s = posterior(spark, sf_dir).withColumn("ranked", ranked).withColumn("t", taken).withColumn("h", h)
    x = lambda k: k * F.lit(_GRID_X)
    return s.select("pair_id", x(F.col("ranked")[0]["k"]).alias("map_x"), x(F.col("t.lo")).alias("lo"), x(F.col("t.hi")).alias("hi"), r(F.col("h"), 5).alias("entropy"), r(1 / (1 + F.col("h")), 5).alias("confidence"), r(1 - F.col("h") / math.log(41), 5).alias("certainty"))


@query(f"""
WITH {E}, w AS (SELECT vec_id, s // 8 AS k, sqrt(avg(v * v)) AS rms FROM e JOIN (SELECT unnest(range(0, 49, 8)) AS s) ON i >= s AND i < s + 16 GROUP BY vec_id, s),
p AS (SELECT *, CASE WHEN rms > 0.1 THEN least(0.9, 2 * rms) ELSE 0.3 END AS p, (rms - min(rms) OVER o) / (max(rms) OVER o - min(rms) OVER o + 1e-12) AS snr FROM w WINDOW o AS (PARTITION BY vec_id)),
u AS (SELECT *, sqrt(p) * pow(snr, 0.3) AS u FROM p)
SELECT vec_id, k::INTEGER AS k, round(p, 6) AS p, round(CASE WHEN sum(u) OVER o < 1e-10 THEN 1.0 / count(*) OVER o ELSE u / sum(u) OVER o END, 6) AS weight FROM u WINDOW o AS (PARTITION BY vec_id)
""")
def window_gating_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic probability of windows and their weights p^0.5 snr^0.3; levels stand in for SNR."""
    s = gates(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("chances", "weights")).alias("k", "z"))
    return s.select("vec_id", "k", r(F.col("z.chances")).alias("p"), r(F.col("z.weights")).alias("weight"))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, chances and weights of the windows; equal weights where none has any."""
    s = signals(spark, sf_dir).select("vec_id", F.transform(A.overlapping(F.col("x"), 16, 0.5), A.rms).alias("w"))
    chance = lambda v: F.when(v > 0.1, F.least(F.lit(0.9), 2 * v)).otherwise(F.lit(0.3))
    level = lambda v, m: F.pow((v - m["lo"]) / (m["hi"] - m["lo"] + 1e-12), F.lit(0.3))
    limits = F.struct(F.array_min("w").alias("lo"), F.array_max("w").alias("hi"))
    s = s.withColumn("u", A.let(limits, lambda m: F.transform("w", lambda v: F.sqrt(chance(v)) * level(v, m))))
    weights = A.let(A.total(F.col("u")), lambda t: F.transform("u", lambda v: F.when(t < 1e-10, 1 / F.size("u")).otherwise(v / t)))
    return s.select("vec_id", F.transform("w", chance).alias("chances"), weights.alias("weights"))
