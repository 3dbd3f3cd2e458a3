"""Decisions, votes, sweeps, splits, triangulation, reports and ingest queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoline.functions import dsp
from echoline.functions import physics as P
from echoline.operators import meetings
from echoline.operators import relational as R
from echoline.plans import kernel_sql, network
from echoline.plans.registry import query, table

r = P.rounded

# File-level decisions. A file is a vector; its longs are the samples in eights; a probability is a logistic of a sample.

_PROB = """pr AS (SELECT vec_id AS file, label, (i // 8) AS long_idx, i % 8 AS short_idx, 1 / (1 + exp(-8 * v)) AS p FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
lg AS (SELECT file, label, long_idx, avg(p) AS p FROM pr GROUP BY file, label, long_idx)"""


def longs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability of each long segment."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file"), "label", F.posexplode("embedding").alias("i", "v"))
    p = 1 / (1 + F.exp(-8 * F.col("v").cast("double")))
    return e.groupBy("file", "label", F.floor(F.col("i") / 8).alias("long_idx")).agg(F.avg(p).alias("p"))


@query(f"""
WITH {_PROB} SELECT file, label % 2 = 0 AS truth, count_if(p >= 0.5)::INTEGER AS hits, count(*)::INTEGER AS longs, count_if(p >= 0.5) >= (count(*) + 1) // 2 AS leak, round(avg(p), 6) AS mean_p FROM lg GROUP BY file, label
""")
def file_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is a leak if half of its long segments, rounded up, are."""
    hits = F.count_if(F.col("p") >= 0.5).cast("int")
    g = longs(spark, sf_dir).groupBy("file", "label").agg(hits.alias("hits"), F.count("*").cast("int").alias("longs"), F.avg("p").alias("mean_p"))
    return g.select("file", (F.col("label") % 2 == 0).alias("truth"), "hits", "longs", (F.col("hits") >= P.ceiling_half(F.col("longs"))).alias("leak"), r(F.col("mean_p")).alias("mean_p"))


@query(f"""
WITH {_PROB} SELECT file, avg(p) >= 0.35 AS by_mean, count_if(p >= 0.35) / count(*)::DOUBLE >= 0.5 AS long_vote, max(p) >= 0.35 AS any_long, count_if(p >= 0.55) / count(*)::DOUBLE >= 0.25 AND count_if(p >= 0.55) >= 1 AS frac_vote, round(count_if(p >= 0.55) / count(*)::DOUBLE, 6) AS frac
FROM lg GROUP BY file
""")
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda t: F.count_if(F.col("p") >= t) / F.count("*")
    return longs(spark, sf_dir).groupBy("file").agg(
        (F.avg("p") >= 0.35).alias("by_mean"), (share(0.35) >= 0.5).alias("long_vote"), (F.max("p") >= 0.35).alias("any_long"),
        ((share(0.55) >= 0.25) & (F.count_if(F.col("p") >= 0.55) >= 1)).alias("frac_vote"), r(share(0.55)).alias("frac"),
    )


_FILES = f"{_PROB}, fl AS (SELECT file, label % 2 = 0 AS truth, avg(p) AS p FROM lg GROUP BY file, label)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(spark, sf_dir).groupBy("file", "label").agg(F.avg("p").alias("p")).select("file", (F.col("label") % 2 == 0).alias("truth"), "p")


def _counts(positive: Column, truth: Column) -> list[Column]:
    n = lambda c: F.count_if(c)
    return [n(positive & truth).alias("tp"), n(positive & ~truth).alias("fp"), n(~positive & truth).alias("fn"), n(~positive & ~truth).alias("tn")]


def _scores() -> list[Column]:
    at_least = lambda c: F.greatest(c, F.lit(1))
    precision, recall = F.col("tp") / at_least(F.col("tp") + F.col("fp")), F.col("tp") / at_least(F.col("tp") + F.col("fn"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return [r(precision).alias("precision"), r(recall).alias("recall"), r(f1).alias("f1"), r((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"), r(F.col("tn") / at_least(F.col("fp") + F.col("tn"))).alias("specificity")]


_SCORES = """round(tp / greatest(tp + fp, 1)::DOUBLE, 6) AS precision, round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / greatest(tp + fp, 1)::DOUBLE) * (tp / greatest(tp + fn, 1)::DOUBLE) / (tp / greatest(tp + fp, 1)::DOUBLE + tp / greatest(tp + fn, 1)::DOUBLE) ELSE 0 END, 6) AS f1,
       round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(tn / greatest(fp + tn, 1)::DOUBLE, 6) AS specificity"""
_TALLY = "count_if(p >= thr AND truth)::BIGINT AS tp, count_if(p >= thr AND NOT truth)::BIGINT AS fp, count_if(p < thr AND truth)::BIGINT AS fn, count_if(p < thr AND NOT truth)::BIGINT AS tn"


@query(f"WITH {_FILES}, t AS (SELECT thr, {_TALLY} FROM fl, (SELECT 0.1::DOUBLE + 0.05::DOUBLE * k AS thr FROM (SELECT unnest(range(17)) AS k)) GROUP BY thr) SELECT round(thr, 2) AS threshold, tp, fp, fn, tn, {_SCORES} FROM t")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at 17 thresholds: an array in the row takes the place of a cross join."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: 0.1 + 0.05 * k)
    s = files(spark, sf_dir).select("truth", "p", F.explode(grid).alias("thr"))
    t = s.groupBy("thr").agg(*_counts(F.col("p") >= F.col("thr"), F.col("truth")))
    return t.select(F.round("thr", 2).alias("threshold"), "tp", "fp", "fn", "tn", *_scores())


@query(f"WITH {_FILES}, t AS (SELECT thr, {_TALLY} FROM fl, (SELECT 0.1::DOUBLE + 0.05::DOUBLE * k AS thr FROM (SELECT unnest(range(17)) AS k)) GROUP BY thr), s AS (SELECT thr, {_SCORES} FROM t) SELECT round(thr, 2) AS threshold, f1 FROM s ORDER BY f1 DESC, thr LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first threshold with the best F1."""
    return threshold_sweep(spark, sf_dir).orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


@query(f"WITH {_FILES}, t AS (SELECT 0.5 AS thr, {_TALLY.replace('thr', '0.5')} FROM fl) SELECT tp, fp, fn, tn, {_SCORES} FROM t")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = files(spark, sf_dir).agg(*_counts(F.col("p") >= 0.5, F.col("truth")))
    return t.select("tp", "fp", "fn", "tn", *_scores())


@query(f"""
WITH {_FILES}, k AS (SELECT truth, (rank() OVER (ORDER BY round(p, 9)) + rank() OVER (ORDER BY round(p, 9)) + count(*) OVER (PARTITION BY round(p, 9)) - 1) / 2.0::DOUBLE AS place FROM fl)
SELECT round((sum(place) FILTER (truth) - count_if(truth) * (count_if(truth) + 1) / 2) / (count_if(truth) * count_if(NOT truth)), 6) AS auc FROM k
""")
def roc_auc(spark: SparkSession, sf_dir: str, bins: int = 4096) -> DataFrame:
    """Rank-sum AUC. Counts of bins come first, so values are ranked inside a bin only."""
    f = files(spark, sf_dir).select("truth", F.round("p", 9).alias("p")).withColumn("bin", F.floor(F.col("p") * bins))
    k = f.groupBy("bin", "p").agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    before = lambda by: F.coalesce(F.sum("neg").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = k.groupBy("bin").agg(F.sum("neg").alias("neg")).select("bin", before(Window.orderBy("bin")).alias("below"))
    c = k.join(F.broadcast(sums), "bin").withColumn("under", F.col("below") + before(Window.partitionBy("bin").orderBy("p")))
    return c.agg(r(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


@query(f"WITH {_FILES} SELECT truth, round(avg(-CASE WHEN truth THEN 0.75 * pow(1 - p, 2) * ln(p) ELSE 0.25 * pow(p, 2) * ln(1 - p) END), 6) AS focal, round(avg(-CASE WHEN truth THEN ln(p) ELSE ln(1 - p) END), 6) AS cross_entropy FROM fl GROUP BY truth")
def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focal loss (alpha 0.75, gamma 2) and cross-entropy of scored files."""
    pt = F.when(F.col("truth"), F.col("p")).otherwise(1 - F.col("p"))
    alpha = F.when(F.col("truth"), F.lit(0.75)).otherwise(F.lit(0.25))
    return files(spark, sf_dir).groupBy("truth").agg(r(F.avg(-alpha * F.pow(1 - pt, F.lit(2)) * F.log(pt))).alias("focal"), r(F.avg(-F.log(pt))).alias("cross_entropy"))


@query(f"""
WITH {_PROB}, k AS (SELECT file, label, long_idx, p, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN label % 2 = 0 THEN -p ELSE p END, long_idx) AS k, count(*) OVER (PARTITION BY file) AS n FROM lg)
SELECT file, long_idx::BIGINT AS long_idx, round(p, 6) AS p FROM k WHERE k <= n / 2.0
""")
def incremental_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each file's long segments: the surest for leaks, the least sure for others."""
    by = Window.partitionBy("file")
    order = F.when(F.col("label") % 2 == 0, -F.col("p")).otherwise(F.col("p"))
    k = longs(spark, sf_dir).withColumn("k", F.row_number().over(by.orderBy(order, "long_idx"))).withColumn("n", F.count("*").over(by))
    return k.filter(F.col("k") <= F.col("n") / 2).select("file", "long_idx", r(F.col("p")).alias("p"))


# Labels, weights, splits.


@query("SELECT event_type AS label, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS label_id FROM (SELECT DISTINCT event_type FROM events)")
def label_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in order, from 0; only distinct labels are ranked."""
    labels = table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("label_id"))


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), w AS (SELECT *, sum(n) OVER () / n::DOUBLE AS w FROM c), m AS (SELECT *, w / avg(w) OVER () AS u FROM w)
SELECT event_type, n, n * 80 AS segments, round(u, 6) AS weight, round(u * CASE WHEN event_type = 'purchase' THEN 2.5 ELSE 1 END, 6) AS boosted FROM m
""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse frequencies with mean 1; one class is boosted by 2.5."""
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = c.withColumn("w", F.sum("n").over(everything) / F.col("n")).withColumn("u", F.col("w") / F.avg("w").over(everything))
    boost = F.when(F.col("event_type") == "purchase", F.lit(2.5)).otherwise(F.lit(1.0))
    return w.select("event_type", "n", (F.col("n") * 80).alias("segments"), r(F.col("u")).alias("weight"), r(F.col("u") * boost).alias("boosted"))


@query("SELECT event_id, k::INTEGER AS copy FROM (SELECT event_id, unnest(range(1, CASE WHEN event_type = 'purchase' THEN 4 ELSE 2 END)) AS k FROM events)")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one class three times, in the row's own task."""
    n = F.when(F.col("event_type") == "purchase", F.lit(3)).otherwise(F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(1), n)).alias("copy"))


@query("""
WITH k AS (SELECT event_id, row_number() OVER (ORDER BY md5('7' || event_id::VARCHAR), event_id) AS k, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM k
""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded order, floor(70 %) train, floor(20 %) validation, the rest test.

    The order is that of a digest. Its first 12 bits split the rows into bins that are counted first, so
    ranks are worked out inside bins and no task orders the whole table.
    """
    e = table(spark, sf_dir, "events").select("event_id", F.md5(F.concat(F.lit("7"), F.col("event_id").cast("string"))).alias("d")).withColumn("bin", F.substring("d", 1, 3))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = e.groupBy("bin").agg(F.count("*").alias("c")).select("bin", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("before"), F.sum("c").over(everything).alias("n"))
    k = e.join(F.broadcast(bins), "bin").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("d", "event_id")))
    train, val = F.floor(F.col("n") * 0.7), F.floor(F.col("n") * 0.2)
    return k.select("event_id", F.when(F.col("k") <= train, F.lit("train")).when(F.col("k") <= train + val, F.lit("val")).otherwise(F.lit("test")).alias("split"))


@query("""
WITH d AS (SELECT doc_id, quality, n_chars, ntile(4) OVER (ORDER BY n_chars, doc_id) AS q FROM labels JOIN documents USING (doc_id))
SELECT q::INTEGER AS q, count(*) AS n, sum(quality)::BIGINT AS good, max(n_chars) AS high FROM d GROUP BY q
""")
def quartile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by quartile of length. Ranks come from counts per length, not from one sorted task."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    up, everything = Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = d.groupBy("n_chars").agg(F.count("*").alias("c")).select("n_chars", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("before"), F.sum("c").over(everything).alias("n"))
    k = d.join(sizes, "n_chars").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id")))
    small, extra = F.floor(F.col("n") / 4), F.col("n") % 4
    edge = extra * (small + 1)
    q = F.when(F.col("k") <= edge, F.ceil(F.col("k") / (small + 1))).otherwise(extra + F.ceil((F.col("k") - edge) / small)).cast("int")
    return k.withColumn("q", q).groupBy("q").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.max("n_chars").alias("high"))


# Triangulation over suppliers as sensors.


@query(f"""
WITH {network._SENSORS}, c AS (SELECT *, 0.5::DOUBLE + (sensor_id * 13 % 50) / 100.0::DOUBLE AS conf FROM sensors)
SELECT site_id, count(*) AS n, round(sum(conf * latitude) / sum(conf), 6) AS latitude, round(sum(conf * longitude) / sum(conf), 6) AS longitude, round(sum(conf * conf) / sum(conf), 6) AS confidence FROM c GROUP BY site_id HAVING count(*) >= 3
""")
def triangulate_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence-weighted position of sites with three estimates or more."""
    s = network.sensors(spark, sf_dir).withColumn("conf", 0.5 + F.col("sensor_id") * 13 % 50 / F.lit(100.0))
    mean = lambda c: r(F.sum(F.col("conf") * F.col(c)) / F.sum("conf"))
    g = s.groupBy("site_id").agg(F.count("*").alias("n"), mean("latitude").alias("latitude"), mean("longitude").alias("longitude"), mean("conf").alias("confidence"))
    return g.filter("n >= 3")


@query(f"""
WITH {network._SENSORS}, m AS (SELECT site_id, avg(latitude) + 0.001 AS la, avg(longitude) + 0.001 AS lo FROM sensors GROUP BY site_id),
u AS (SELECT s.site_id, (m.la - latitude) / sqrt(pow(m.la - latitude, 2) + pow(m.lo - longitude, 2)) AS a, (m.lo - longitude) / sqrt(pow(m.la - latitude, 2) + pow(m.lo - longitude, 2)) AS b FROM sensors s JOIN m USING (site_id)),
h AS (SELECT site_id, count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM u GROUP BY site_id)
SELECT site_id, n, CASE WHEN abs(aa * bb - ab * ab) > 1e-9 THEN round(sqrt((aa + bb) / (aa * bb - ab * ab)), 5) END AS gdop FROM h
""")
def gdop_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dilution of precision in the plane in closed form from three sums; null where the geometry is singular."""
    s = network.sensors(spark, sf_dir)
    m = s.groupBy("site_id").agg((F.avg("latitude") + 0.001).alias("la"), (F.avg("longitude") + 0.001).alias("lo"))
    d = F.sqrt(F.pow(F.col("la") - F.col("latitude"), 2) + F.pow(F.col("lo") - F.col("longitude"), 2))
    u = s.join(m, "site_id").select("site_id", ((F.col("la") - F.col("latitude")) / d).alias("a"), ((F.col("lo") - F.col("longitude")) / d).alias("b"))
    h = u.groupBy("site_id").agg(F.count("*").alias("n"), *[F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in ("aa", "bb", "ab")])
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return h.select("site_id", "n", F.when(F.abs(det) > 1e-9, r(F.sqrt((F.col("aa") + F.col("bb")) / det), 5)).alias("gdop"))


def _flat(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Metres in the plane around the first point."""
    return np.stack([(lat - lat[0]) * 6_371_000.0 * np.pi / 180, (lon - lon[0]) * 6_371_000.0 * np.pi / 180 * math.cos(np.radians(lat[0]))], axis=1)


@query(f"""
{kernel_sql.linkage(network._SENSORS)}, d AS (SELECT h.*, la, lo, {network._hav('h', 'z').replace('z.latitude', 'm.la').replace('z.longitude', 'm.lo')} AS d FROM h JOIN m USING (site_id, cluster_id))
SELECT site_id, cluster_id::INTEGER AS cluster_id, round(la, 6) AS la, round(lo, 6) AS lo, count(*) AS members, round(stddev_pop(d), 4) + 0 AS uncertainty_m, round(min(conf), 6) AS low, round(max(conf), 6) AS high,
       '{{' || string_agg(sensor_id || ' -> ' || round(d, 3)::VARCHAR, ', ' ORDER BY sensor_id::VARCHAR) || '}}' AS distances FROM d GROUP BY site_id, cluster_id, la, lo
""")
def triangulate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average linkage of a survey's positions at 400 m, then weighted centres, spread and members."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sensor_id").reset_index(drop=True)
        p = _flat(pdf.latitude.to_numpy(), pdf.longitude.to_numpy())
        pdf["cluster_id"] = dsp.average_linkage(dsp.plane_distances(*p.T), 400.0)
        return pdf[["site_id", "sensor_id", "cluster_id", "latitude", "longitude", "conf"]]

    s = network.sensors(spark, sf_dir).withColumn("conf", 0.5 + F.col("sensor_id") * 13 % 50 / F.lit(100.0))
    c = s.select("site_id", "sensor_id", "latitude", "longitude", "conf").groupBy("site_id").applyInPandas(run, "site_id int, sensor_id long, cluster_id int, latitude double, longitude double, conf double")
    mean = lambda x: F.sum(F.col("conf") * F.col(x)) / F.sum("conf")
    centre = c.groupBy("site_id", "cluster_id").agg(mean("latitude").alias("la"), mean("longitude").alias("lo"))
    d = P.haversine(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo"))
    g = c.join(centre, ["site_id", "cluster_id"]).withColumn("d", d).groupBy("site_id", "cluster_id", "la", "lo")
    return g.agg(F.count("*").alias("members"), r(F.stddev_pop("d"), 4).alias("uncertainty_m"), r(F.min("conf")).alias("low"), r(F.max("conf")).alias("high"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("sensor_id").cast("string"), r(F.col("d"), 3))))).cast("string").alias("distances")).withColumns({"la": r(F.col("la")), "lo": r(F.col("lo"))})


@query("SELECT s_nationkey AS site_id, count(*)::INTEGER AS sensors, 0.0::DOUBLE AS miss_m FROM supplier GROUP BY s_nationkey HAVING count(*) >= 3")
def trilaterate_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares positions from exact ranges to a hidden point 120 m east and 80 m north of the centre."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sensor_id")
        p = _flat(pdf.latitude.to_numpy(), pdf.longitude.to_numpy())
        hidden = p.mean(axis=0) + [80.0, 120.0]
        found = dsp.trilaterate(p, np.linalg.norm(p - hidden, axis=1))
        return pd.DataFrame({"site_id": [pdf.site_id.iloc[0]], "sensors": [len(pdf)], "miss_m": [float(np.linalg.norm(found - hidden))]})

    s = network.sensors(spark, sf_dir).select("site_id", "sensor_id", "latitude", "longitude")
    enough = s.groupBy("site_id").count().filter("count >= 3").select("site_id")
    out = s.join(enough, "site_id").groupBy("site_id").applyInPandas(run, "site_id int, sensors int, miss_m double")
    return out.select("site_id", "sensors", r(F.col("miss_m"), 3).alias("miss_m"))


# Reports over located pairs.

_L = f"WITH {network.LOCATED}, l AS (SELECT *, conf * 25 AS snr FROM located)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.located(spark, sf_dir).withColumn("snr", F.col("conf") * 25)


@query(f"{_L}, p AS (SELECT user_id_a, user_id_b, count(*) AS n, sum(drift_s) AS took FROM l GROUP BY ALL) SELECT count(*) AS pairs, sum(n)::BIGINT AS leaks, round(avg(n), 6) AS leaks_per_pair, round(sum(took), 4) AS seconds, round(CASE WHEN sum(took) > 0 THEN count(*) / sum(took) ELSE 0 END, 6) AS pairs_per_s FROM p")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = results(spark, sf_dir).groupBy("user_id_a", "user_id_b").agg(F.count("*").alias("n"), F.sum("drift_s").alias("took"))
    rate = F.when(F.sum("took") > 0, F.count("*") / F.sum("took")).otherwise(F.lit(0.0))
    return p.agg(F.count("*").alias("pairs"), F.sum("n").alias("leaks"), r(F.avg("n")).alias("leaks_per_pair"), r(F.sum("took"), 4).alias("seconds"), r(rate).alias("pairs_per_s"))


@query(f"{_L} SELECT count(*) AS n, count_if(conf > 0.8)::BIGINT AS high, count_if(conf > 0.6 AND conf <= 0.8)::BIGINT AS medium, count_if(conf <= 0.6)::BIGINT AS low, count_if(conf > 0.9)::BIGINT AS certain, count_if(conf > 0.85)::BIGINT AS urgent, count_if(snr < 10)::BIGINT AS noisy FROM l")
def exec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands, and the counts that recommendations rest on."""
    c = F.col("conf")
    rules = {"high": c > 0.8, "medium": (c > 0.6) & (c <= 0.8), "low": c <= 0.6, "certain": c > 0.9, "urgent": c > 0.85, "noisy": F.col("snr") < 10}
    return results(spark, sf_dir).agg(F.count("*").alias("n"), *[F.count_if(x).alias(k) for k, x in rules.items()])


@query(f"{_L} SELECT round(avg(conf), 6) AS conf_mean, round(stddev_pop(conf), 6) AS conf_std, round(min(conf), 6) AS conf_min, round(max(conf), 6) AS conf_max, round(avg(snr), 6) AS snr_mean, round(stddev_pop(snr), 6) AS snr_std, round(count_if(conf >= 0.7) / count(*)::DOUBLE, 6) AS conf_pass, round(count_if(snr >= 10) / count(*)::DOUBLE, 6) AS snr_pass FROM l")
def qa_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = F.col("conf"), F.col("snr"), F.count("*")
    return results(spark, sf_dir).agg(
        r(F.avg(c)).alias("conf_mean"), r(F.stddev_pop(c)).alias("conf_std"), r(F.min(c)).alias("conf_min"), r(F.max(c)).alias("conf_max"), r(F.avg(s)).alias("snr_mean"), r(F.stddev_pop(s)).alias("snr_std"),
        r(F.count_if(c >= 0.7) / n).alias("conf_pass"), r(F.count_if(s >= 10) / n).alias("snr_pass"),
    )


@query(f"{_L}, p AS (SELECT user_id_a, user_id_b, avg(conf) AS c, avg(snr) AS s FROM l GROUP BY ALL) SELECT count(*) AS pairs, round(avg(c), 6) AS mean_of_means, round(avg(s), 6) AS snr_of_means, round(quantile_cont(c, 0.95), 6) AS p95 FROM p")
def processing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the pairs' means, not pooled."""
    p = meetings.by_sensor_pair(table(spark, sf_dir, "events"), 60.0, meetings.mean_confidence, "c double, s double")
    q = R.quantiles(p, [], "c", {"p95": 0.95}, {"c_sum": ("c", "sum"), "s_sum": ("s", "sum")})
    return q.select(F.col("n").alias("pairs"), r(F.col("c_sum") / F.col("n")).alias("mean_of_means"), r(F.col("s_sum") / F.col("n")).alias("snr_of_means"), r(F.col("p95")).alias("p95"))


@query(f"{_L}, b AS (SELECT coalesce(CASE WHEN band <> 'click' THEN band END, 'unknown') AS band, conf FROM l) SELECT band, count(*) AS n, round(avg(conf), 6) AS mean, round(quantile_cont(conf, 0.25), 6) AS q1, round(median(conf), 6) AS q2, round(quantile_cont(conf, 0.75), 6) AS q3 FROM b GROUP BY band")
def band_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spread of confidence by band; a missing band is unknown."""
    band = F.coalesce(F.when(F.col("band") != "click", F.col("band")), F.lit("unknown"))
    shares = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    q = R.quantiles(results(spark, sf_dir).select(band.alias("band"), "conf"), ["band"], "conf", shares, {"total": ("conf", "sum"), "known": ("conf", "count")})
    return q.select("band", "n", r(F.col("total") / F.col("known")).alias("mean"), *[r(F.col(k)).alias(k) for k in shares])


@query(f"{_L}, k AS (SELECT *, row_number() OVER (ORDER BY conf DESC, event_id_a, event_id_b) AS place FROM l) SELECT event_id_a, event_id_b, round(conf, 6) AS conf, place::INTEGER AS place, ((place - 1) // 15)::BIGINT AS page FROM k WHERE place <= 45")
def leak_table_top45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 45 surest results, 15 a page; the top-k is taken in every task first."""
    top = results(spark, sf_dir).orderBy(F.desc("conf"), "event_id_a", "event_id_b").limit(45)
    k = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("conf"), "event_id_a", "event_id_b")))
    return k.select("event_id_a", "event_id_b", r(F.col("conf")).alias("conf"), "place", F.floor((F.col("place") - 1) / 15).alias("page"))


@query(f"""
{_L} SELECT event_id_a, event_id_b, '{{"leaks":[{{"distance_m":' || round(round(spot, 6)::DECIMAL(18, 6), 2)::DECIMAL(18, 2)::VARCHAR || ',"confidence":' || round(round(conf, 6)::DECIMAL(18, 6), 3)::DECIMAL(18, 3)::VARCHAR || '}}]}}' AS json FROM l
""")
def location_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as rounded JSON documents, one a pair of recordings."""
    fixed = lambda c, n: F.round(F.round(c, 6).cast("decimal(18,6)"), n).cast(f"decimal(18,{n})")
    leak = F.struct(fixed(F.col("spot"), 2).alias("distance_m"), fixed(F.col("conf"), 3).alias("confidence"))
    return results(spark, sf_dir).select("event_id_a", "event_id_b", F.to_json(F.struct(F.array(leak).alias("leaks"))).alias("json"))


# Ingest.


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def ingest_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings whose logger was never seen."""
    e = table(spark, sf_dir, "events")
    seen = e.filter("event_id % 97 = 0").select("user_id").distinct()
    return e.filter("event_id % 3 <> 0").join(seen, "user_id", "left_anti").select("event_id", "user_id")


@query("""
WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END AS id, CASE event_id % 4 WHEN 0 THEN '1' ELSE '3' END AS kind, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'site' END AS site, CASE WHEN event_id % 7 = 0 THEN NULL ELSE '9' END AS gain FROM events)
SELECT id, coalesce(try_cast(id AS BIGINT), 0) AS number, (row_number() OVER (ORDER BY coalesce(try_cast(id AS BIGINT), 0), id))::BIGINT AS place FROM t WHERE NOT (kind <> '3' OR (site IS NULL AND gain IS NULL))
""")
def catalogue_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's filter, then its order by numeric id, others as 0."""
    return _catalogue_order(table(spark, sf_dir, "events"))


def _catalogue_order(events: DataFrame, bins: int = 64) -> DataFrame:
    """Ranks inside ranges of the sort key, whose counts come first, so no task orders the whole table. Cuts come from a sample; ranks don't depend on them."""
    i = F.col("event_id")
    t = events.select(
        F.when(i % 10 == 0, F.concat(F.lit("x"), i.cast("string"))).otherwise(i.cast("string")).alias("id"), F.when(i % 4 == 0, F.lit("1")).otherwise(F.lit("3")).alias("kind"),
        F.when(i % 5 != 0, F.lit("site")).alias("site"), F.when(i % 7 != 0, F.lit("9")).alias("gain"),
    )
    t = t.filter(~((F.col("kind") != "3") | (F.col("site").isNull() & F.col("gain").isNull())))
    t = t.select("id", F.coalesce(F.col("id").try_cast("long"), F.lit(0)).alias("number"))
    #: Text that sorts as (number, id) does: the number with its sign bit turned, then the id.
    t = t.withColumn("key", F.concat(F.lpad(F.hex(F.col("number").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), "id"))
    sample = sorted(x.key for x in t.select("key").orderBy(F.xxhash64("key")).limit(16 * bins).collect())
    t = t.withColumn("bin", sum(((F.col("key") >= c).cast("int") for c in sample[16::16]), F.lit(0)))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = t.groupBy("bin").agg(F.count("*").alias("c")).select("bin", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("key"))
    return t.join(F.broadcast(before), "bin").select("id", "number", place.alias("place"))


@query("""
WITH l AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY doc_id % 200 ORDER BY doc_id DESC) AS k FROM labels),
d AS (SELECT doc_id, 'rec' || doc_id % 200 || CASE doc_id % 3 WHEN 0 THEN '_part1' WHEN 1 THEN '_padded' ELSE '' END || '.wav' AS name FROM documents)
SELECT d.doc_id, name, CASE WHEN quality = 1 THEN 'leak' ELSE 'noleak' END AS status FROM d LEFT JOIN l ON l.k = 1 AND 'rec' || l.doc_id % 200 = regexp_replace(regexp_replace(name, '\\.wav$', ''), '_(part\\d+|padded)$', '')
""")
def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings to labels by base name, the last label of a name winning; without one, no leak."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("rec"), (i % 200).cast("string"), F.when(i % 3 == 0, F.lit("_part1")).when(i % 3 == 1, F.lit("_padded")).otherwise(F.lit("")), F.lit(".wav")).alias("name"))
    labels = R.last_wins(table(spark, sf_dir, "labels").withColumn("base", F.concat(F.lit("rec"), (i % 200).cast("string"))), ["base"], F.desc("doc_id")).select("base", "quality")
    d = d.withColumn("base", F.regexp_replace(F.regexp_replace("name", r"\.wav$", ""), r"_(part\d+|padded)$", ""))
    return d.join(labels, "base", "left").select("doc_id", "name", F.when(F.col("quality") == 1, F.lit("leak")).otherwise(F.lit("noleak")).alias("status"))


@query("SELECT event_type AS status, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events),
b AS (SELECT *, CASE WHEN before IS NULL OR value > before THEN 1 ELSE 0 END AS better FROM e), g AS (SELECT *, sum(better) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS no_improve FROM g)
SELECT event_id, no_improve::INTEGER AS no_improve, no_improve >= 5 AS stop FROM k
""")
def plateau_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds without improvement of each run, and whether it would stop."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.max("value").over(by.rowsBetween(Window.unboundedPreceding, -1))
    e = table(spark, sf_dir, "events").withColumn("better", F.when(before.isNull() | (F.col("value") > before), 1).otherwise(0))
    e = e.withColumn("island", F.sum("better").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("no_improve", F.row_number().over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id")) - 1)
    return e.select("event_id", "no_improve", (F.col("no_improve") >= 5).alias("stop"))


@query("SELECT o_orderpriority AS priority, o_orderkey, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def keep_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three of each series, as a checkpoint rotation keeps them."""
    return R.first_by(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.desc("o_orderdate"), F.col("o_orderkey"), n=3, rank="place").select(F.col("o_orderpriority").alias("priority"), "o_orderkey", "place")
