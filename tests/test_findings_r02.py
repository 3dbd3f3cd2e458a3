"""What the second round's review found."""

import datetime
from functools import reduce
from itertools import combinations
from operator import add

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracles import canonical

from echoline import catalogue
from echoline.functions import dsp
from echoline.functions import text as X
from echoline.operators import meetings
from echoline.operators import relational as R
from echoline.plans import transforms


def test_sizes_round_ties_to_even(spark):
    sizes = [1152, 1408, 1664, 1920, 7808, 1536, 1153, 100, 5 * 2**17, 2**40 + 2**37, 3 * 2**50 + 2**47]
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    power = lambda n: max(i for i in range(6) if n >= 1024**i)
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", X.bytes_human(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == {n: f"{n / 1024 ** power(n):.2f} {units[power(n)]}" for n in sizes}


def _merged(d: np.ndarray, limit: float) -> list[list[int]]:
    """Average linkage as the SQL has it: the least (mean, older group, younger group) merges, and the new group is the last."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        mean, p, q = min((reduce(add, (d[i, j] for i in p for j in q)) / (len(p) * len(q)), p, q) for p, q in combinations(groups, 2))
        if not mean <= limit:
            break
        groups = [g for g in groups if g not in (p, q)] + [sorted(p + q)]
    return sorted(groups)


def test_average_linkage_of_a_lattice_follows_its_sql():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        d = dsp.plane_distances(rng.integers(0, 12, 40) * 0.7, rng.integers(0, 12, 40) * 0.7)
        ids = dsp.average_linkage(d, 3.0)
        assert [np.flatnonzero(ids == k).tolist() for k in range(ids.max() + 1)] == _merged(d, 3.0)


def test_synthetic_pairs_are_dealt_out(spark):
    assert transforms._sites(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_filters_in_blocks_are_those_by_samples():
    x, sos = np.random.default_rng(0).normal(size=(3, 1000)), dsp.butterworth(4, 0.02, 0.3)
    state = dsp._steady(sos)
    assert np.allclose(dsp.sosfilt(sos, x, state), dsp._stepped(sos, x, x[:, :1] * state.reshape(1, -1))[0], rtol=0, atol=1e-11)
    assert np.allclose(dsp.sosfilt(sos, x), dsp._stepped(sos, x, np.zeros((3, 8)))[0], rtol=0, atol=1e-11)


def test_rows_with_a_coherent_band_are_filtered_together(monkeypatch):
    source = dsp.bandpass(np.random.default_rng(0).normal(size=(1, 4200)), 300, 900, 4096)
    a, b = np.repeat(source[:, 50:4146], 20, axis=0), np.repeat(source[:, 40:4136], 20, axis=0)
    runs, bandpass = [], dsp.bandpass
    monkeypatch.setattr(dsp, "bandpass", lambda x, *p: runs.append(len(x)) or bandpass(x, *p))
    got = dsp.coherence_weighted(a, b, 4096)
    assert 0 < len(runs) <= 10 and set(runs) == {20}
    assert np.allclose(got[0], dsp.coherence_weighted(a[:1], b[:1], 4096)[0], rtol=0, atol=1e-11)


def _odd_events(spark, folder):
    """Recordings close in time, some twice, some without a value, time or sensor; sensors with negative ids."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 41 == 0 else i * 7 % 9 - 2, None if i % 53 == 0 else at + datetime.timedelta(seconds=i * 37 % 900), None if i % 17 == 0 else float(i * 13 % 97) * 6, "view") for i in range(300)]
    rows += [(i + 300, *rows[i][1:]) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double, event_type string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")


def _by_blocks(spark, folder, name):
    """Whether the query's SQL gives the same, and whether no pairs are sorted or shuffled by sensors."""
    _odd_events(spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    same = canonical(df.toPandas()) == canonical(con.sql(catalogue.oracle_sql()[name]).df())
    plan = df._jdf.queryExecution().executedPlan().toString()
    return same, "Join" not in plan and "Window" not in plan and "hashpartitioning(user_id" not in plan


def test_interval_pair_match_shuffles_no_pairs(spark, tmp_path):
    assert _by_blocks(spark, tmp_path, "interval_pair_match") == (True, True)


def test_located_clusters_shuffles_no_pairs(spark, tmp_path):
    assert _by_blocks(spark, tmp_path, "located_clusters") == (True, True)


def test_leaks_json_shuffles_no_pairs(spark, tmp_path):
    assert _by_blocks(spark, tmp_path, "leaks_json") == (True, True)


def test_processing_stats_shuffles_no_pairs(spark, tmp_path):
    assert _by_blocks(spark, tmp_path, "processing_stats")[0]
    assert "percentile" not in catalogue.queries()["processing_stats"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_band_analysis_gathers_no_group(spark, tmp_path):
    assert _by_blocks(spark, tmp_path, "band_analysis")[0]
    assert "percentile" not in catalogue.queries()["band_analysis"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_quantiles_are_exact(spark):
    rows = [(k, v) for k in ("a", None) for v in (0.5, 0.5, None, -3.25, 0.500001, 9.0, 2.0)] + [("b", 1.5), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"q1": 0.25, "q2": 0.5, "q3": 0.77}
    want = df.groupBy("k").agg(F.count("*").alias("n"), *[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()]).collect()
    for bins in (1, 4, 65536):
        got = {r.k: r for r in R.quantiles(df, ["k"], "v", shares, bins=bins).collect()}
        assert len(got) == len(want)
        for w in want:
            assert got[w.k].n == w.n and [got[w.k][n] for n in shares] == [None if w[n] is None else pytest.approx(w[n], abs=1e-12) for n in shares]


def test_portions_hold_every_match_once(monkeypatch):
    rng = np.random.default_rng(0)
    x = {"event_id": np.arange(400), "user_id": np.where(rng.random(400) < 0.3, 5, rng.integers(0, 30, 400)), "t": rng.integers(0, 2000, 400)}
    want = {(i, j) for i in range(400) for j in range(400) if x["user_id"][i] < x["user_id"][j] and abs(x["t"][i] - x["t"][j]) <= 60}
    monkeypatch.setattr(meetings, "PORTION", 50)
    for parts in (1, 2):
        own = x["user_id"] % parts
        sides = [{k: v[own == p] for k, v in x.items()} for p in range(parts)]
        found, pairs = [], {}
        for i in range(parts):
            for j in range(i, parts):
                for n, m in enumerate(meetings._matches(meetings._sorted(sides[i], "user_id"), meetings._sorted(sides[j], "t"), 60, i == j)):
                    found += zip(m["event_id_a"].tolist(), m["event_id_b"].tolist(), strict=True)
                    for a, b in {(a, b) for a, b in zip(m["user_id_a"].tolist(), m["user_id_b"].tolist(), strict=True)}:
                        assert pairs.setdefault((a, b), (i, j, n)) == (i, j, n)
        assert len(found) == len(want) and set(found) == want
