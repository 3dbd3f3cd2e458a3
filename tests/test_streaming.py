import datetime as dt

from pyspark.sql import functions as F

from echoline.operators.relational import interval_join
from echoline.streaming import streams


def events(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, f"s{i % 7}", t + dt.timedelta(seconds=i * 17 % 3600), float(i % 13)) for i in range(300)]
    return spark.createDataFrame(rows, "id long, sensor string, ts timestamp, value double")


def sides(df):
    return [df.select(F.col("sensor").alias(f"sensor_{x}"), F.col("id").alias(f"recording_{x}"), F.col("ts").alias(f"ts_{x}")) for x in "ab"]


def test_interval_join_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    events(spark).repartition(3).write.parquet(src)
    live = lambda: streams.files(spark, src, events(spark).schema, 1)
    a, b = sides(live())[0], sides(live())[1]
    out = streams.interval_pairs(a, b, lateness="2 hours")
    streams.land(out.drop("ts_a", "ts_b"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    a, b = sides(events(spark))
    batch = interval_join(a, b, "ts_a", "ts_b", 60, keep=F.col("sensor_a") < F.col("sensor_b"))
    key = ["recording_a", "recording_b", "drift_s"]
    found = spark.read.parquet(str(tmp_path / "out")).select(key).collect()
    assert found and sorted(found) == sorted(batch.select(key).collect())


def test_interval_join_against_nested_loop(spark):
    a, b = sides(events(spark))
    naive = a.join(b, (F.col("sensor_a") < F.col("sensor_b")) & (F.abs(F.unix_micros("ts_a") - F.unix_micros("ts_b")) <= 60_000_000))
    fast = interval_join(a, b, "ts_a", "ts_b", 60, keep=F.col("sensor_a") < F.col("sensor_b"))
    assert sorted(naive.select("recording_a", "recording_b").collect()) == sorted(fast.select("recording_a", "recording_b").collect())
    assert "NestedLoop" not in fast._jdf.queryExecution().executedPlan().toString()


def test_cursor_ingest_lands_each_id_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "landed")
    e = events(spark)
    e.filter("id < 200").unionByName(e.filter("id < 50")).repartition(4).write.parquet(src)
    schema = e.schema
    streams.land_new(streams.files(spark, src, schema, 1), out, str(tmp_path / "cp")).awaitTermination()
    e.filter("id >= 150").repartition(2).write.mode("append").parquet(src)
    streams.land_new(streams.files(spark, src, schema, 1), out, str(tmp_path / "cp")).awaitTermination()
    ids = [r.id for r in spark.read.parquet(out).select("id").collect()]
    assert sorted(ids) == list(range(300))


def test_windows_and_sessions(spark, tmp_path):
    src = str(tmp_path / "src")
    named = events(spark).withColumnRenamed("sensor", "sensor_id")
    named.write.parquet(src)
    live = lambda: streams.files(spark, src, named.schema, 10)
    for name, f in (("levels", streams.levels), ("sessions", streams.sessions)):
        streams.land(f(live(), lateness="0 seconds"), str(tmp_path / name), str(tmp_path / f"cp-{name}")).awaitTermination()
        got, want = spark.read.parquet(str(tmp_path / name)), f(named)
        keys = ["start", "sensor_id", "n"]
        missing = set(want.select(keys).collect()) - set(got.select(keys).collect())
        last = named.agg(F.max("ts")).first()[0]
        assert set(got.select(keys).collect()) <= set(want.select(keys).collect())
        assert all((last - m.start).total_seconds() < 3600 for m in missing)
    once = streams.new_recordings(live())
    streams.land(once, str(tmp_path / "once"), str(tmp_path / "cp-once")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 300
