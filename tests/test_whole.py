"""Queries over whole tables, beyond the size of a fixed prefix."""

import datetime

from echoline import catalogue


def test_catalogue_sort_ranks_every_event(spark, tmp_path):
    spark.range(0, 5000, 1, 7).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    rows = [(f"x{i}" if i % 10 == 0 else str(i)) for i in range(5000) if i % 4 and (i % 5 or i % 7)]
    want = sorted((0 if x[0] == "x" else int(x), x) for x in rows)
    got = catalogue.queries()["catalogue_sort"](spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.number, r.id) for r in got] == want
    assert [r.place for r in got] == list(range(1, len(want) + 1))


def test_interval_pair_match_keeps_the_third_match(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(i, i % 2, at(600 * (i // 2) + 5 * (i % 2)), 1.0, "view") for i in range(12)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["interval_pair_match"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id_a, r.event_id_b, r.place) for r in got) == [(2 * i, 2 * i + 1, i + 1) for i in range(6)]
