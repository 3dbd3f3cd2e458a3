import hashlib
import random
import re

import pytest

from echoline.llm.exact_dedup import ExactDedup, LsmIndex, exact_dedup


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(plain(t), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, least[plain(t)], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t, *_ in rows), key=str), groups, least


def fixture(spark):
    rng = random.Random(7)
    texts = ["", None, " ", "a b", "a\t\nb", "a  b ", "É\xa0x", "word " * 30000] + [f"text {i}" for i in range(40)]
    rows = [(i, rng.choice(texts), 1) for i in range(300)] + [(i, "hot  copy" if i % 2 else "hot copy", 2) for i in range(1000, 1400)]
    rows += [(None, "nobody", 3), (None, "nobody", 3), (None, "a b", 3), (1000, "hot copy", 4), (7, "twice", 5), (7, "twice", 6)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, digest int").selectExpr("*", "1 AS kept", "2 AS N", "3 AS body")


@pytest.mark.parametrize("bytes_", [32, 1])
def test_against_brute_force(spark, bytes_):
    """One-byte digests collide all the time; byte verification must part them."""
    rows, docs = fixture(spark)
    truth, groups, least = brute(rows)
    dedup = ExactDedup(docs, digest_bytes=bytes_)
    for found in (dedup.judged(), dedup.annotate()):
        out = found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == truth
        kept = [(r.doc_id, r.text_sha256) for r in out if r.kept]
        assert len(kept) == len(groups) and {t for _, t in kept} == {t[3] for t in truth}
        assert all(r.doc_id == r.keep_id for r in out if r.kept)
    stays = exact_dedup(docs, digest_bytes=bytes_)
    assert stays.columns == docs.columns and stays.count() == len(groups)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ExactDedup(docs).judged().count() == 0 and exact_dedup(docs).count() == 0


def test_no_python_in_the_plan(spark):
    _, docs = fixture(spark)
    plan = ExactDedup(docs).annotate()._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize(("memtable", "fan_in"), [(100_000, 4), (100, 2), (20, 4)])
def test_levels_merge(spark, memtable, fan_in):
    """One run, four levels of two, and three levels of four give the same entries."""
    rows, docs = fixture(spark)
    entries = docs.selectExpr("unhex(sha2(coalesce(text, ''), 256)) AS digest", "doc_id", "monotonically_increasing_id() AS nid")
    index = LsmIndex(memtable, fan_in).flush(entries)
    runs = index.runs
    got = {bytes(r.digest): (r.first.doc_id, r.n) for r in index.compact().collect()}
    want = {}
    for i, t, _ in rows:
        want.setdefault(hashlib.sha256((t or "").encode()).digest(), []).append(i)
    assert got == {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in want.items()}
    levels = 1
    while runs > 1:
        runs, levels = -(-runs // fan_in), levels + 1
    assert len(index.levels) == levels


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b", i) for i in range(50)] + [(2, "a  b", 0), (3, "c", 0), (3, "c", 1)], "doc_id long, text string, extra int")
    dedup = ExactDedup(docs, memtable=10)
    assert sum(r.kept for r in dedup.judged().collect()) == 2 == sum(r.kept for r in dedup.annotate().collect())
    assert sorted(r.doc_id for r in dedup.kept().collect()) == [1, 3]
