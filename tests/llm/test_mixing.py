import random
import re
from collections import Counter

import pytest

from echoline.llm.mixing import Mix, mix


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(sizes):
    """Targets by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        each = left / sum(weight[s] for s in free)
        for s in list(free):
            target[s] += each * weight[s]
        over = {s for s in order if target[s] > 2 * sizes[s]}
        left = sum(target[s] - 2 * sizes[s] for s in over)
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= over
        free -= {s for s in free if target[s] >= 2 * sizes[s]}
    return target


@pytest.mark.parametrize("buckets", [4096, 4])
def test_targets_and_words_taken(spark, buckets):
    rng = random.Random(3)
    sources = ["b", "a", None, "c", "É", "Z", "tiny"]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(sources[:6] if i % 3 else ["a"])) for i in range(3000)]
    rows += [(5000, None, "tiny"), (5001, "", "tiny"), (5002, "one", "tiny"), (None, "x y", "b"), (6000, "x " * 20000, "c"), (6001, None, "silent")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS mix_u", "3 AS u")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    target = wanted(sizes)
    m = Mix(docs, buckets=buckets)
    out = m.judged().collect()
    assert len(out) == len(rows)
    source = {i: s for i, _, s in rows}
    taken, count = Counter(), Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size and r.copies <= 2
        taken[s] += r.taken
        count[s] += 1
    largest = {s: max(words(t) for _, t, x in rows if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1, s
    again = Mix(docs.repartition(7), buckets=buckets).judged().collect()
    assert sorted(out, key=str) == sorted(again, key=str)
    whole = mix(docs, buckets=buckets)
    assert set(docs.columns) <= set(whole.columns) and sum(r.taken for r in whole.collect()) == sum(taken.values())


def test_unequal_probabilities(spark):
    """Documents of twice the worth are taken about twice as often."""
    rows = [(i, "a b c", "s", 1.0 + i % 2) for i in range(4000)] + [(i, "a b c", "t", 1.0) for i in range(9000, 17000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, worth double")
    out = {r.doc_id: r.copies for r in Mix(docs, share=0.2, utility="worth").judged().collect()}
    odd, even = (sum(out[i] for i in range(k, 4000, 2)) for k in (1, 0))
    assert 1.7 < odd / even < 2.3


def test_size_decides_the_odds_and_certain_documents_are_paid_for(spark):
    """p = min(1, rate * binary digits of the size); long documents are likelier, and the words still meet the target."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([1, 3, 30, 500]), "s") for i in range(6000)] + [(9000 + i, "w " * 400, "t") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = Mix(docs, share=0.3).judged().collect()
    by = {}
    for r in out:
        if r.doc_id < 9000:
            by.setdefault(r.size, []).append(r.copies)
    share = {n: sum(c) / len(c) for n, c in by.items()}
    target = next(r.target for r in out if r.doc_id < 9000)
    want = {}
    mass = {n: n * len(c) for n, c in by.items()}
    lo, hi = 0.0, 10.0
    for _ in range(80):
        rate = (lo + hi) / 2
        want = {n: min(1.0, rate * n.bit_length()) for n in mass}
        lo, hi = (rate, hi) if sum(mass[n] * want[n] for n in mass) < target else (lo, rate)
    assert max(want.values()) <= 1 and all(abs(share[n] - want[n]) < 0.05 for n in want)
    assert share[1] < share[3] < share[30] < share[500]
    assert abs(sum(r.taken for r in out if r.doc_id < 9000) - target) <= 250


def test_certain_documents_beside_drawn_ones(spark):
    rows = [(i, "a b", "s", 1000.0 if i < 10 else 1.0) for i in range(1000)] + [(2000, "a " * 50, "t", None)] + [(3000 + i, "x", "u", float("nan")) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, worth double")
    out = {r.doc_id: r for r in Mix(docs, share=0.3, utility="worth").judged().collect()}
    assert all(out[i].copies == 1 for i in range(10))
    drawn = sum(out[i].copies for i in range(10, 1000))
    assert abs(2 * (drawn + 10) - out[0].target) <= 1


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 5 + [(2, "a b", "s"), (3, "a b", "s"), (4, "a b", "s")], "doc_id long, text string, source string")
    out = Mix(docs, share=0.5).judged().collect()
    assert len(out) == 8 and len({r.copies for r in out if r.doc_id == 1}) == 1
    assert Mix(docs.limit(0)).judged().count() == 0
