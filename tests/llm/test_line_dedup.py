import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from echoline.llm import line_dedup


def plain(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")


def brute(rows, least):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text.split("\n") if text is not None else []):
            sites[plain(line)].add(site)
    out = []
    for i, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if not plain(x) or len(sites[plain(x)]) < least]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("least", [3, 10])
def test_against_brute_force(spark, least):
    rng = random.Random(4)
    common = [f"shared  line {i}" for i in range(30)]
    rows = []
    for i in range(400):
        lines = [rng.choice([common[min(29, int(rng.expovariate(0.15)))], f"own {i} {j}", "", " \t"]) for j in range(rng.randrange(0, 9))]
        rows.append((i, "\n".join(lines), rng.choice([None, *(f"s{k}" for k in range(int(rng.choice([3, 12, 60]))))])))
    rows += [(500, None, "s1"), (500, None, "s1"), (None, common[0], "s2"), (501, common[0] + "\n" + "x\n" * 50_000, "s3"), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS line", "2 AS key_a", "3 AS n_lines")
    found = line_dedup.judged(docs, least)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found.collect()) == brute(rows, least)
    in_blocks = line_dedup.cleaned(docs.select("doc_id", "source", "text"), least, max_lines=4)
    whole = line_dedup.cleaned(docs.select("doc_id", "source", "text"), least)
    assert sorted(map(str, in_blocks.collect())) == sorted(map(str, whole.collect()))
    assert line_dedup.cleaned(docs, least).filter("doc_id = 500").first().text is None
    assert line_dedup.judged(docs.limit(0)).count() == 0


def test_sketch_estimates(spark):
    """Forty sketches of each size: the errors are those of 32 registers, 18 % as a root mean square."""
    names = [f"h{i}" for i in range(8)]
    rows = [(k, n, f"site{k}-{j}") for k in range(40) for n in (5, 20, 300) for j in range(n)]
    df = spark.createDataFrame(rows, "k long, n long, site string")
    df = df.select("k", "n", *[c.alias(x) for c, x in zip(line_dedup._sketch(F.col("site")), names)])
    got = df.groupBy("k", "n").agg(*[F.bit_or(x).alias(x) for x in names]).select("n", line_dedup.estimate(names).alias("e")).collect()
    for n in (5, 20, 300):
        errors = [r.e / r.n - 1 for r in got if r.n == n]
        assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.24
        assert all(abs(e) < 2 / 3 for e in errors)  # the band that is counted exactly
