import random

import numpy as np
import pytest
import xxhash

from echoline.llm import simhash
from echoline.llm.components import connected_components


def brute(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def plain(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c d", "A b  c\td e f g", "é\xa0x y z É w", "x " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain(text)


def test_planes_against_popcount():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    prints[100:200] = prints[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    for radius in (0, 1, 3, 4, 7):
        rows, masks = simhash.Planes(prints).near(prints, radius)
        lanes = np.unpackbits(masks.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")[:, :300]
        truth = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
        assert (truth[rows] == lanes.astype(bool)).all() and not truth[np.setdiff1d(np.arange(300), rows)].any()


@pytest.mark.parametrize("tile", [16, 4096])
def test_components_against_brute_force(spark, tile):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for i in range(150):  # chains of near prints, and a hot bucket
        x = prints[i if i < 100 else 0]
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64 if i < 100 else 12)
        prints.append(x)
    prints += prints[:20] + [0, 0]
    ids = list(range(1000, 1000 + len(prints)))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long")
    nodes = df.select("fp").distinct()
    roots = connected_components(simhash.links(nodes, 4, tile=tile), 0 if tile == 16 else 500_000)
    found = {r.fp: r.root for r in df.join(roots.withColumnRenamed("node", "fp"), "fp", "left").collect()}
    truth = brute(ids, prints)
    classes = {}
    for i, f in zip(ids, signed):
        classes.setdefault(found[f] if found[f] is not None else f, set()).add(i)
    wanted = {}
    for i, c in truth.items():
        wanted.setdefault(c, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_judged(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(1, base, 0), (2, base, 1), (3, base + " tail", 2), (4, "", 3), (5, None, 4), (6, "short", 5), (7, base.upper(), 6), (None, base, 7), (7, base.upper(), 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = simhash.judged(docs).collect()
    assert len(out) == 9
    by = {r.doc_id: r for r in out}
    prints = [plain(t) for _, t, _ in rows[:7]]
    truth = brute([1, 2, 3, 4, 5, 6, 7], prints)
    assert {i: by[i].component_id for i in truth} == truth and by[None].component_id == 1
    assert all(by[i].fingerprint == f"{p:016x}" for i, p in zip(range(1, 8), prints))
    assert simhash.judged(docs.limit(0)).count() == 0


def test_stars_of_a_partition():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 30), (200, 400), (1000, 700)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        root = list(range(n))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for x, y in zip(a, b):
            p, q = sorted((find(x), find(y)))
            root[q] = p
        from echoline.llm.components import stars

        got = dict(zip(*(z.tolist() for z in stars(a, b))))
        assert got == {i: find(i) for i in {*a.tolist(), *b.tolist()} if find(i) != i}
