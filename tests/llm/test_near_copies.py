"""Verified near copies against brute-force Jaccard."""

import random

import pytest

import corpus_pipeline
from echoline.llm import near_copies


def plain(text, words=5):
    t = (text or "").lower().split()
    return {tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))}


def kept(rows):
    """Smallest id of each component of pairs with similarity 0.8 or more, and those pairs."""
    sets, root, pairs = [plain(t) for _, t in rows], list(range(len(rows))), []

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values()), pairs


def corpus():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [[word() for _ in range(rng.randrange(80, 300))] for _ in range(60)]

    def edited(t, share):
        t = list(t)
        for i in rng.sample(range(len(t)), max(1, int(share * len(t)))):
            t[i] = word()
        return t

    near = [edited(texts[i % 40], rng.choice([0.01, 0.015, 0.02, 0.03, 0.05])) for i in range(120)]
    hot = [edited(texts[59], 0.02) for _ in range(60)]
    chain = [texts[58]]
    for _ in range(25):
        chain.append(edited(chain[-1], 0.02))
    all_ = [" ".join(t) for t in texts + near + hot + chain[1:]] + ["", " \n", "one two", "One  two"]
    ids = list(range(len(all_)))
    rng.shuffle(ids)
    return list(zip(ids, all_, strict=True))


@pytest.mark.parametrize("tile", [32, 512])
def test_near_dedup_against_brute_force(spark, tile):
    rows = corpus()
    want, pairs = kept(rows)
    assert len(pairs) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = near_copies.near_dedup(docs, tile=tile, sets=tile)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == want


def test_pipeline_stage_finds_copies_of_similarity_080(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == kept(rows)[0]


def test_links_beside_the_hub(spark):
    """The least candidate is like none of the others, which are like each other."""
    base = [f"a{i}" for i in range(100)]
    rows = [(1, " ".join(base[:60] + [f"b{i}" for i in range(40)]))] + [(i, " ".join([*base, f"c{i}"])) for i in range(2, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in near_copies.near_dedup(docs).collect()) == [1, 2]


def test_empty_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "A b  c d e f"), (3, "k l m n o"), (3, "k l m n o"), (5, None), (6, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.near_dedup(docs).collect()) == [3, 4, 5]
    assert near_copies.near_dedup(docs.limit(0)).count() == 0
