"""run() against a plain version of its stages on a small corpus."""

import random
import re

import corpus_pipeline
from echoline.llm import decontaminate, langid, queries
from echoline.llm.mixing import Mix

WORDS = {"en": "the and with that shall them other this water pipe".split(), "de": "der und nicht über schön eine ich auch rohr wasser".split()}


def corpus(spark, folder):
    rng = random.Random(5)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a", "en", "s"]) for _ in range(n))
    bench = [(i, prose("en", 25)) for i in range(6)]
    rows = []
    for i in range(160):
        lang = rng.choice(list(WORDS))
        rows.append((i, prose(lang, rng.randrange(60, 140)), lang, f"s{i % 4}" if i % 3 else "hot", 0))
    for i in range(200, 230):
        rows.append((i, rows[i - 200][1].replace(" ", "  "), "en", "copies", 0))
    for i in range(230, 250):
        rows.append((i, rows[i - 200][1] + " end", "en", "near", 0))
    for i in range(250, 256):
        rows.append((i, prose("en", 80) + " " + bench[i - 250][1].upper() + ". " + prose("en", 70), "en", "leaks", 0))
    rows += [(300, None, "en", None, 0), (301, " 12 ... ", None, "s1", 0), (302, "", "en", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_run_against_plain_stages(spark, tmp_path):
    rows, bench = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs)
    left = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= 0.4]
    assert len(left) == len(rows) - 3
    first = {}
    for r in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    left = list(first.values())
    words = [r[1].lower().split() for r in left]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(left)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(left)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = [r for i, r in enumerate(left) if find(i) == i]
    items = [decontaminate.normalise(t) for _, t in bench]
    left = [r for r in left if not any(t in decontaminate.normalise(r[1]) for t in items)]
    assert not {250, 251, 252, 253, 254, 255} & {r[0] for r in left}
    want = Mix(spark.createDataFrame(left, docs.schema)).annotate().filter("copies > 0")
    got = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "text", "source", "size", "target", "copies", "taken"]
    assert sorted(got.select(key).collect(), key=str) == sorted(want.select(key).collect(), key=str)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "mixing"]


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_ten_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
