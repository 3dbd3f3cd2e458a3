import random
import zlib

import numpy as np

from echoline.llm import langid

WORDS = {"en": "the and with that shall them other this".split(), "de": "der und nicht über schön eine ich auch".split(), "fr": "être dans que élève les vous une était".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def fixture(spark, extra=()):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang := rng.choice(list(WORDS)), rng.randrange(5, 60)), lang, 7) for i in range(240)]
    return rows, spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string, lang_pred int")


def test_held_out_accuracy_and_cases(spark):
    odd = [(1000, None, "en", 0), (1001, "", "de", 0), (1002, "12 ... 34", "fr", 0), (1003, "漢字かな", None, 0), (1004, "the and with " * 20000, None, 0), (None, prose(random.Random(1), "de", 30), "de", 0)]
    rows, docs = fixture(spark, odd)
    out = langid.judged(docs).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    for i, _, lang, _ in rows:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and by[i].lang_pred == lang and 0 <= by[i].score <= 1
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred in WORDS and by[1004].lang_pred == "en" and by[None].lang_pred == "de"
    kept = langid.filter_language(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i, *_ in rows} and kept.filter("doc_id IN (1000, 1001, 1002)").count() == 0
    assert langid.judged(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.judged(docs.withColumn("lang", docs.lang.substr(99, 1)).filter("doc_id < 5")).collect()} == {""}


def test_label_is_no_input_of_a_prediction(spark):
    rows, docs = fixture(spark)
    model = langid.train(docs)
    one = langid.predict(docs, model, "p", "s").select("doc_id", "p", "s").collect()
    other = langid.predict(docs.selectExpr("doc_id", "text", "'xx' AS lang", "lang_pred"), model, "p", "s").select("doc_id", "p", "s").collect()
    assert sorted(one) == sorted(other)


def test_default_names_replace_columns(spark):
    _, docs = fixture(spark)
    out = langid.predict(docs.selectExpr("*", "'x' AS SCORE"), langid.train(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {r.lang_pred for r in out.collect()} <= set(WORDS)


def test_set_of_languages_against_all_subsets(spark):
    """The set that backward steps choose is worth as much as the best of all seven."""
    from itertools import combinations

    _, docs = fixture(spark)
    model = langid.train(docs)
    rng = random.Random(11)
    for parts in (("en", 40), ("de", 3)), (("en", 300), ("fr", 200)), (("en", 100), ("de", 100), ("fr", 100)), (("fr", 25),), (("de", 6), ("en", 5)):
        text = " ".join(prose(rng, x, n) for x, n in parts)
        at, n = model._features(text)
        p, cost = model.p[at], model.penalty * np.log(n.sum() + 1)
        best = max(
            ((like / 3 - cost * k, chosen, share) for k in (1, 2, 3) for chosen in combinations(range(3), k) for share, like in [model._fit(p[:, list(chosen)], n)]),
            key=lambda x: x[0],
        )
        lang, score = model.predict(text)
        assert lang == model.langs[best[1][int(np.argmax(best[2]))]]
        assert len(best[1]) == 1 or abs(score - best[2].max()) < 0.02


def test_mixture_against_grid(spark):
    _, docs = fixture(spark)
    model = langid.train(docs)
    rng = random.Random(8)
    text = prose(rng, "en", 300) + " " + prose(rng, "de", 200)
    lang, score = model.predict(text)
    assert lang == "en" and 0.5 < score < 0.7
    at, n = model._features(text)
    share, like = model._fit(model.p[at], n)
    best = max(
        float(n @ np.log(model.p[at] @ np.array([a, b, 1 - a - b])))
        for a in np.linspace(0.01, 0.98, 98) for b in np.linspace(0.01, 0.98, 98) if 0 < a + b < 1
    )
    assert like >= best - 0.5 and abs(share.sum() - 1) < 1e-9
