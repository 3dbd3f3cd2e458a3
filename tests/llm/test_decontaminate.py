import random

from echoline.llm import decontaminate as dc


def distance(pattern, text):
    """Least edit distance of the pattern to any substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_against_table():
    rng = random.Random(5)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        assert dc.myers(dc.masks_of(p), len(p), t, len(p))[0] == min(distance(p, t), len(p) + 1)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        what = rng.randrange(3)
        if what == 0:
            chars[i] = rng.choice("xyz")
        elif what == 1:
            del chars[i]
        else:
            chars.insert(i, rng.choice("xyz"))
    return "".join(chars)


def test_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(8, 40))) for i in range(12)] + [(12, "tiny item"), (16, "tinier a"), (13, None), (14, " . "), (None, prose(20)), (15, "word, Word")]
    docs = []
    for i in range(80):
        parts = [prose(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            j = rng.choice([0, 1, 2, 3, 4, 12, 15, 16])
            text = items[15 if j == 16 else j][1] if j != 15 else "WORD word"
            parts += [edited(rng, text, rng.randrange(0, 14)) if j < 5 else text.upper(), prose(rng.randrange(0, 30))]
        docs.append((i, " ".join(parts)))
    docs += [(103, "a tiny itm b"), (104, "gtinier a"), (105, "word wrd"), (106, "x " * 1500 + items[1][1] + " y" * 1500), (100, None), (101, ""), (101, ""), (102, items[0][1]), (102, items[0][1])]
    truth = []
    for d, text in docs:
        plain = dc.normalise(text)
        for item, body in items:
            norm = dc.normalise(body)
            if int(0.1 * len(norm)):
                if (x := distance(norm, plain)) <= int(0.1 * len(norm)):
                    truth.append((d, item, x))
            elif norm and f" {norm} " in f" {plain} ":
                truth.append((d, item, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda x: (x[0], -1 if x[1] is None else x[1], x[2])
    for chars in (4_000_000, 150):
        found = dc.leaks(df, bench, block_chars=chars).collect()
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in found), key=key) == sorted(truth, key=key)
    again = dc.decontaminate(df, bench, block_chars=150)
    assert sorted(r.doc_id for r in again.collect()) == sorted(d for d, _ in docs if d not in {x[0] for x in truth})
    norm = {d: dc.normalise(t) for d, t in docs}
    whole = {i: dc.normalise(t) for i, t in items}
    for r in found:
        assert distance(norm[r.doc_id][r.start : r.end], whole[r.item_id]) <= r.distance or r.distance == 0
    clean = dc.decontaminate(df.selectExpr("*", "1 AS hits", "2 AS part_hits"), bench)
    assert clean.columns == ["doc_id", "text", "hits", "part_hits"]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {x[0] for x in truth})
    assert dc.leaks(df, bench.limit(0)).count() == 0 and dc.leaks(df.limit(0), bench).count() == 0
