import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from echoline.llm import lm_score

K = 16.0


def words(text):
    return (text or "").encode().lower().split() + [b" "]


class Plain:
    """The model by dictionaries over all training tokens."""

    def __init__(self, texts):
        self.c, self.pairs, self.triples = Counter(), Counter(), Counter()
        for t in texts:
            w = words(t)
            self.c.update(w)
            self.pairs.update(zip([b" ", *w], w))
            self.triples.update(zip([b" ", *w], w, w[1:]))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d = lm_score.discount(sum(k == 1 for k in self.c.values()), sum(k == 2 for k in self.c.values()))

    def p(self, history, w):
        if not history:
            return (self.c[w] - self.d) / self.n if self.c[w] else (self.d * self.v / self.n if self.n else 0.5)
        seen, with_w = (self.c, self.pairs) if len(history) == 1 else (self.pairs, self.triples)
        n = seen[history[0] if len(history) == 1 else history]
        return (with_w[(*history, w)] + K * self.p(history[1:], w)) / (n + K)

    def score(self, text):
        """Always from the longest history; an unseen one leaves all to the shorter."""
        total, history = 0.0, (b" ",)
        for w in words(text):
            total += math.log10(self.p(history, w))
            history = (*history, w)[-2:]
        return total


def brute(rows):
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    m = Plain([t for i, t in rows if not out_of(i)])
    result = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((m.c[x] + 0.1) / (m.n + 0.1 * (m.v + 1))) for x in w)
        result.append((-1 if i is None else i, out_of(i), len(w), sum(m.c[x] > 0 for x in w), m.n, round(base, 6), round(m.score(t), 6)))
    return sorted(result)


@pytest.mark.parametrize("sizes", [{}, {"block_mb": 0.002, "shard_entries": 400}])
def test_against_brute_force(spark, sizes):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)] + ["Straße", "É", "x\xa0y"]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([20, 303])]) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    rows += [(i, rows[i - 400][1].upper()) for i in range(400, 420)] + [(900, None), (901, ""), (902, "\t\n"), (5, rows[5][1]), (None, "w1 w2"), (903, "w1 " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS held_out")
    out = lm_score.score(docs, **sizes).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out)
    assert found == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(docs).count() == 0
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = lm_score.score(only).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.score == pytest.approx(3 * math.log10(0.5))


def model(texts, training, bits=3):
    """A block with the automaton that its own shards' answers make."""
    block = lm_score.Block(texts, training)
    requests = defaultdict(list)
    for s, packed in block.requests(bits):
        requests[s].append(packed)
    parts, figures = [], 0
    for s in sorted(requests):
        out, part = lm_score.add_up(requests[s])
        parts.append(lm_score.unpack(out[0]))
        figures = figures + part
    counts = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
    return block, lm_score.Automaton(block, counts, figures, K)


def test_traversal_carries_the_state():
    """Seen and unseen histories of both lengths: states go up to pairs and fall back to the root."""
    texts = [b"a b c d", b"a b c e", b"x y", b"", b"a b c d a b c", b"c c c c q a b"]
    block, machine = model(texts, [True, True, True, True, False, False])
    plain = Plain([t.decode() for t in texts[:4]])
    for few in (0, 100):
        assert np.allclose(machine.traverse(block, few), [plain.score(t.decode()) for t in texts])
    state, path = machine.start, []
    for pos in range(block.starts[5], block.starts[5] + block.sizes[5]):
        row = int(machine.rows(np.array([state]), [a[[pos]] for a in block.at])[0])
        state = int(machine.target[row])
        path.append("root" if state < 0 else "pair" if state >= machine.pairs else "word")
    #: "start c" is unseen and ends at the word; "c c" is unseen; "q" is unknown; "a" after the root is a word, then "a b" a pair.
    assert path == ["word", "word", "word", "word", "root", "word", "pair", "word"]


def test_long_documents_alone_and_together():
    rng = random.Random(4)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c"]) for _ in range(n)) for n in (3000, 1, 70, 3000, 200, 90000)]
    block, machine = model(texts, [True] * 6)
    assert np.allclose(machine.traverse(block, 0), machine.traverse(block, 100))


def test_model_sums_to_one():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") for _ in range(9)) for _ in range(20)]
    m = Plain(texts)
    known = [*m.c, b"never seen"]
    for history in [(), *[(w,) for w in m.c], *[h for h in m.pairs if h[1] != b" "]]:
        assert sum(m.p(history, w) for w in known) == pytest.approx(1.0)


@pytest.mark.parametrize("bits", [0, 1, 6])
def test_requests_and_answers(bits):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(30))).encode() for _ in range(40)]
    block, machine = model(texts, [i % 3 > 0 for i in range(40)], bits)
    plain = Plain([t.decode() for i, t in enumerate(texts) if i % 3])
    assert np.allclose(machine.traverse(block), [plain.score(t.decode()) for t in texts])


def test_texts_are_shuffled_once(spark, tmp_path):
    """Shuffled bytes, requests and answers included, are fewer than the texts': two shuffles of them alone were more."""
    rng = random.Random(10)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(6, 14))) for _ in range(3000)]
    kinds = [" ".join(rng.choice(vocab) for _ in range(4000)) for _ in range(20)]
    rows = [(i, kinds[i % 20]) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "docs"))
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    assert len(lm_score.score(spark.read.parquet(str(tmp_path / "docs")), spread_mb=0).collect()) == 200
    assert written() - before < sum(len(t) for _, t in rows)


def test_blocks_follow_the_rows_not_their_batches():
    rng = random.Random(11)
    texts = [None if rng.random() < 0.1 else b"x" * rng.choice([0, 1, 9, 40, 500]) for _ in range(300)]
    table = pa.table({"doc_id": pa.array(range(300), pa.int64()), "text": pa.array(texts, pa.binary())})
    seen = []
    for size in (1, 7, 64, 1000):
        blocks = list(lm_score.cut(iter(table.to_batches(max_chunksize=size)), 200))
        assert pa.concat_tables(blocks).equals(table) and max(b.num_rows for b in blocks) <= 200
        assert all(sum(len(t or b"") + 1 for t in b["text"].to_pylist()) >= 200 for b in blocks[:-1])
        assert all(lm_score.unpress(lm_score.press(b)).equals(b) for b in blocks)
        seen.append([(b.num_rows, lm_score.number(b, 3, k)) for k, b in enumerate(blocks)])
    assert seen.count(seen[0]) == len(seen) and len(set(seen[0])) == len(seen[0]) > 20
    assert list(lm_score.cut(iter([]), 200)) == []


def test_equal_blocks_are_counted_each(spark):
    """Partitions and blocks with the same rows keep their own numbers."""
    rows = [(1, "a b a"), (1, "a b a")] * 8
    out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_mb=0.00001, spread_mb=0).collect()
    assert sorted({(r.n_tokens, r.train_tokens) for r in out}) == [(4, 64)] and len(out) == 16


@pytest.mark.parametrize("spread_mb", [0, 64])
def test_other_rows_at_the_second_reading_stop_the_job(spark, spread_mb):
    def run(batches):
        import os

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([os.urandom(4).hex() for _ in range(batch.num_rows)])], names=["doc_id", "text"])

    docs = spark.range(8).mapInArrow(run, "doc_id long, text string")
    with pytest.raises(Exception, match="second reading"):
        lm_score.score(docs, spread_mb=spread_mb).collect()


@pytest.mark.parametrize("spread_mb", [0, 64])
def test_partitions_cut_and_spread(spark, spread_mb):
    rng = random.Random(12)
    rows = [(i, None if i % 50 == 3 else " ".join(f"w{int(rng.paretovariate(0.6)) % 20000}" for _ in range(rng.randrange(0, 900)))) for i in range(1500)]
    out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block_mb=0.1, shard_entries=20_000, spread_mb=spread_mb).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out) == brute(rows)


def test_requests_leave_the_disk_before_texts_are_shuffled(spark):
    """The shuffle of the requests is freed once their totals are stored, not whenever the driver next collects garbage."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        names = {found.apply(i).getName() for i in range(found.size())}
        return {n: files.getFile(n).length() for n in names if n.endswith(".data")}

    rows = [(i, " ".join(f"w{i * j % 997}" for j in range(30))) for i in range(300)]
    before = shuffles()
    scored = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), block_mb=0.002, shard_entries=400)
    end = time.time() + 20
    #: The requests are some 180 kB; what sums leave is a few hundred bytes each.
    while (left := sum(size for name, size in shuffles().items() if name not in before)) > 5000 and time.time() < end:
        time.sleep(0.2)
    assert left <= 5000 and scored.count() == 300


def test_messages_keep_lengths_and_widths():
    for n in (0, 1, 90, 255, 256, 70_000):
        columns = [np.arange(n, dtype=np.int64) * k for k in (0, 1, 2**20)] + [np.full(n, 2**64 - 1, np.uint64)]
        back = lm_score.unpack(lm_score.pack(*columns))
        assert all(np.array_equal(a.astype(np.uint64), b) for a, b in zip(columns, back, strict=True))
    assert len(lm_score.pack(*[np.ones(1, np.int64)] * 6)) < 40
