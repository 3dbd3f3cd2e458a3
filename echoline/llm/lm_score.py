"""Language-model scoring with a weighted backoff automaton.

Model: trigrams with Dirichlet smoothing over two levels. With c the counts of the training
documents, P(w | a b) = (c(a b w) + k P(w | b)) / (c(a b) + k), P(w | b) = (c(b w) + k P(w)) / (c(b) + k), and
P(w) is the count of w less Ney's discount n1 / (n1 + 2 n2), whose mass goes to the one class of
unknown words. The states of the automaton are the histories seen in training: two words, one
word, none. A state has an arc for every word seen after its history, weighted log10 P, and one
failure arc to the history without its first word, weighted log10 of k / (c + k), the mass that smoothing
frees; the root has an arc for every known word and one for all unknown words. An arc leads to
the longest history that is a state. One traversal of a document from left to right
carries the state and adds up the weights.

Scale: neither the model nor the corpus's counts fit anywhere whole. Every partition cuts its
rows, as they come, into blocks of about ``block_mb`` of text. A block sorts the hashes of its distinct
n-grams and sends every shard those of its range, with their counts from training
documents; a shard adds up the blocks' counts and sends back, in the same order, the totals
of just the n-grams that the block asked for. The block then builds the part of the automaton
that its documents can reach and traverses them. N-grams are hashed whole, so a
frequent word has no shard of its own: it is one entry a block, as any other n-gram is.
Shards hold about ``shard_entries`` entries of all blocks.

Texts are read twice and shuffled once, to meet the answers, a compressed block a row. Both readings must bring
the same rows in the same order, as files do. A block's number holds a hash of its content, so that one that
finds no answers, or answers that find no block, stop the job.

Words are told apart by 56 bits within their shard (64 in all at most), longer n-grams by 44: of those one in
ten million is counted with another.

Cases: a null text is empty and consists of the end token alone; a null id counts as the
empty text for the folds (crc32 0: held out); repeated rows count and are scored each; an
empty table gives an empty result; without training documents the score is that of
a uniform choice among unknown words and the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import free_shuffles, held_out, materialise, release

#: A token that no word can equal, for the end of a document; as a history it is a document's start.
END = b" "
#: Bits by which shards tell n-grams of each order apart.
_WIDTH = (56, 44, 44)
ORDER = len(_WIDTH)


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words and one end."""
    return [*(text or b"").lower().split(), END]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Grams:
    """The distinct n-grams of one order in a block, sorted by hash. A block has fewer than 2^31 tokens."""

    def __init__(self, keys: np.ndarray, learn: np.ndarray):
        order = np.argsort(keys)
        found = keys[order]
        order = order.astype(np.int32)
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        starts = np.flatnonzero(new)
        self.hashes = found[starts]
        del found
        #: One occurrence of each, which n-gram each occurrence is, and the count in training documents.
        self.one = order[starts]
        self.which = np.empty(len(keys), np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - 1
        self.counts = np.add.reduceat(learn[order].astype(np.int32), starts) if len(starts) else np.empty(0, np.int32)


class Block:
    """The n-grams of some documents. ``at[k]`` has for each token the number of the k+1-gram that ends there."""

    def __init__(self, texts: list[bytes | None], training: list[bool]):
        import xxhash

        place: dict[bytes, int] = {END: 0}
        setdefault = place.setdefault
        ids = [np.array([setdefault(w, len(place)) for w in tokens(t)], np.int32) for t in texts]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w, 7) for w in place), np.uint64, len(place))
        self.sizes = np.array([len(d) for d in ids], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        del place, setdefault, ids
        learn = np.repeat(np.array(training, bool), self.sizes)
        word = hashes[flat]
        del flat
        before = np.empty_like(word)
        before[1:], before[self.starts] = word[:-1], hashes[0]
        pair = _mixed(before, word)
        #: A document's first token has no history of two.
        third = np.ones(len(word), bool)
        third[self.starts] = False
        last = np.flatnonzero(third)
        triple = _mixed(pair[last - 1], word[last] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        pairs = Grams(pair, learn)
        del pair
        triples = Grams(triple, learn[last])
        del triple
        words = Grams(word, learn)
        del word
        self.grams = [words, pairs, triples]
        third_at = np.zeros(len(before), np.int32)
        third_at[last] = triples.which
        self.at = [words.which, pairs.which, third_at]
        #: The start of a document, as a word; it is there, as every document has an end.
        self.start = int(np.searchsorted(words.hashes, hashes[0]))
        #: Of each pair its two words; of each triple the pair that it begins with and the one that it ends with.
        first_word = np.searchsorted(words.hashes, before[pairs.one])
        self.pair = first_word, words.which[pairs.one]
        ends = last[triples.one] if len(last) else last
        self.triple = pairs.which[ends - 1], pairs.which[ends]

    def requests(self, bits: int) -> list[tuple[int, bytes]]:
        """(shard, packed n-grams) for each of the ``2 ** bits`` shards that this block has n-grams of."""
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
        cuts = [np.concatenate([[0], np.searchsorted(g.hashes, edges), [len(g.hashes)]]) for g in self.grams]
        short = [(g.hashes << np.uint64(bits)) >> np.uint64(64 - w) for g, w in zip(self.grams, _WIDTH, strict=True)]
        out = []
        for s in range(1 << bits):
            runs = [(c[s], c[s + 1]) for c in cuts]
            if any(i < j for i, j in runs):
                parts = []
                for g, x, (i, j) in zip(self.grams, short, runs, strict=True):
                    parts += [np.diff(x[i:j], prepend=np.uint64(0)), g.counts[i:j]]
                out.append((s, pack(*parts)))
        return out


def cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows in blocks that end with the row that brings their texts to ``limit`` bytes, whatever batches they come in."""
    held: list[pa.RecordBatch] = []
    room = limit
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = spent = 0
        while at < batch.num_rows:
            last = min(int(np.searchsorted(ends, spent + room)), batch.num_rows - 1)
            held.append(batch.slice(at, last + 1 - at))
            room -= int(ends[last]) - spent
            at, spent = last + 1, int(ends[last])
            if room <= 0:
                yield pa.Table.from_batches(held)
                held, room = [], limit
    if held:
        yield pa.Table.from_batches(held)


def number(table: pa.Table, partition: int, nth: int) -> int:
    """The number of the ``nth`` block of a partition: a hash of its place and of its rows."""
    import xxhash

    texts = table["text"].to_pylist()
    rows = [(i, None if t is None else len(t)) for i, t in zip(table["doc_id"].to_pylist(), texts, strict=True)]
    digest = xxhash.xxh64(repr((partition, nth, rows)).encode())
    for t in texts:
        digest.update(t or b"")
    return digest.intdigest() - (1 << 63)


def press(table: pa.Table) -> bytes:
    """A block as one compressed value."""
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpress(data: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers: all lowest bytes, then the next, compressed."""
    import zstandard

    parts = [bytes([len(columns)])]
    for c in columns:
        width, length = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0, (len(c).bit_length() + 7) // 8
        planes = np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
        #: Most messages of a large corpus are short: as few bytes of length as it has.
        parts += [bytes([width << 4 | length]), len(c).to_bytes(length, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    view = memoryview(zstandard.ZstdDecompressor().decompress(data))
    at, out = 1, []
    for _ in range(view[0]):
        width, length = view[at] >> 4, view[at] & 15
        at += 1 + length
        n = int.from_bytes(view[at - length : at], "little")
        values = np.zeros((n, 8), np.uint8)
        values[:, :width] = np.frombuffer(view, np.uint8, n * width, at).reshape(width, n).T
        out.append(values.view("<u8").reshape(-1))
        at += n * width
    return out


def add_up(requests: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Totals for each request of a shard, and its part of the corpus's figures: tokens, distinct words, words seen once and twice."""
    parts = [unpack(r) for r in requests]
    answers: list[list[np.ndarray]] = [[] for _ in parts]
    figures = np.zeros(4, np.int64)
    for k in range(ORDER):
        keys = np.concatenate([np.cumsum(p[2 * k], dtype=np.uint64) for p in parts])
        counts = np.concatenate([p[2 * k + 1] for p in parts])
        known, which = np.unique(keys, return_inverse=True)
        totals = np.bincount(which, counts.astype(float), minlength=len(known)).astype(np.int64)
        if not k:
            figures[:] = totals.sum(), (totals > 0).sum(), (totals == 1).sum(), (totals == 2).sum()
        mine, i = totals[which], 0
        for answer, p in zip(answers, parts, strict=True):
            answer.append(mine[i : i + len(p[2 * k])])
            i += len(p[2 * k])
    return [pack(*a) for a in answers], figures


def discount(once: int, twice: int) -> float:
    """Ney's estimate of the absolute discount, kept inside (0, 1)."""
    return min(0.999, max(0.001, once / (once + 2 * twice) if once else 0.001))


class Automaton:
    """The part of the model that a block's documents can reach, its steps compiled.

    States: a pair's number + ``pairs``, a word's number, or the root, -1. A step takes a token from a state of
    k words: row ``base[k]`` + the number of the k+1-gram that the token ends. ``weight`` and ``target`` of a row
    are those of its arc or, where training has no such n-gram, of the failure arc and the row that it leads to.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], figures: np.ndarray, strength: float):
        words, pairs, triples = counts
        n, v = int(figures[0]), int(figures[1])
        d = discount(int(figures[2]), int(figures[3]))
        self.pairs = len(words)
        p1 = np.where(words > 0, (words - d) / max(n, 1), d * v / n if n else 0.5)
        known = words > 0
        self.unknown = np.log10(d * v / n if n else 0.5)
        w1, t1 = np.log10(p1), np.where(known, np.arange(len(words), dtype=np.int32), np.int32(-1))

        first, second = block.pair
        fail = np.log10(strength / (words + strength))
        p2 = (pairs + strength * p1[second]) / (words[first] + strength)
        w2 = np.where(pairs > 0, np.log10(p2), fail[first] + w1[second])
        t2 = np.where(pairs > 0, np.arange(self.pairs, self.pairs + len(pairs), dtype=np.int32), t1[second])

        history, suffix = block.triple
        fail = np.log10(strength / (pairs + strength))
        p3 = (triples + strength * p2[suffix]) / (pairs[history] + strength)
        w3 = np.where(triples > 0, np.log10(p3), fail[history] + w2[suffix])
        self.weight = np.concatenate([w1, w2, w3])
        #: A triple that training has ends with a pair that it has.
        self.target = np.concatenate([t1, t2, t2[suffix]])
        self.base = np.array([0, len(words), len(words) + len(pairs)])
        self.start = int(t1[block.start])

    def rows(self, states: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
        """The rows of steps from ``states``; ``at``: numbers of the 1-, 2- and 3-grams that the tokens end."""
        return np.where(states >= self.pairs, self.base[2] + at[2], np.where(states >= 0, self.base[1] + at[1], at[0]))

    def traverse(self, block: Block, few: int = 16) -> np.ndarray:
        """log10 probability of every document: a traversal that carries the state, for all documents at once, the longest alone at the end."""
        order = np.argsort(-block.sizes, kind="stable")
        sizes, starts = block.sizes[order], block.starts[order]
        states, totals = np.full(len(order), self.start), np.zeros(len(order))
        live, t = len(order), 0
        while live and (live > few or sizes[0] - t < 64):
            pos = starts[:live] + t
            row = self.rows(states[:live], [a[pos] for a in block.at])
            totals[:live] += self.weight[row]
            states[:live] = self.target[row]
            t += 1
            while live and sizes[live - 1] <= t:
                live -= 1
        for i in range(live):
            totals[i] += self._alone(block, int(starts[i]) + t, int(starts[i] + sizes[i]), int(states[i]))
        out = np.empty(len(order))
        out[order] = totals
        return out

    def _alone(self, block: Block, begin: int, end: int, state: int, step: int = 1 << 16) -> float:
        total, base, pairs = 0.0, self.base.tolist(), self.pairs
        for low in range(begin, end, step):
            high = min(low + step, end)
            each = [zip((self.weight[b + a[low:high]]).tolist(), (self.target[b + a[low:high]]).tolist(), strict=True) for b, a in zip(base, block.at, strict=True)]
            for one, two, three in zip(*each, strict=True):
                weight, state = three if state >= pairs else two if state >= 0 else one
                total += weight
        return total


class Scores:
    """Scores every row of ``docs``; see the module for the model and the plan.

    ``strength``: k of the smoothing. ``spread_mb``: tables with less text, which may be one row group and so one task,
    are dealt out by row first.
    """

    def __init__(self, docs: DataFrame, block_mb: float = 8.0, shard_entries: int = 3_000_000, strength: float = 16.0, spread_mb: float = 64.0):
        self.docs, self.strength = docs, strength
        size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        n_bytes = (size[0] or 0) + size[1]
        cores = docs.sparkSession.sparkContext.defaultParallelism
        #: Tasks of a megabyte at least.
        self.spread = max(1, min(cores, int(n_bytes // 1e6))) if n_bytes < spread_mb * 1e6 else 0
        self.limit = max(1, int(block_mb * 1e6))
        self.blocks = max(1, round(n_bytes / self.limit))
        #: About two entries for every five bytes, of the three orders.
        self.bits = max(0, round(np.log2(max(1, 0.4 * n_bytes / shard_entries))))

    def scored(self) -> DataFrame:
        bits, strength, limit = self.bits, self.strength, self.limit
        out = held_out(F.col("doc_id"), 10, 0)
        rows = self.docs.select("doc_id", out.alias("held_out"), F.col("text").cast("binary").alias("text"))
        if self.spread:
            #: Sorted, since both readings must bring the same order.
            rows = rows.withColumn("row", F.monotonically_increasing_id()).repartition(self.spread, "row").sortWithinPartitions("row").drop("row")

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
            from pyspark import TaskContext

            partition = TaskContext.get().partitionId()
            for nth, table in enumerate(cut(batches, limit)):
                yield number(table, partition, nth), table
            release()

        def of(table: pa.Table) -> Block:
            return Block(table["text"].to_pylist(), [not h for h in table["held_out"].to_pylist()])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, table in numbered(batches):
                asked = of(table).requests(bits)
                columns = [pa.array([r[0] for r in asked], pa.int32()), pa.array([block] * len(asked), pa.int64()), pa.array([r[1] for r in asked], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "packed"])

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, table in numbered(batches):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([press(table)], pa.binary())], names=["block", "texts"])

        def total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            totals, figures = add_up(table["packed"].to_pylist())
            return pa.table({
                "block": pa.concat_arrays([*table["block"].chunks, pa.array([None], pa.int64())]), "shard": pa.array([key[0].as_py()] * (len(totals) + 1), pa.int32()),
                "packed": pa.array([*totals, pack(figures)], pa.binary()),
            })

        asked = rows.mapInArrow(ask, "shard int, block long, packed binary")
        totals = asked.repartition(self._tasks(1 << bits), "shard").groupBy("shard").applyInArrow(total, "block long, shard int, packed binary")
        totals = materialise(totals, "totals")
        #: A shard's own row has no block.
        figures = _figures(totals.filter("block IS NULL"))
        #: The job of the figures has replaced what Spark still held of the one before.
        del asked
        free_shuffles(self.docs.sparkSession)

        def score(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
            if texts.num_rows != 1 or not answers.num_rows:
                raise RuntimeError("the second reading of the documents brought other rows than the first, or in another order; store them first")
            table = unpress(texts["texts"][0].as_py())
            b = of(table)
            columns = zip(*[unpack(x) for x in answers.sort_by("shard")["packed"].to_pylist()], strict=True)
            counts = [np.concatenate(c).astype(np.int64) for c in columns]
            machine = Automaton(b, counts, figures, strength)
            n, v = int(figures[0]), int(figures[1])
            word = b.at[0]
            base = np.log10((counts[0] + 0.1) / (n + 0.1 * (v + 1)))
            return pa.table({
                "doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": pa.array(b.sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((counts[0] > 0)[word].astype(np.int64), b.starts), pa.int64()),
                "train_tokens": pa.array(np.full(len(b.sizes), n), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base[word], b.starts), pa.float64()),
                "score": pa.array(machine.traverse(b), pa.float64()),
            })

        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        #: Blocks are few and large: as many tasks, so that chance puts few into one.
        tasks = self._tasks(2 * self.blocks)
        kept = rows.mapInArrow(keep, "block long, texts binary").repartition(tasks, "block")
        answers = totals.filter("block IS NOT NULL").repartition(tasks, "block")
        return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)

    def _tasks(self, groups: int) -> int:
        """Tasks for so many groups: two groups a task, as many as the session's setting at least."""
        return max(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 2)


def _figures(parts: DataFrame) -> np.ndarray:
    """Four numbers for the whole corpus, added up in Spark."""
    names = ["n", "v", "once", "twice"]

    def run(batches):
        for batch in batches:
            rows = [unpack(x)[0].astype(np.int64) for x in batch.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.array(rows).T], names=names)

    row = parts.select("packed").mapInArrow(run, ", ".join(f"{c} long" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    return np.array([x or 0 for x in row], np.int64)


def score(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    return Scores(docs.select(F.col("doc_id").cast("long"), "text"), **options).scored()
