"""Near copies: SimHash finds candidates, whole sets of shingles decide.

A document is the set of its five-word shingles. Its fingerprint is a SimHash of ``64 * wide``
bits: two sets of similarity J differ in a share of acos(2J / (1 + J)) / pi of them, 15 % at 0.8.
Documents that agree in k chosen bits share a bucket. k follows the number of documents, so that
chance puts ``per_bucket`` of them in one; the number of such choices follows from k, so
that a pair of the least similarity shares a bucket with probability ``recall`` at any size.
Buckets are compared bit-sliced (``simhash``); pairs within four standard deviations
of the expected distance are candidates, and no link rests on a fingerprint: exact Jaccard decides.

Two passes keep the work on large groups linear. In the first every document that has candidates
is verified against the least one of them, which joins a group of copies to its hub. In
the second only documents that have candidates in another component are left: what candidates
connect is compared whole, in tiles of bounded size. Equal sets are one document throughout.

Cases: a null or wordless text is one empty shingle, so such texts are alike; fewer words than a
shingle: the whole sequence is the only shingle; a null id comes last in the choice of the
one that stays; of rows that repeat id and text one stays; an empty table gives an empty result;
extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import fresh, materialise, slices, small, temporary
from echoline.llm.components import connected_components
from echoline.llm.simhash import _signed, by_bucket, forest, in_tiles, least_near, majority, shingle_hashes

_GOLDEN = 0x9E3779B97F4A7C15


def _again(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of the same things (the finaliser of SplitMix64)."""
    x = hashes + np.uint64(turn * _GOLDEN % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(shingles: np.ndarray, wide: int) -> list[int]:
    """The fingerprint of a set of hashes, in signed words."""
    return [_signed(majority(_again(shingles, i) if i else shingles)) for i in range(wide)]


def layout(n: int, least: float, bits: int, per_bucket: int, recall: float) -> tuple[list[int], int]:
    """Masks of the bits that must agree, and the largest distance of candidates."""
    differ = acos(2 * least / (1 + least)) / pi
    k = min(bits // 2, max(1, ceil(log2(max(2, n) / per_bucket)) if n > per_bucket else 1))
    tables = ceil(log(1 - recall) / log(1 - (1 - differ) ** k))
    rng = np.random.default_rng(42)
    masks = [sum(1 << int(b) for b in rng.choice(bits, k, replace=False)) for _ in range(tables)]
    return masks, int(bits * differ + 4 * sqrt(bits * differ * (1 - differ)))


def jaccard(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


class NearCopies:
    """Finds the rows of ``docs`` that go: all but one of each group that links of similarity ``least`` connect.

    ``words``: of a shingle; ``wide``: 64-bit words of a fingerprint; ``tile``: rows of a bucket, and
    ``sets``: sets that are compared in one task.
    """

    def __init__(self, docs: DataFrame, words: int = 5, least: float = 0.8, recall: float = 0.995, wide: int = 2, per_bucket: int = 128, tile: int = 4096, sets: int = 512, batch: int = 256):
        self.docs, self.words, self.least, self.recall = docs, words, least, recall
        self.wide, self.per_bucket, self.tile, self.sets, self.batch = wide, per_bucket, tile, sets, batch
        self.prints = [f"f{i}" for i in range(wide)]
        with temporary(docs.sparkSession):
            self.gone, self.repeats = self._judge()

    def _key(self) -> tuple[Column, Column]:
        return F.col("doc_id"), F.xxhash64(F.col("text"))

    def _sketched(self) -> DataFrame:
        """A slim row for each document: nid, its key, the digest of its set and its fingerprint."""
        import xxhash

        words, wide, names = self.words, self.wide, ["nid", "doc_id", "th", "sid", *self.prints]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(3).to_pylist()]
                prints = np.array([sketch(s, wide) for s in sets], np.int64).reshape(-1, wide)
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], digests, *map(pa.array, prints.T)], names=names)

        doc_id, th = self._key()
        source = self.docs.select(F.monotonically_increasing_id().alias("nid"), doc_id, th.alias("th"), F.col("text").cast("binary").alias("body"))
        schema = source.drop("body").schema.add("sid", "binary")
        for c in self.prints:
            schema = schema.add(c, "long")
        return materialise(source.mapInArrow(run, schema), "sketched")

    def _buckets(self, nodes: DataFrame, masks: list[int], columns: list[str]) -> DataFrame:
        part = lambda m, i: F.col(f"f{i}").bitwiseAND(F.lit(_signed(m >> 64 * i & (1 << 64) - 1)))
        keys = F.array(*[F.xxhash64(F.lit(t), *[part(m, i) for i in range(self.wide)]) for t, m in enumerate(masks)])
        return in_tiles(nodes.select(*columns, F.explode(keys).alias("key")), ["key"], columns, self.tile)

    def _sets(self, slim: DataFrame, nodes: DataFrame) -> DataFrame:
        """nid, set: the sorted hashes of the texts of ``nodes``, as bytes."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["nid", "set"])

        wanted = slim.join(small(nodes), "nid", "left_semi").select("nid", F.col("doc_id").alias("id"), F.col("th").alias("hash"))
        wanted = materialise(wanted, "wanted", rows=nodes.count())
        doc_id, th = self._key()
        texts = self.docs.select(doc_id.alias("doc_id"), th.alias("th"), F.col("text").cast("binary").alias("body"))
        texts = texts.join(small(wanted), doc_id.eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash"))).select("nid", "body")
        return materialise(texts.mapInArrow(run, "nid long, set binary").dropDuplicates(["nid"]), "sets")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of the pairs a, b those that are similar enough."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
                near = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in both]
                yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

        x, y = (sets.select(F.col("nid").alias(n), F.col("set").alias(f"set_{n}")) for n in "ab")
        return pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")

    def _compared(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between the members (nid, root) of each group of candidates that have unlike roots."""
        least = self.least
        sizes = materialise(groups.groupBy("group").agg(F.ceil(F.count("*") / self.sets).cast("int").alias("tiles")), "sizes", rows=groups.count())
        own = F.pmod(F.xxhash64("nid"), F.col("tiles")).cast("int")
        rows = groups.join(small(sizes), "group").select("group", "nid", "root", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"))
        rows = rows.select("group", "nid", "root", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).alias("side"))

        def run(table: pa.Table) -> pa.Table:
            nid, label = table["nid"].to_numpy(), table["root"].to_numpy().copy()
            side, cross = table["side"].to_numpy(), table["lo"][0].as_py() != table["hi"][0].as_py()
            parts = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
            size = np.array([len(s) for s in parts])
            codes = np.unique(np.concatenate(parts), return_inverse=True)[1]
            owner = np.repeat(np.arange(len(parts)), size)[np.argsort(codes, kind="stable")]
            starts, ends = np.append(0, np.cumsum(np.bincount(codes))), np.cumsum(size)
            a, b = [], []
            for i in range(len(parts)):
                want = label != label[i]
                want[: i + 1] = False
                if cross:
                    want &= side != side[i]
                if not want.any():
                    continue
                mine = codes[ends[i] - size[i] : ends[i]]
                both = np.bincount(np.concatenate([owner[starts[c] : starts[c + 1]] for c in mine]), minlength=len(parts))
                for j in np.flatnonzero(want & (both >= least * (size + size[i] - both))):
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        a.append(nid[i])
                        b.append(nid[j])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return rows.join(sets, "nid").groupBy("group", "lo", "hi").applyInArrow(run, "a long, b long")

    def _roots(self, slim: DataFrame, nodes: DataFrame) -> DataFrame:
        """node, root of the nodes that links connect."""
        n = nodes.count()
        masks, radius = layout(n, self.least, 64 * self.wide, self.per_bucket, self.recall)
        compare = lambda prints, rows, split: least_near(prints, rows["nid"], radius, split)
        found = self._buckets(nodes, masks, ["nid", *self.prints]).mapInArrow(by_bucket(["key"], self.prints, ["nid"], compare, self.batch), "a long, b long")
        #: Whoever has candidates is an a, with the least of them as its b.
        first = materialise(found.groupBy("a").agg(F.min("b").alias("b")), "first", rows=n)
        touched = first.select(F.col("a").alias("nid"))
        sets = self._sets(slim, touched)
        roots = connected_components(self._verified(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sets))

        rooted = nodes.join(touched, "nid", "left_semi").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
        rooted = materialise(rooted.select("nid", F.coalesce("root", "nid").alias("root"), *self.prints), "rooted", rows=first.count())

        def unlike(prints: np.ndarray, rows: np.ndarray, split: int | None) -> tuple[np.ndarray, np.ndarray]:
            a, b = forest(prints, radius, split, rows["root"])
            return rows["nid"][a], rows["nid"][b]

        left = self._buckets(rooted, masks, ["nid", "root", *self.prints]).mapInArrow(by_bucket(["key"], self.prints, ["nid", "root"], unlike, self.batch), "a long, b long")
        groups = connected_components(left.distinct())
        groups = materialise(groups.select(F.col("root").alias("group"), F.col("node").alias("nid")).join(small(rooted.select("nid", "root")), "nid"), "groups", rows=rooted.count())
        if groups.isEmpty():
            return roots
        known = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        return connected_components(known.union(self._compared(groups, sets)))

    def _judge(self) -> tuple[DataFrame, DataFrame | None]:
        """Keys of the rows that go, and of rows that stay but are repeated."""
        slim = self._sketched()
        by_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nid", "th")
        nodes = slim.groupBy("sid").agg(F.min("nid").alias("nid"), *[F.first(c).alias(c) for c in self.prints], F.count("*").alias("n"), F.min(by_id).alias("first"))
        nodes = materialise(nodes, "nodes", rows=slim.count())
        roots = self._roots(slim, nodes.select("nid", *self.prints))
        some = roots.count()
        many = nodes.join(small(roots.withColumnRenamed("node", "nid")), "nid", "left").filter("n > 1 OR root IS NOT NULL")
        many = materialise(many.select("sid", F.coalesce("root", "nid").alias("root"), "first"), "many", rows=some + nodes.filter("n > 1").count())
        keeps = many.groupBy("root").agg(F.min("first").alias("keep"))
        targets = materialise(many.join(keeps, "root").select("sid", "keep"), "targets", rows=many.count())
        rows = slim.join(small(targets), "sid").filter("nid <> keep.nid")
        same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("th") == F.col("keep.th"))
        rows = materialise(rows.select("doc_id", "th", same.alias("same")).distinct(), "others", rows=slim.count())
        gone = materialise(rows.filter("NOT same").select("doc_id", "th"), "gone", outlives=True, rows=rows.count())
        repeats = rows.filter("same").select("doc_id", "th")
        return gone, None if repeats.isEmpty() else materialise(repeats, "repeats", outlives=True)

    def kept(self) -> DataFrame:
        """The rows of ``docs`` that stay."""
        (th, id_, hash_) = fresh(self.docs, "th", "id", "hash")
        rows = self.docs.withColumn(th, self._key()[1])
        key = lambda t: small(t.select(F.col("doc_id").alias(id_), F.col("th").alias(hash_)))
        same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(hash_))
        stay = rows.join(key(self.gone), same, "left_anti")
        if self.repeats is not None:
            once = stay.join(key(self.repeats), same, "left_semi").dropDuplicates(["doc_id", th])
            stay = stay.join(key(self.repeats), same, "left_anti").unionByName(once)
        return stay.select(*self.docs.columns)


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id. Columns as in ``docs``."""
    return NearCopies(docs, **options).kept()
