"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of
the text's word shingles. Equal fingerprints meet in a grouped aggregate. Distinct ones
that differ in ``radius`` bits or fewer agree in some of the blocks into which the 64
bits are cut (pigeonhole), so they share a bucket; the number of blocks follows the
number of fingerprints, so that buckets stay short. Buckets are sorted, packed into
batches and compared bit-sliced: the batch's bit planes lie vertically, 64 fingerprints
to a word; each plane's differences go through carry-save counters that hold the
distances of all lanes at once, and a query row is abandoned once all its lanes exceed
the radius. Long buckets are cut into tiles of bounded size, every pair of tiles once,
so no group meets in one task. A batch gives a spanning forest, never all pairs; the
forests' components come from star steps in Spark.

``judged`` links fingerprints alone; ``near_copies`` uses wider ones to find candidates and
verifies their similarity on the whole texts.

Cases: a null or wordless text has fingerprint zero, which links like any other; fewer
words than a shingle: the whole sequence is the only shingle; repeated rows share a
fingerprint; a null id counts last in the choice of a group's id; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import fresh, materialise, release, slices, temporary
from echoline.llm.components import connected_components

#: All lanes of a word.
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a UTF-8 text, repeats included; of the whole sequence if it has fewer words."""
    import xxhash

    tokens = (text or b"").lower().split()
    n = max(1, len(tokens) - words + 1)
    parts = [b" ".join(tokens)] if n == 1 else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in parts), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text; zero without words."""
    if not (text or b"").split(None, 1):
        return 0
    return majority(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, words: int = 4, column: str = "fp", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=[*batch.schema.names[:-1], column])

    kept = docs.columns if keep is None else keep
    (body,) = fresh(docs, "body")
    source = docs.select(*kept, F.col(text_col).cast("binary").alias(body))
    return source.mapInArrow(run, docs.select(*kept).schema.add(column, "long"))


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three bits in every lane: sum and carry."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


class Planes:
    """Bit planes of a block of fingerprints: plane b holds bit b of all of them, 64 lanes to a word.

    ``prints``: 64 bits each, or rows of as many words as a fingerprint has.
    """

    def __init__(self, prints: np.ndarray):
        self.n = len(prints)
        self.words = -(-self.n // 64)
        rows = np.ascontiguousarray(prints, np.uint64).reshape(self.n, -1)
        self.bits = 64 * rows.shape[1]
        bits = np.unpackbits(rows.view(np.uint8).reshape(self.n, -1), axis=1, bitorder="little")
        padded = np.zeros((self.bits, self.words * 64), np.uint8)
        padded[:, : self.n] = bits.T
        self.planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        lanes = np.zeros(self.words * 64, np.uint8)
        lanes[: self.n] = 1
        self.lanes = np.packbits(lanes, bitorder="little").view(np.uint64)

    def _from(self, first: np.ndarray) -> np.ndarray:
        """For each query the lanes from index ``first`` on."""
        shift = first[:, None] - 64 * np.arange(self.words)[None, :]
        part = np.left_shift(_ALL, np.clip(shift, 0, 63).astype(np.uint64))
        return np.where(shift >= 64, np.uint64(0), np.where(shift <= 0, _ALL, part)) & self.lanes

    def near(self, queries: np.ndarray, radius: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``queries`` that have lanes within ``radius``, and those lanes as bit masks.

        ``first``: for each query the lane from which on it is compared.
        """
        rows = np.arange(len(queries))
        bits = np.unpackbits(np.ascontiguousarray(queries, np.uint64).reshape(len(rows), -1).view(np.uint8), axis=1, bitorder="little")
        flips = bits.T.astype(np.uint64) * _ALL
        lanes = np.broadcast_to(self.lanes, (len(rows), self.words)) if first is None else self._from(first)
        over = ~lanes
        #: Carry-save counters: digit k of all lanes' distances. What leaves the last one saturates.
        width = max(3, int(radius + 1).bit_length())
        digits = [np.zeros((len(rows), self.words), np.uint64) for _ in range(width)]
        for b in range(0, self.bits, 8):
            d = self.planes[b : b + 8, None, :] ^ flips[b : b + 8, :, None]
            fours = []
            for i in (0, 4):
                digits[0], low = _add(digits[0], d[i], d[i + 1])
                digits[0], high = _add(digits[0], d[i + 2], d[i + 3])
                digits[1], four = _add(digits[1], low, high)
                fours.append(four)
            digits[2], carry = _add(digits[2], *fours)
            for k in range(3, width):
                digits[k], carry = digits[k] ^ carry, digits[k] & carry
            over |= carry
            if b + 8 > radius:
                alive = (~(over | self._exceeds(digits, radius))).any(axis=1)
                left = np.count_nonzero(alive)
                if 2 * left <= len(rows):
                    rows, over, flips = rows[alive], over[alive], flips[:, alive]
                    digits = [x[alive] for x in digits]
                    if not left:
                        break
        near = ~(over | self._exceeds(digits, radius))
        some = near.any(axis=1)
        return rows[some], near[some]

    @staticmethod
    def _exceeds(digits: list[np.ndarray], radius: int) -> np.ndarray:
        """Lanes whose counter is over ``radius``: compared digit by digit from the highest."""
        greater = np.zeros_like(digits[0])
        equal = np.full_like(digits[0], _ALL)
        for k in range(len(digits) - 1, -1, -1):
            if radius >> k & 1:
                equal &= digits[k]
            else:
                greater |= equal & digits[k]
                equal &= ~digits[k]
        return greater


def near_pairs(prints: np.ndarray, radius: int, split: int | None = None, chunk: int = 256) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """All pairs i < j within ``radius``, as (indices i, first index j, matrix of truth values).

    ``split``: only pairs with one side before and one from that index are compared.
    """
    end, begin = (len(prints), 0) if split is None else (split, split)
    block = Planes(prints[begin:])
    for i in range(0, end, chunk):
        at = np.arange(i, min(i + chunk, end))
        rows, masks = block.near(prints[at], radius, at + 1 if split is None else None)
        if len(rows):
            yield at[rows], begin, np.unpackbits(masks.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")[:, : len(prints) - begin].astype(bool)


def forest(prints: np.ndarray, radius: int, split: int | None = None, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ends of a star forest that joins what is within ``radius`` (and of unlike ``roots``, if they are given)."""
    label = np.arange(len(prints))
    for at, begin, near in near_pairs(prints, radius, split):
        if roots is not None:
            near &= roots[at][:, None] != roots[begin:][None, :]
        for i, lanes in zip(at.tolist(), near, strict=True):
            if lanes.any():
                joined = np.unique(np.append(label[np.flatnonzero(lanes) + begin], label[i]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return moved, label[moved]


def least_near(prints: np.ndarray, nid: np.ndarray, radius: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row that has others within ``radius``: its number and the least of theirs."""
    none = np.iinfo(np.int64).max
    best = np.full(len(prints), none)
    for at, begin, near in near_pairs(prints, radius, split):
        best[at] = np.minimum(best[at], np.where(near, nid[begin:][None, :], none).min(axis=1))
        best[begin:] = np.minimum(best[begin:], np.where(near, nid[at][:, None], none).min(axis=0))
    found = best < none
    return nid[found], best[found]


def _layout(n: int, radius: int, per_bucket: int) -> tuple[list[int], int]:
    """Widths of the blocks, and how many must agree, for short buckets among ``n`` fingerprints."""
    for agree in range(1, 5):
        blocks = radius + agree
        widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
        if n / 2.0 ** sum(sorted(widths)[:agree]) <= per_bucket:
            break
    return widths, agree


def links(nodes: DataFrame, radius: int = 4, per_bucket: int = 64, tile: int = 4096, batch: int = 2048) -> DataFrame:
    """``nodes``: fp long, distinct. Edges a, b that connect exactly what links of ``radius`` bits or fewer connect."""
    from itertools import combinations

    n = nodes.count()
    widths, agree = _layout(n, radius, per_bucket)
    starts = np.cumsum([0, *widths]).tolist()
    masks = [sum(((1 << widths[i]) - 1) << starts[i] for i in chosen) for chosen in combinations(range(len(widths)), agree)]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    rows = in_tiles(materialise(keyed, "buckets"), ["t", "key"], ["fp"], tile)

    def edges(prints: np.ndarray, rows: np.ndarray, split: int | None) -> tuple[np.ndarray, np.ndarray]:
        if split is None:
            prints = np.unique(prints)
        a, b = forest(prints, radius, split)
        return prints[a].view(np.int64), prints[b].view(np.int64)

    return rows.mapInArrow(by_bucket(["t", "key"], ["fp"], [], edges, batch), "a long, b long").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def in_tiles(keyed: DataFrame, by: list[str], columns: list[str], tile: int) -> DataFrame:
    """Buckets sorted within partitions; those of more than ``tile`` rows in pairs of tiles lo, hi, whose rows carry their side."""
    long_ = keyed.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    #: A bucket a row; buckets of so many rows are few.
    long_ = materialise(long_.withColumn("tiles", F.ceil(F.col("n") / (tile // 2)).cast("int")).drop("n").coalesce(1), "long")
    own = F.pmod(F.xxhash64(*columns), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    #: A row of tile i goes to every pair of tiles (i, j).
    cut = (
        keyed.join(long_, by).select(*by, *columns, own.alias("i"), other.alias("j"))
        .select(*by, *columns, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).cast("int").alias("side"))
    )
    short = keyed.join(long_, by, "left_anti").select(*by, *columns, F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(0).alias("side"))
    return short.unionByName(cut).repartition(*by, "lo", "hi").sortWithinPartitions(*by, "lo", "hi", "side", columns[0])


def by_bucket(by: list[str], prints: list[str], others: list[str], compare, batch: int):
    """Runs ``compare(prints, rows, split)`` on tiles and on batches of short buckets; what it returns are the columns a and b."""
    dtype = [*((c, "i4" if c == "t" else "i8") for c in by), *((c, "i8") for c in (*prints, *others)), ("lo", "i4"), ("hi", "i4"), ("side", "i4")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(table: np.ndarray) -> pa.RecordBatch | None:
            if len(table) < 2:
                return None
            sides = np.flatnonzero(table["side"])
            cross = table["lo"][0] != table["hi"][0]
            if cross and (not len(sides) or sides[0] == 0):
                return None
            words = [table[c].astype(np.int64).view(np.uint64) for c in prints]
            a, b = compare(words[0] if len(words) == 1 else np.stack(words, axis=1), table, int(sides[0]) if cross else None)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held = np.empty(0, dtype)
        for part in batches:
            new = np.empty(part.num_rows, held.dtype)
            for name in held.dtype.names:
                new[name] = part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            held = np.concatenate([held, new])
            held, whole = _cut(held, [*by, "lo", "hi"], batch, False)
            yield from filter(None, map(edges, whole))
        _, whole = _cut(held, [*by, "lo", "hi"], batch, True)
        yield from filter(None, map(edges, whole))
        del held, whole
        release()

    return run


def _cut(held: np.ndarray, by: list[str], batch: int, last: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whole buckets of sorted rows: short ones packed to about ``batch`` rows, tiles each alone; and what waits for more rows."""
    if not len(held):
        return held, []
    new = np.zeros(len(held) - 1, bool)
    for c in by:
        new |= held[c][1:] != held[c][:-1]
    edge = np.flatnonzero(np.concatenate([[True], new]))
    ends = np.append(edge[1:], len(held))
    if not last:
        edge, ends = edge[:-1], ends[:-1]
    out, begun = [], None
    for s, e in zip(edge.tolist(), ends.tolist(), strict=True):
        if held["lo"][s] >= 0:
            if begun is not None:
                out.append(held[begun:s])
                begun = None
            out.append(held[s:e])
            continue
        begun = s if begun is None else begun
        if e - begun >= batch:
            out.append(held[begun:e])
            begun = None
    done = int(ends[-1]) if len(ends) else 0
    if begun is not None:
        out.append(held[begun:done])
    return held[done:].copy(), out


def components(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``prints``: doc_id, fp (a materialised table). A row for each fp: component_id, the smallest id reachable."""
    with temporary(prints.sparkSession):
        n = prints.count()
        nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints", rows=n)
        roots = connected_components(links(nodes.select("fp"), radius))
        rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        rooted = materialise(rooted, "rooted", rows=n)
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        return materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "classes", outlives=True, rows=n)


def judged(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = materialise(with_fingerprints(docs, words, keep=["doc_id"]), "fingerprints")
    out = prints.join(components(prints, radius).drop("root"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
