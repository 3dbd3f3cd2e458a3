"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased, punctuation becomes white space, and white space one
blank. An item of m characters may differ in k = floor(max_error * m) edits. It is cut
into k + 1 pieces: k edits spoil k of them at most, so one piece is found as it is. An
Aho-Corasick automaton finds the pieces of all items in one pass, and Myers' bit-parallel
distance verifies the text around each hit. Pieces are the leaves of a binary tree in which
n neighbouring pieces may have n - 1 edits: an occurrence within the budget has a leaf all of
whose ancestors keep to theirs, so a hit is verified upwards, short spans first, and nearly
all chance hits end after a few characters.

Items are compiled in blocks of ``block_chars`` characters and broadcast, a block at a time, so that
a worker holds one matcher whatever the number of items; all documents are held against every
block. The hits of blocks are a union of scans; ``decontaminate`` writes down what is left after each.

Cases: null, empty and wordless items match nothing; items that are too short for an
edit must occur as they are, between blanks; null texts have no hits; a null item
id is reported as null; repeated rows are judged each; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoline.llm.common import fresh, materialise, slices

_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def normalise(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()).decode("utf-8", "surrogatepass")


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of about equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def ancestors(cuts: list[tuple[int, str]], size: int) -> list[list[tuple[int, int, int]]]:
    """For each piece its ancestors below the root, nearest first: (offset, end, edits allowed)."""
    paths: list[list[tuple[int, int, int]]] = [[] for _ in cuts]
    edges = [a for a, _ in cuts] + [size]

    def split(low: int, high: int) -> None:
        if high - low > 1:
            middle = (low + high) // 2
            split(low, middle)
            split(middle, high)
            if high - low < len(cuts):
                for i in range(low, high):
                    paths[i].append((edges[low], edges[high], high - low - 1))

    split(0, len(cuts))
    return paths


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of ``text`` that ends somewhere, and the first such end; (k + 1, -1) if over ``k``."""
    top, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score = full, 0, m
    best, at = (m, 0) if m <= k else (k + 1, -1)
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1
        plus = ((down << 1) | (full & ~(d | up))) & full
        minus = up & d & full
        if score < best:
            best, at = score, j + 1
            if not best:
                break
    return best, at


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds the items (id, normalised text, edit budget) in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str, int]]):
        import ahocorasick

        self.items = items
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        self.back: dict[int, dict[str, int]] = {}
        self.paths = []
        places: dict[str, list[tuple[int, int, int]]] = {}
        for i, (_, text, k) in enumerate(items):
            cuts = pieces(text, k)
            self.paths.append(ancestors(cuts, len(text)))
            for leaf, (offset, piece) in enumerate(cuts):
                places.setdefault(piece, []).append((i, leaf, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, start, end) of the best place of every item that is found; of equal ones the first."""
        diagonals: dict[int, set[int]] = {}
        if not self.items:
            return []
        for end, (length, where) in self.automaton.iter(text):
            for i, leaf, offset in where:
                at = end + 1 - length - offset
                if at not in diagonals.get(i, ()) and self._plausible(i, leaf, at, text):
                    diagonals.setdefault(i, set()).add(at)
        out = []
        for i, starts in sorted(diagonals.items()):
            if hit := self._verify(i, sorted(starts), text):
                out.append((self.items[i][0], *hit))
        return out

    def _masks(self, i: int, a: int, b: int) -> dict[str, int]:
        if (i, a, b) not in self.masks:
            self.masks[i, a, b] = masks_of(self.items[i][1][a:b])
        return self.masks[i, a, b]

    def _plausible(self, i: int, leaf: int, at: int, text: str) -> bool:
        """Whether all ancestors of a piece that is found on diagonal ``at`` keep to their edits."""
        for a, b, k in self.paths[i][leaf]:
            if myers(self._masks(i, a, b), b - a, text[max(0, at + a - k) : max(0, at + b + k)], k)[1] < 0:
                return False
        return True

    def _verify(self, i: int, starts: list[int], text: str) -> tuple[int, int, int] | None:
        _, item, k = self.items[i]
        m = len(item)
        if not k:
            return 0, starts[0], starts[0] + m
        exact = text.find(item)
        if exact >= 0:
            return 0, exact, exact + m
        if i not in self.back:
            self.back[i] = masks_of(item[::-1])
        best: tuple[int, int, int] | None = None
        done = 0
        at = 0
        while at < len(starts):
            low, high = max(0, starts[at] - k, done - m - k), starts[at] + m + k
            at += 1
            while at < len(starts) and starts[at] - k <= high:
                high = starts[at] + m + k
                at += 1
            most = k if best is None else best[0] - 1
            distance, end = myers(self._masks(i, 0, m), m, text[low:high], most)
            if end >= 0:
                end += low
                _, back = myers(self.back[i], m, text[max(0, end - m - k) : end][::-1], distance)
                best = (distance, end - back, end)
                if not distance:
                    break
            done = high
        return best


def budgeted(item_id: int | None, text: str | None, max_error: float) -> tuple[int | None, str, int] | None:
    """id, text to look for and edits allowed; None for an item without a word."""
    plain = normalise(text)
    if not plain:
        return None
    k = int(max_error * len(plain))
    return (item_id, plain, k) if k else (item_id, f" {plain} ", 0)


def _blocks(benchmark: DataFrame, max_error: float, block_chars: int) -> Iterator[Broadcast]:
    """Matchers of ``block_chars`` characters of items each, broadcast as they are wanted; the driver holds one block of items."""
    context, block, size = benchmark.sparkSession.sparkContext, [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if (item := budgeted(row[0], row[1], max_error)) is None:
            continue
        block.append(item)
        size += len(item[1])
        if size >= block_chars:
            yield context.broadcast(Matcher(block))
            block, size = [], 0
    if block:
        yield context.broadcast(Matcher(block))


def _with_hits(docs: DataFrame, matcher: Broadcast, column: str) -> DataFrame:
    """``docs`` with an array of the items of one block that each text holds."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    where = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column(where).to_pylist():
                #: Blanks at both ends, so that short items are found there too; offsets are less by one.
                hits = matcher.value.find(f" {normalise(text)} ")
                found.append([{"item_id": i, "distance": d, "start": max(0, s - 1), "end": e - 1} for i, d, s, e in hits])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, HITS)]))


def leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, distance, start, end (in the normalised text): a row for each item that a row of ``docs`` holds."""
    slim = docs.select("doc_id", "text")
    parts = [_with_hits(slim, m, "hits").select("doc_id", F.explode("hits").alias("h")) for m in _blocks(benchmark, max_error, block_chars)]
    none = slim.select("doc_id", F.explode(F.lit(None).cast(HITS)).alias("h")).limit(0)
    return reduce(DataFrame.unionByName, parts or [none]).select("doc_id", "h.item_id", "h.distance", "h.start", "h.end")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item; columns as in ``docs``."""
    (hits,) = fresh(docs, "hits")
    out = docs
    for i, matcher in enumerate(_blocks(benchmark, max_error, block_chars)):
        out = _with_hits(materialise(out, "left") if i else out, matcher, hits).filter(F.size(hits) == 0).drop(hits)
    return out
