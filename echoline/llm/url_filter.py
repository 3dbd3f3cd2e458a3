"""URL filters by a trie over reversed host labels and path segments.

A rule is a host and a path: it fits the host and its subdomains where the url's path
starts with the rule's. Of the rules that fit, the one of the greatest length (host and path)
wins; of equal ones that with the longer host, then block over allow. The trie goes from the
last host label to the first; a host's node holds a trie of path segments, in which the
last segment of a rule is a prefix of the url's. The trie is compiled once and broadcast.
It holds ``max_rules`` rules at most; more rules go through as many tries, one after the other,
with the rows written down between, so that a worker never holds two.

Cases: a null url or one without ``://`` has an empty host and path and gets no rule, but for
rules of an empty host and path; an unruled url gets ``default``; repeated rows are
judged each; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoline.llm.common import fresh, materialise

BLOCK, ALLOW = "block", "allow"

#: Fixed values of the contract: verdict, host, path.
RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


class _Node:
    """A host label: its subdomains, and the trie of its rules' paths."""

    __slots__ = ("below", "paths")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.paths: _Path | None = None


class _Path:
    """A path segment: what follows, and the rules that end in a prefix of the next segment, by its length."""

    __slots__ = ("below", "ends")

    def __init__(self):
        self.below: dict[str, _Path] = {}
        self.ends: dict[int, dict[str, tuple[int, int, int, str]]] = {}


class Trie:
    """The compiled rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Node()
        for verdict, name, start in rules:
            node = self.root
            for label in reversed(name.split(".")) if name else ():
                node = node.below.setdefault(label, _Node())
            node.paths = at = node.paths or _Path()
            *whole, last = start.split("/")
            for segment in whole:
                at = at.below.setdefault(segment, _Path())
            rank = (len(name) + len(start), len(name), int(verdict == BLOCK), name + start)
            ends = at.ends.setdefault(len(last), {})
            ends[last] = max(ends.get(last, rank), rank)

    def find(self, name: str, start: str) -> tuple[int, int, int, str] | None:
        """(length, length of the host, 1 if it blocks, rule) of the winning rule."""
        best, node, segments = None, self.root, start.split("/")
        labels = reversed(name.split(".")) if name else iter(())
        while node is not None:
            at = node.paths
            for segment in segments if at else ():
                for length, ends in at.ends.items():
                    rank = ends.get(segment[:length])
                    if rank and (best is None or rank > best):
                        best = rank
                at = at.below.get(segment)
                if at is None:
                    break
            label = next(labels, None)
            node = node.below.get(label) if label is not None else None
        return best


def judged(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = ALLOW, url: str = "url", max_rules: int = 500_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names are replaced."""
    (best,) = fresh(pages, "best")
    new = {"host", "path", "rule", "verdict"}
    passed = [c for c in pages.columns if c.lower() not in new or c == url]
    h, p = fresh(pages, "url_host", "url_path")
    kind = "struct<length:int,host_length:int,blocks:int,rule:string>"
    out = pages.select(*passed, host(F.col(url)).alias(h), path(F.col(url)).alias(p), F.lit(None).cast(kind).alias(best))
    source, first = iter(rules), True
    while block := list(islice(source, max_rules)):
        out = _against(out if first else materialise(out, "judged"), block, h, p, best)
        first = False
    b = F.col(best)
    verdict = F.when(b.isNull(), F.lit(default)).when(b["blocks"] == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    passed = [c for c in passed if c.lower() not in new]
    return out.select(*passed, F.col(h).alias("host"), F.col(p).alias("path"), b["rule"].alias("rule"), verdict.alias("verdict"))


def _against(pages: DataFrame, block: list[tuple[str, str, str]], h: str, p: str, best: str) -> DataFrame:
    """The better of ``best`` and the winner among a block of rules."""
    shared = pages.sparkSession.sparkContext.broadcast(Trie(block))
    (part,) = fresh(pages, "part")
    i, j = pages.columns.index(h), pages.columns.index(p)
    struct = pa.struct([("length", pa.int32()), ("host_length", pa.int32()), ("blocks", pa.int32()), ("rule", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            found = [trie.find(x, y) for x, y in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True)]
            rows = [f and dict(zip(("length", "host_length", "blocks", "rule"), f, strict=True)) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, struct)], names=[*batch.schema.names, part])

    fields = [*pages.schema.fields, T.StructField(part, pages.schema[best].dataType)]
    return pages.mapInArrow(run, T.StructType(fields)).withColumn(best, F.greatest(best, part)).drop(part)
