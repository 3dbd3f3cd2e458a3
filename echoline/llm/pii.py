"""Personal data: base rules as seeds, and bootstrapped contextual extraction.

The base rules find emails, IP addresses, cards and phones. Their matches are seeds, and so are
tokens that look like secrets (``is_secret``). The words around a seed induce lexical patterns:
the word before with the marks between it and the value, such as ``token = "``; the two words
before; the word before with the word after. Candidates are tokens with a digit or an @ that no
base match touches; neighbouring groups of digits are one candidate. Patterns and the values
that they enclose form a graph, which Spark scores in rounds. A pattern's confidence for a
kind is the share of its distinct values that are believed to be of it. A pattern with
``min_confidence`` over ``min_support`` values is accepted, and all its values are believed from then
on, which may lift other patterns. What is believed only grows, so the rounds end at a
fixed point. Accepted patterns mark the candidates that they enclose; each gets the kind of
its most confident pattern, of equal ones the kind that is listed first.

A pass over the texts leaves a slim table; the graph is grouped and joined by Spark, with
distinct values first and partial sums, so frequent contexts cost a row a task. Values and
patterns are told apart by 64 bits.

Cases: a null text is empty; offsets are code points, ends exclusive; repeated rows are
judged each; repeated values count once in the graph; an empty table gives an empty
result; a value at a text's edge has the patterns for which there are words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import materialise, slices, small, temporary

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Equal to the plain rules; possessive repeats and the look-behind keep long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SECRET = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
_SPACED = re.compile(r"[^\x20\x09-\x0D]+")
#: What a group of digits may hold beside them, and how the next group begins.
_GROUP = frozenset("0123456789().-/")
_EDGE = ".,:;!?\"'()[]{}<>|*#$%&=~`"
_STOP = " \t\n\v\f\r\"'<>()[]{}=,;|"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match at each @: the run before it belongs to it, whatever comes after."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, end)):
            end = done = m.end()
            yield start, end
        at = text.find("@", end)


def _part(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _MARK.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(map(_part, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def is_secret(value: str) -> bool:
    """A token of 20 characters and more that mixes letters and digits as keys and digests do."""
    if not _SECRET.fullmatch(value):
        return False
    n, digits = len(value), sum(c.isdigit() for c in value)
    return digits >= 3 and digits < n and -sum(k / n * log2(k / n) for k in Counter(value).values()) >= 3.0


class Words:
    """The words of a text with their places: tokens between blanks, lower-cased, without marks at their edges."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = []
        self.ends: list[int] = []
        for m in _SPACED.finditer(text):
            a, b = m.start(), m.end()
            token = m[0]
            a += len(token) - len(token.lstrip(_EDGE))
            b -= len(token) - len(token.rstrip(_EDGE))
            if a < b:
                self.starts.append(a)
                self.ends.append(b)

    def before(self, at: int) -> tuple[str, int, str]:
        """The last word that begins before ``at``, where it ends, and the word before that; empty if there is none."""
        i = bisect_right(self.starts, at - 1) - 1
        if i < 0:
            return "", 0, ""
        start, end = self.starts[i], min(self.ends[i], at)
        #: A word that runs up to the value, as in key="value", counts without the marks between.
        while end > start and self.text[end - 1] in _EDGE:
            end -= 1
        return self.text[start:end].lower(), end, self.text[self.starts[i - 1] : self.ends[i - 1]].lower() if i else ""

    def after(self, at: int) -> str:
        """The first word that ends after ``at``, from there on."""
        i = bisect_right(self.ends, at)
        if i == len(self.starts):
            return ""
        start = max(self.starts[i], at)
        while start < self.ends[i] and self.text[start] in _EDGE:
            start += 1
        return self.text[start : self.ends[i]].lower()


def contexts(words: Words, start: int, end: int) -> list[str]:
    """The lexical patterns around a span."""
    last, at, second = words.before(start)
    following = words.after(end)
    out = []
    if last:
        out.append(f"D\x1f{last}\x1f{' '.join((words.text[at:start] + chr(1)).split())[:-1]}")
        if second:
            out.append(f"L\x1f{second}\x1f{last}")
        if following:
            out.append(f"B\x1f{last}\x1f{following}")
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or an @ that touch no span, without marks at their edges; groups of digits one blank apart are one."""
    out, done, i = [], 0, 0
    merged = sorted((s, e) for s, _, e in spans)
    for m in _MARK.finditer(text):
        at = m.start()
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] not in _STOP:
            start -= 1
        end = at + 1
        while end < len(text) and text[end] not in _STOP:
            end += 1
        if _GROUP.issuperset(text[start:end]):
            while end + 1 < len(text) and text[end] == " " and (text[end + 1].isdecimal() or text[end + 1] == "("):
                more = end + 1
                while more < len(text) and text[more] in _GROUP:
                    more += 1
                if more < len(text) and text[more] not in _STOP:
                    break
                end = more
        done = end
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while i < len(merged) and merged[i][1] <= start:
            i += 1
        if end > start and not (i < len(merged) and merged[i][0] < end):
            out.append((start, end))
    return out


def _scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, base spans, and the occurrences of values in patterns; kind -1 for candidates that are no seeds."""
    import xxhash

    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("based", pa.bool_()), ("value", pa.int64()), ("pattern", pa.int64())])
    at = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def key(text: str) -> int:
        x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 11)
        return x - (1 << 64) if x >> 63 else x

    def occurrences(text: str, spans: list[tuple[int, int, int]]) -> Iterator[dict]:
        if not spans and _MARK.search(text) is None:
            return
        words = Words(text)
        seen = [(s, e, k, True) for s, k, e in spans]
        seen += [(s, e, KINDS.index("secret") if is_secret(text[s:e]) else -1, False) for s, e in candidates(text, spans)]
        for s, e, k, based in seen:
            value = key(text[s:e].lower())
            for p in contexts(words, s, e):
                yield {"start": s, "end": e, "kind": k, "based": based, "value": value, "pattern": key(p)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, found = [], []
            for text in batch.column(2).to_pylist():
                spans = base_spans(text or "")
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                found.append(list(occurrences(text or "", spans)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(base, at), pa.array(found, pa.list_(item))], names=["row", "doc_id", "base", "found"])

    schema = "row long, doc_id long, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,kind:int,based:boolean,value:long,pattern:long>>"
    return docs.select(F.monotonically_increasing_id(), F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def accepted_patterns(occurrences: DataFrame, min_confidence: float = 0.85, min_support: int = 5) -> DataFrame:
    """``occurrences``: pattern, value, kind (-1: no seed). Returns pattern, kind, confidence of the accepted patterns."""
    with temporary(occurrences.sparkSession):
        #: A value that is a seed anywhere is of its kind; of several the first as listed.
        seeds = materialise(occurrences.filter("kind >= 0").groupBy("value").agg(F.min("kind").alias("kind")), "seeds")
        pairs = materialise(occurrences.select("pattern", "value").distinct(), "pairs")
        size = pairs.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)
        links = materialise(pairs.join(size, "pattern"), "links")
        believed, accepted, before = seeds, None, None
        while True:
            scored = links.join(believed, "value").groupBy("pattern", "kind").agg((F.count("*") / F.first("n")).alias("confidence"))
            accepted = materialise(scored.filter(F.col("confidence") >= min_confidence), "patterns")
            learnt = links.join(small(accepted), "pattern").select("value", "kind").distinct()
            believed = materialise(learnt.unionByName(seeds).distinct(), "believed")
            now = believed.count()
            if now == before:
                break
            before = now
        return materialise(accepted, "accepted", outlives=True)


def _joined(spans: Column, names: tuple[str, ...] = KINDS) -> Column:
    known = F.array(*map(F.lit, names))
    one = lambda x: F.concat_ws(":", F.element_at(known, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs``: doc_id, base spans, and those that patterns add, as arrays of (start, kind, end)."""
    scanned = materialise(_scan(docs), "scan")
    seen = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    accepted = accepted_patterns(seen.select("pattern", "value", "kind"), **options)
    new = (
        seen.filter("NOT based").select("row", "start", "end", "pattern").join(small(accepted), "pattern")
        .groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
        .groupBy("row").agg(F.collect_list(F.struct("start", (-F.col("best.k")).alias("kind"), "end")).alias("new"))
    )
    out = scanned.select("row", "doc_id", "base").join(materialise(new, "new"), "row", "left")
    return out.select("doc_id", "base", F.coalesce("new", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("new"))


def judged(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_found (those that patterns add) of every row."""
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return find(docs, **options).select(
        "doc_id", *[count(i).alias(f"n_{name}") for i, name in enumerate(BASE)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "new")).alias("spans"), F.size("new").cast("long").alias("n_found"),
    )
