"""Line dedup by the number of distinct sites that a line is on.

Every line hash gets a HyperLogLog sketch of its sites. A register is kept as the set of
ranks seen, one bit each, four registers to a long, so that sketches merge with
``bit_or``: a hash aggregate with map-side combine, in which a line that is everywhere costs
a row a task. The register's value is its highest bit. Lines whose estimate is far below
the threshold stay, those far above go, and those between get an exact distinct count.
Lines with fewer occurrences than the threshold need no sketch's word: they stay.

Lines are compared trimmed, with white space as one blank, by MD5; blank lines always stay. Texts are split
twice: once for a slim table of digests and sites, from which sketches and exact counts are made, and
once to take lines out, where the digests of boilerplate are broadcast in blocks of ``max_lines``; no
text is shuffled. More blocks than one are gone through one after the other, with the
rows written down between.

Cases: a null text has no lines and stays null; a null site counts as one site; rows that
repeat id and text lose the same lines; an empty table gives an empty result; extra
columns pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import SPACE, materialise, slices, small, temporary

#: Registers, registers to a long, bits of a register. Standard error 1.04 / sqrt(32).
_M, _PER, _BITS = 32, 4, 16


def line_key(line: Column) -> Column:
    """The MD5 digest of the normalised line; null for a blank one."""
    #: Few lines need the pattern; looking for what it would change is much cheaper.
    odd = F.lit(False)
    for blank in ("  ", "\t", "\r", "\v", "\f"):
        odd = odd | F.contains(line, F.lit(blank))
    plain = F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))
    return F.when(plain != "", F.unhex(F.md5(plain)))


def _sketch(site: Column) -> list[Column]:
    """The longs of a one-site sketch, each 0 but for one bit in one of them."""
    h = F.xxhash64(F.coalesce(site.cast("string"), F.lit("\x00")))
    register = h.bitwiseAND(F.lit(_M - 1)).cast("int")
    rest = F.call_function("shiftrightunsigned", h, F.lit(5))
    low = rest.bitwiseAND(-rest)
    rank = F.least(F.when(low > 0, F.log2(low.cast("double"))).otherwise(F.lit(_BITS - 1.0)), F.lit(_BITS - 1.0)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), register % _PER * _BITS + rank)
    return [F.when(F.floor(register / _PER) == i, bit).otherwise(F.lit(0).cast("long")) for i in range(_M // _PER)]


def estimate(longs: list[str]) -> Column:
    """HyperLogLog's estimate, with linear counting for small ones."""
    field = lambda x, r: F.call_function("shiftrightunsigned", x, (r * _BITS).cast("int")).bitwiseAND(F.lit((1 << _BITS) - 1))
    ranks = F.flatten(F.transform(F.array(*longs), lambda x: F.transform(F.sequence(F.lit(0), F.lit(_PER - 1)), lambda r: F.length(F.bin(field(x, r))))))
    #: ``bin(0)`` has one digit, as ``bin(1)`` has: an empty register is told by its field.
    filled = F.size(F.filter(F.flatten(F.transform(F.array(*longs), lambda x: F.transform(F.sequence(F.lit(0), F.lit(_PER - 1)), lambda r: field(x, r)))), lambda v: v > 0))
    sums = F.struct(F.aggregate(ranks, F.lit(0.0), lambda t, k: t + F.pow(F.lit(2.0), -k)).alias("all"), (_M - filled).alias("empty"))

    def judged(z: Column) -> Column:
        #: An empty register counts 2^0, not the 2^-1 of one digit.
        raw = F.lit(0.697 * _M * _M) / (z["all"] + 0.5 * z["empty"])
        return F.when((raw <= 2.5 * _M) & (z["empty"] > 0), _M * F.log(F.lit(float(_M)) / z["empty"])).otherwise(raw)

    return F.transform(F.array(sums), judged)[0]


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("site"), F.explode(F.split("text", "\n")).alias("line")).select("site", line_key(F.col("line")).alias("line")).filter("line IS NOT NULL")


def boilerplate(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """line (digest), sites of all lines on ``min_sites`` sites or more; ``sites`` is null where the sketch alone decided."""
    names = [f"h{i}" for i in range(_M // _PER)]
    with temporary(docs.sparkSession):
        lines = materialise(_lines(docs), "lines")
        sketched = lines.select("line", *[c.alias(n) for n, c in zip(names, _sketch(F.col("site")), strict=True)])
        sketched = sketched.groupBy("line").agg(F.count("*").alias("n"), *[F.bit_or(n).alias(n) for n in names]).filter(F.col("n") >= min_sites)
        spread = materialise(sketched.select("line", estimate(names).alias("spread")).filter(F.col("spread") >= min_sites / 3), "spread")
        near = materialise(spread.filter(F.col("spread") <= 3 * min_sites).select("line"), "near")
        exact = lines.join(small(near), "line", "left_semi").select("line", F.coalesce(F.col("site").cast("string"), F.lit("\x00")).alias("site")).distinct()
        exact = exact.groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
        far = spread.filter(F.col("spread") > 3 * min_sites).select("line", F.lit(None).cast("long").alias("sites"))
        return materialise(exact.unionByName(far), "boilerplate", outlives=True)


def cleaned(docs: DataFrame, min_sites: int = 10, max_lines: int = 500_000) -> DataFrame:
    """Every row of ``docs`` with its text less boilerplate lines, and n_lines and n_removed, which replace columns of those names."""
    dropped = boilerplate(docs.select("source", "text"), min_sites).select("line")
    blocks = max(1, -(-dropped.count() // max_lines))
    passed = [c for c in docs.columns if c.lower() not in {"n_lines", "n_removed"}]
    out = docs.select(*passed, F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    for i in range(blocks):
        block = dropped.filter(F.pmod(F.xxhash64("line"), F.lit(blocks)) == i)
        digests = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in block.collect()))
        out = _without(materialise(out, "left") if i else out, digests)
    return out


def _without(docs: DataFrame, digests: Broadcast) -> DataFrame:
    """``docs`` without the lines of these digests; n_removed goes up by their number."""
    where, last = [c.lower() for c in docs.columns].index("text"), len(docs.columns) - 1

    def key(line: str) -> bytes:
        return md5(b" ".join(line.encode().split())).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = digests.value
        for batch in slices(batches):
            texts, removed = [], batch.column(last).to_pylist()
            for i, text in enumerate(batch.column(where).to_pylist()):
                lines = [] if text is None else text.split("\n")
                kept = [x for x in lines if key(x) not in gone]
                texts.append(text if len(kept) == len(lines) else "\n".join(kept))
                removed[i] += len(lines) - len(kept)
            columns = [*batch.columns[:last], pa.array(removed, pa.int64())]
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema) if digests.value else docs


def judged(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_sha256 (null text: empty) of every row."""
    out = cleaned(docs.select("doc_id", "source", "text"), min_sites)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))
