"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Rows are digested (SHA-256 of the text with white space normalised). Rows go to memtables
of about ``memtable`` rows by hash of the id; each aggregates its digests and flushes them as a run
of Parquet files that are sorted by digest and carry min/max statistics and Parquet's Bloom
filters. Compaction merges ``fan_in`` runs at a time into one of the next level, until one run is
left. Every merge looks up the bitmap filters of its runs, a row of the filter table for each
32,768 bits: entries that no sibling can have pass unmerged, the others merge, keeping the
smallest id. Filters and entries meet by a join on the filter's bucket, at any size.

Groups of two and more then get byte verification: the least and the greatest normalised
text of a digest must be the same bytes. Both reduce on the map side, so a group
that holds a third of all rows is a row per task after the first step. Only rows of groups are
looked at again: they are found by id and a hash of the text. Digests that fail (a
collision) are grouped by their whole texts instead.

Cases: a null text equals the empty text; a null id is greater than any other and
a group of null ids keeps a null id; of rows that repeat both id and text exactly
one is kept; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.llm.common import SPACE, fresh, materialise, scratch, small, temporary

#: Bits in one row of Spark's bitmap functions.
_BITMAP_BITS = 32768


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _digest(sha: Column, n_bytes: int) -> Column:
    return F.substring(F.unhex(sha), 1, n_bytes)


def _merged(entries: DataFrame, *keys: str) -> DataFrame:
    """One entry for each digest: the first row of the smallest id, and the number of rows."""
    by_id = F.struct(F.col("first.none"), F.col("first.doc_id"), F.col("first.nid"))
    return entries.groupBy(*keys, "digest").agg(F.min(by_id).alias("first"), F.sum("n").alias("n"))


def _holds(bit: Column) -> Callable[[Column], Column]:
    """Whether the filter of another run has this bit."""

    def has(f: Column) -> Column:
        byte = F.conv(F.hex(F.substring(f["bitmap"], F.floor(bit / 8).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("int")
        return (f["run"] != F.col("run")) & (byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0)

    return has


class LsmIndex:
    """Levels of sorted runs of ``(run, digest, first, n)``; ``first``: the first row of the smallest id, as (none, doc_id, nid)."""

    def __init__(self, memtable: int = 100_000, fan_in: int = 4):
        self.memtable, self.fan_in = memtable, fan_in
        self.levels: list[DataFrame] = []
        self.runs = 0

    def _write(self, entries: DataFrame) -> DataFrame:
        """A level: its runs, sorted by digest, in Parquet files with Bloom filters."""
        path = scratch(entries.sparkSession, "runs")
        sorted_ = entries.repartitionByRange("run", "digest").sortWithinPartitions("run", "digest")
        sorted_.write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        self.levels.append(entries.sparkSession.read.schema(entries.schema).parquet(path))
        return self.levels[-1]

    def flush(self, rows: DataFrame) -> "LsmIndex":
        """Memtables to the runs of the first level. ``rows``: digest, doc_id, nid."""
        self.runs = max(1, -(-rows.count() // self.memtable))
        run = F.pmod(F.xxhash64("doc_id"), F.lit(self.runs)).cast("int")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nid")
        self._write(_merged(rows.select(run.alias("run"), "digest", first.alias("first"), F.lit(1).cast("long").alias("n")), "run"))
        return self

    @staticmethod
    def _filters(entries: DataFrame, place: Column) -> DataFrame:
        """A row for each bucket of a merge with the bitmap of every run that has an entry there."""
        return (
            entries.select("to", "run", F.floor(place / _BITMAP_BITS).alias("bucket"), (place % _BITMAP_BITS).alias("bit"))
            .groupBy("to", "run", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
            .groupBy("to", "bucket").agg(F.collect_list(F.struct("run", "bitmap")).alias("filters"))
        )

    def compact(self) -> DataFrame:
        """Merges level by level; the entries of the last run."""
        while self.runs > 1:
            level = self.levels[-1].withColumn("to", F.floor(F.col("run") / self.fan_in).cast("int"))
            merges = -(-self.runs // self.fan_in)
            #: About eight bits for each entry of a merge.
            bits = max(_BITMAP_BITS, 1 << (8 * max(1, level.count() // merges) - 1).bit_length())
            place = F.pmod(F.xxhash64("digest"), F.lit(bits))
            bit = place % _BITMAP_BITS

            probed = level.withColumn("bucket", F.floor(place / _BITMAP_BITS)).join(self._filters(level, place), ["to", "bucket"])
            probed = materialise(probed.select("to", "digest", "first", "n", F.exists("filters", _holds(bit)).alias("hit")), "probed")
            alone = probed.filter("NOT hit").select("to", "digest", "first", "n")
            self._write(_merged(probed.filter("hit"), "to").unionByName(alone).withColumnRenamed("to", "run"))
            self.runs = merges
        return self.levels[-1].select("digest", "first", "n")


class ExactDedup:
    """Judges the rows of ``docs``; see the module for the method and the cases.

    ``digest_bytes`` is for tests, which shorten digests to make collisions.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtable: int = 100_000, fan_in: int = 4):
        self.docs, self.id_col, self.text_col, self.digest_bytes = docs, id_col, text_col, digest_bytes
        slim = docs.select(
            F.monotonically_increasing_id().alias("nid"), F.col(id_col).alias("doc_id"), self._hash().alias("th"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")
        )
        self.slim = materialise(slim, "digests")
        with temporary(docs.sparkSession):
            #: The groups of two and more rows, and the rows in them that have not been verified otherwise.
            rows = self.slim.select("nid", "doc_id", "th", _digest(F.col("text_sha256"), digest_bytes).alias("digest"))
            index = LsmIndex(memtable, fan_in).flush(rows.select("digest", "doc_id", "nid")).compact()
            self.n_rows = self.slim.count()
            groups = materialise(index.filter("n > 1"), "groups", rows=self.n_rows)
            self.members = self._verified(rows, groups)

    def _hash(self) -> Column:
        return F.xxhash64(F.col(self.text_col))

    def _texts(self, members: DataFrame) -> DataFrame:
        """nid, digest, body: the normalised texts of rows (nid, doc_id, th, digest); rows that repeat id and text have one each."""
        th, one, two = fresh(self.docs, "th", "member_id", "member_th")
        slim = members.select("nid", "digest", F.col("doc_id").alias(one), F.col("th").alias(two))
        rows = self.docs.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text"), self._hash().alias(th))
        return rows.join(small(slim), F.col("id").eqNullSafe(F.col(one)) & (F.col(th) == F.col(two))).select("nid", "digest", normalised(F.col("text")).alias("body"))

    def _verified(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """nid, doc_id, th, first (of the group) and n for the rows of groups whose texts are the same bytes."""
        members = materialise(rows.join(small(groups), "digest"), "members", outlives=True, rows=self.n_rows)
        #: One row for each id and text is enough to read a text by.
        keys = members.groupBy("digest", "doc_id", "th").agg(F.min("nid").alias("nid"))
        keys = materialise(keys, "keys", rows=self.n_rows)
        failed = self._texts(keys).groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b").select("digest")
        failed = materialise(failed, "collisions")
        if failed.isEmpty():
            return members
        #: Rows of one id and one hash of the text are taken apart by their bodies only here.
        again = self._texts(keys.join(failed, "digest", "left_semi")).select("nid", "digest", F.sha2("body", 512).alias("sha"), "body").distinct()
        bad = members.join(failed, "digest", "left_semi").drop("first", "n")
        by_key = keys.select("digest", "doc_id", "th", F.col("nid").alias("key"))
        same = F.col("m.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("m.th") == F.col("k.th")) & (F.col("m.digest") == F.col("k.digest"))
        bad = bad.alias("m").join(by_key.alias("k"), same).select("m.*", "key")
        bad = materialise(bad.join(again.select(F.col("nid").alias("key"), "sha", "body"), "key"), "by_text")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nid"))
        whole = bad.groupBy("digest", "sha", "body").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
        mended = bad.join(whole, ["digest", "sha", "body"]).select(*members.columns)
        return materialise(members.join(failed, "digest", "left_anti").unionByName(mended), "verified", outlives=True)

    def judged(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of every row, without another pass over texts."""
        out = self.slim.join(self.members.select("nid", "first", "n"), "nid", "left")
        alone = F.col("n").isNull()
        return out.select(
            "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("nid") == F.col("first.nid"))).alias("kept"), "text_sha256",
        )

    def _matched(self, members: DataFrame, how: str, *columns: str) -> tuple[DataFrame, str, list[str]]:
        """``docs`` joined by id and hash of the text with rows of ``members``, the name of the hash, and those of the members' columns."""
        names = fresh(self.docs, "th", "member_id", "member_th", *(f"member_{c}" for c in columns))
        th, one, two, *others = names
        slim = members.select(F.col("doc_id").alias(one), F.col("th").alias(two), *[F.col(c).alias(x) for c, x in zip(columns, others, strict=True)])
        rows = self.docs.withColumn(th, self._hash())
        return rows.join(small(slim), F.col(self.id_col).eqNullSafe(F.col(one)) & (F.col(th) == F.col(two)), how), th, others

    def annotate(self) -> DataFrame:
        """Every row of ``docs`` with keep_id, group_size, kept, text_sha256; columns of those names are replaced."""
        each = self.members.groupBy("doc_id", "th").agg(F.first("first").alias("first"), F.first("n").alias("n"), F.count("*").alias("repeats"), F.min("nid").alias("least"))
        out, th, (first, n, repeats, least) = self._matched(materialise(each, "each"), "left", "first", "n", "repeats", "least")
        own, alone, place = F.col(self.id_col), F.col(n).isNull(), f"{th}_place"
        mine = alone | (F.col(first)["nid"] == F.col(least))
        #: Only rows that share both id and text are ranked.
        ranked = out.filter(F.col(repeats) > 1).withColumn(place, F.row_number().over(Window.partitionBy(self.id_col, th).orderBy(F.lit(1))))
        both = out.filter(F.coalesce(F.col(repeats), F.lit(1)) == 1).withColumn(place, F.lit(1)).unionByName(ranked)
        passed = [c for c in self.docs.columns if c.lower() not in {"keep_id", "group_size", "kept", "text_sha256"}]
        return both.select(
            *passed, F.when(alone, own).otherwise(F.col(first)["doc_id"]).alias("keep_id"), F.coalesce(n, F.lit(1)).cast("long").alias("group_size"),
            (mine & (F.col(place) == 1)).alias("kept"), F.sha2(normalised(F.col(self.text_col)), 256).alias("text_sha256"),
        )

    def kept(self) -> DataFrame:
        """The rows of ``docs`` that stay; only repeats of one id and text are brought together."""
        each = self.members.groupBy("doc_id", "th").agg((F.min("nid") != F.first("first.nid")).alias("out"), F.count("*").alias("repeats"))
        each = materialise(each, "each", rows=self.n_rows)
        stay, th, _ = self._matched(each.filter("out"), "left_anti")
        repeated = each.filter("NOT out AND repeats > 1")
        if not repeated.isEmpty():
            one, two = fresh(stay, "member_id", "member_th")
            same = F.col(self.id_col).eqNullSafe(F.col(one)) & (F.col(th) == F.col(two))
            again = small(repeated.select(F.col("doc_id").alias(one), F.col("th").alias(two)))
            stay = stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates([self.id_col, th]))
        return stay.select(*self.docs.columns)


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return ExactDedup(docs, **options).kept()
