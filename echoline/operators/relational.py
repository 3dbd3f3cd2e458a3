"""Joins, islands and ranks over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.functions.text import micros


def interval_join(a: DataFrame, b: DataFrame, a_ts: str, b_ts: str, within_s: float, on: Sequence[tuple[str, str]] = (), keep: Column | None = None) -> DataFrame:
    """All rows of ``a`` and ``b`` (column names disjoint) whose times differ by ``within_s`` at most.

    An equi-join on time buckets as wide as the window: ``a`` goes to its own bucket and both
    neighbours, ``b`` to its own, so every pair meets once and no nested loop is planned. Rows
    without a time match nothing. ``on`` adds equal columns, ``keep`` a condition.
    """
    width = int(within_s * 1_000_000)
    left = a.filter(F.col(a_ts).isNotNull()).withColumn("_t", micros(F.col(a_ts)))
    left = left.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_t") / width) + d for d in (-1, 0, 1)])))
    right = b.filter(F.col(b_ts).isNotNull()).withColumn("_u", micros(F.col(b_ts))).withColumn("_own", F.floor(F.col("_u") / width))
    meet = (F.col("_bucket") == F.col("_own")) & (F.abs(F.col("_t") - F.col("_u")) <= width)
    for x, y in on:
        meet &= F.col(x) == F.col(y)
    if keep is not None:
        meet &= keep
    return left.join(right, meet).withColumn("drift_s", F.abs(F.col("_t") - F.col("_u")) / 1e6).drop("_t", "_bucket", "_u", "_own")


def unordered_key(a: str, b: str) -> list[Column]:
    """The same for (a, b) and (b, a)."""
    return [F.least(a, b).alias("key_lo"), F.greatest(a, b).alias("key_hi")]


def first_by(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in an order that the caller makes total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn(rank or "_place", place).filter(F.col(rank or "_place") <= n)
    return out if rank else out.drop("_place")


def gap_clusters(df: DataFrame, keys: Sequence[str], at: str, gap: float, *tie: str, name: str = "cluster_id") -> DataFrame:
    """Single linkage in one dimension: a new cluster begins where the step from the row before exceeds ``gap``."""
    by = Window.partitionBy(*keys).orderBy(at, *tie)
    begins = F.coalesce((F.col(at) - F.lag(at).over(by) > gap).cast("int"), F.lit(0))
    return df.withColumn("_begins", begins).withColumn(name, F.sum("_begins").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Maximal runs of rows for which ``flag`` holds: keys, run id, first and last place, length, and the rows of the group."""
    by, same = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys, "_flag").orderBy(*order)
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_place", F.row_number().over(by)).withColumn("_all", F.count("*").over(Window.partitionBy(*keys)))
    marked = marked.withColumn("_run", F.col("_place") - F.row_number().over(same)).filter("_flag")
    return marked.groupBy(*keys, F.col("_run").alias("run_id")).agg(
        F.min("_place").alias("first_place"), F.max("_place").alias("last_place"), F.count("*").alias("run_length"), F.first("_all").alias("n_rows")
    )


def last_wins(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Upsert: the last row of each key."""
    return first_by(df, keys, *order)


def anti_join_new(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was never seen, each key once."""
    return rows.join(seen.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def ranks(df: DataFrame, keys: Sequence[str], bin_: Column, *order: Column, rank: str = "place") -> DataFrame:
    """The place of every row of a key in an order that ``bin_`` never goes against.

    Bins are counted first, so rows are ordered inside a bin only and no task sees a whole key. ``bin_`` takes a bounded
    number of values, as the counts go to all tasks.
    """
    binned = df.withColumn("_bin", bin_)
    up = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0))).drop("_n")
    out = null_safe_join(binned, before, [*keys, "_bin"])
    return out.withColumn(rank, F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(*order))).drop("_bin", "_before")


def null_safe_join(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``small``, a row a key, null keys included."""
    named = small.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    return df.join(F.broadcast(named), same).drop(*(f"_key_{k}" for k in keys))


def even_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int = 1024) -> tuple[DataFrame, Column]:
    """``df`` with the range of each key, and the bin of a row's value in it, for ``ranks``."""
    range_ = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    bin_ = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return null_safe_join(df, range_, keys), bin_


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], extra: dict[str, tuple[str, str]] | None = None, bins: int = 65536) -> DataFrame:
    """Exact interpolated quantiles of ``value`` for each of a few keys: a row a key with its columns ``n`` (rows) and ``shares``.

    Values are counted in bins of 1/``bins`` first; then only the values in the bins that hold a wanted rank are ranked, so
    no task sees a key's values. ``df`` is worked out twice. ``extra``: sums that come along, as name: (column, sum or count).
    """
    def bin_of(c: str) -> Column:
        return F.floor(F.col(c) * bins)

    by = lambda *order: Window.partitionBy(*keys).orderBy(*order)
    more = {k: (c, how) for k, (c, how) in (extra or {}).items()}
    known = F.count(value).alias("_c")
    sums = df.groupBy(*keys, bin_of(value).alias("_bin")).agg(F.count("*").alias("_n"), known, *[getattr(F, how)(c).alias(k) for k, (c, how) in more.items()])
    total = sums.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.sum("_c").alias("_all"), *[F.sum(k).alias(k) for k in more])
    #: The two ranks, from 0, around each quantile.
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_all") - 1) * F.lit(share)).alias("at")) for name, share in shares.items()]))
    wanted = total.filter("_all > 0").select(*keys, at.alias("w")).select(*keys, "w.*").withColumns({"lower": F.floor("at"), "upper": F.ceil("at")})
    full = sums.filter("_bin IS NOT NULL").withColumn("_upto", F.sum("_c").over(by("_bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.col("_upto") - F.col("_c"))
    holds = lambda rank: (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_upto"))
    hits = null_safe_inner(full.select(*keys, "_bin", "_before", "_upto"), wanted, keys).filter(holds("lower") | holds("upper"))
    chosen = hits.select(*keys, "_bin", "_before").distinct()
    few = null_safe_inner(df.select(*keys, value, bin_of(value).alias("_bin")), chosen, [*keys, "_bin"])
    few = few.groupBy(*keys, "_bin", "_before", value).agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)).withColumn("_before", F.col("_upto") - F.col("_n"))
    ends = null_safe_inner(few, wanted, keys).groupBy(*keys, "name", "at", "lower", "upper").agg(*[F.max(F.when(holds(x), F.col(value))).alias(f"_{x}") for x in ("lower", "upper")])
    q = F.when(F.col("lower") == F.col("upper"), F.col("_lower")).otherwise((F.col("upper") - F.col("at")) * F.col("_lower") + (F.col("at") - F.col("lower")) * F.col("_upper"))
    ends = ends.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, q)).alias(name) for name in shares])
    missing = {k: ends[k] for k in shares}
    left = ends.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *missing)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.lit(True))
    return total.join(F.broadcast(left), same, "left").select(*keys, "n", *more, *shares)


def null_safe_inner(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of the rows of ``small`` that have its keys, null keys included."""
    named = small.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.lit(True))
    return df.join(F.broadcast(named), same).drop(*(f"_key_{k}" for k in keys))
