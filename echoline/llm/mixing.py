"""Mixing sources to target weights by Pareto order sampling.

Sizes are words. Sources in the order of their code points, null last, get the
weights 3, 1, 2, repeating, and share ``share`` times all words; a target stops at
``most`` times its source's words and the excess goes to the others by weight. The
shares that are left when nothing exceeds its stop are the level of a water fill,
so they come in one pass over the sources in the order of stop by weight.

A source whose target is r times its words takes floor(r) certain whole copies
of every document; the fraction is drawn by Pareto order sampling: documents are
ranked by their random odds u/(1-u) over their inclusion odds p/(1-p), and
the sample is fixed in size: the ranks up to the one at which the words come nearest
to what the target lacks. ``p`` goes with a document's worth: the binary digits of its size,
so that a document of 1,000 words is twice as likely as one of 30, or the column ``utility``, rounded to
eighths of an octave. Where p would pass 1 the document is certain and what it
can't use goes to the others: a water fill over the distinct worths of a source, which are
few. ``u`` comes from a digest of seed, id and text, so that reruns agree.

No group is sorted in one task: ranks fall in ``buckets`` bins whose words are summed
first, the bin that holds the boundary is cut into as many again, and only the small bin that
holds it is ordered, so that a hot source costs a share of 1/buckets squared. One row a source
goes through a window in one task.

Cases: a null text or one without words has size 0 and is taken 0 words; its copies
are the certain ones. A null, negative or zero utility, or none that is a number, is the least
worth. Rows that repeat id and text share one draw: all are taken or none. An empty
table gives an empty result; sources with no words get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.llm.common import fresh, materialise, n_words, temporary

#: Fixed values of the contract: weights by the source's place, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes``: source, source_size, one row a source. Adds weight and target."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    #: The first source that its share does not fill sets the level for all that follow.
    final = F.min(F.when(F.col("level") * F.col("weight") < F.col("stop"), F.struct(F.col("stop") / F.col("weight"), F.col("level")))).over(everything)
    return rows.withColumn("final", final).select(
        "source", "source_size", "weight",
        F.coalesce(F.least(F.col("stop"), F.col("final")["level"] * F.col("weight")), F.col("stop")).alias("target"),
    )


def uniform(seed: str, *columns: Column) -> Column:
    """In (0, 1), from 52 bits of an MD5 digest; nulls count as empty."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


#: The worth of documents that are worth nothing: they are drawn once all others are certain.
_LEAST = 2.0**-64


def _worth(size: Column, utility: str | None) -> Column:
    if utility is None:
        return F.when(size > 0, F.length(F.bin(size)).cast("double")).otherwise(F.lit(_LEAST))
    x = F.col(utility).cast("double")
    fine = x.isNotNull() & ~F.isnan(x) & (x > _LEAST) & (x < 2.0**64)
    return F.when(fine, F.pow(F.lit(2.0), F.round(F.log2(x) * 8) / 8)).when(x >= 2.0**64, F.lit(2.0**64)).otherwise(F.lit(_LEAST))


def _keyed(docs: DataFrame, seed: str, utility: str | None) -> list[Column]:
    size = n_words(F.col("text"))
    return [size, uniform(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))), _worth(size, utility)]


def _place(u: Column, worth: Column, rate: Column) -> Column:
    """The Pareto rank x as x / (1 + x), in (0, 1); -1 where inclusion is certain, null where it is impossible."""
    p = rate * worth
    x = (u / (1 - u)) / (p / (1 - p))
    return F.when(p >= 1, F.lit(-1.0)).when(p > 0, x / (1 + x))


def rates(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with rate, so that documents of worth w have p = min(1, rate * w), and rest: the words to draw beyond the certain ones."""
    mass = slim.filter("size > 0").groupBy("source", "worth").agg(F.sum("size").alias("mass"))
    mass = mass.join(goals.select(F.col("source").alias("s"), "need"), F.col("source").eqNullSafe(F.col("s")))
    down = Window.partitionBy("source").orderBy(F.desc("worth"))
    above = F.coalesce(F.sum("mass").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("mass") * F.col("worth")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = mass.withColumn("above", above).withColumn("rate", (F.col("need") - F.col("above")) / rest)
    #: Worths come from the highest down; the first one that is not certain sets the rate.
    found = level.filter(F.col("rate") * F.col("worth") < 1).groupBy("s").agg(F.max(F.struct("worth", "rate", "above")).alias("m"))
    out = goals.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return out.withColumn("rate", F.coalesce("m.rate", F.lit(0.0))).withColumn("rest", F.col("need") - F.coalesce("m.above", F.lit(0))).drop("m")


def _boundary(ranked: DataFrame, bin_: Column, by: list[str]) -> DataFrame:
    """The bin of each source in which the words reach ``rest``, and the words below it."""
    bins = ranked.select("source", "size", "rest", "below", *by, bin_.alias("bin")).groupBy("source", *by, "bin")
    bins = bins.agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("below").alias("start"))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.col("start") + F.sum("words").over(up)).withColumn("below", F.col("upto") - F.col("words"))
    return bins.filter("upto >= rest AND below < rest").select(F.col("source").alias("s"), *by, "bin", "below")


def plan(slim: DataFrame, share: float = 1.5, most: float = 2.0, buckets: int = 4096) -> DataFrame:
    """``slim``: source, size, u, worth. A row a source: what each of its documents needs to know."""
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = targets(totals, share, most).withColumn("whole", F.floor(ratio).cast("long"))
    goals = materialise(goals.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    goals = materialise(rates(slim, goals), "rates")

    same = F.col("source").eqNullSafe(F.col("s"))
    g = goals.select(F.col("source").alias("s"), "rate", "rest")
    ranked = slim.filter("size > 0").join(g, same).drop("s").withColumn("v", _place(F.col("u"), F.col("worth"), F.col("rate"))).filter("v >= 0")
    wide = F.floor(F.col("v") * buckets)
    fine = F.floor((F.col("v") * buckets - wide) * buckets)
    edge = _boundary(ranked.withColumn("below", F.lit(0)), wide, []).withColumnRenamed("bin", "wide")
    near = ranked.join(edge, same & (F.col("wide") == wide)).drop("s")
    edge = _boundary(near, fine, ["wide"]).withColumnRenamed("bin", "fine")
    last = near.drop("below", "wide").join(edge, same & (F.col("wide") == wide) & (F.col("fine") == fine)).drop("s")
    run = Window.partitionBy("source").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    reach = last.withColumn("miss", F.abs(F.col("below") + F.sum("size").over(run) - F.col("rest")))
    cuts = reach.groupBy("source").agg(F.min(F.struct("miss", "v")).alias("best"), F.first(F.col("rest") - F.col("below")).alias("short"), F.min("v").alias("least"))
    #: Up to and with the cut; or all before the first document of the last bin.
    cuts = cuts.select(F.col("source").alias("s"), F.when(F.col("best.miss") < F.col("short"), F.col("best.v")).otherwise(-F.col("least")).alias("cut"))
    return goals.join(cuts, same, "left").drop("s").withColumn("all", F.col("cut").isNull() & (F.col("rest") > 0))


class Mix:
    """Plans the mix of ``docs``; ``annotate`` gives rows their copies, ``judged`` does so without a further pass over texts."""

    def __init__(self, docs: DataFrame, seed: str = "mix-1", share: float = 1.5, most: float = 2.0, buckets: int = 4096, utility: str | None = None):
        self.docs, self.seed, self.utility = docs, seed, utility
        size, u, worth = _keyed(docs, seed, utility)
        self.slim = materialise(docs.select("doc_id", "source", size.alias("size"), u.alias("u"), worth.alias("worth")), "sizes")
        with temporary(docs.sparkSession):
            self.plan = materialise(plan(self.slim, share, most, buckets), "plan", outlives=True)

    def _copies(self, rows: DataFrame, size: str, u: str, worth: str, passed: list[str]) -> DataFrame:
        (g,) = fresh(rows, "mix_plan")
        out = rows.join(self.plan.select(F.struct(*self.plan.columns).alias(g)), F.col("source").eqNullSafe(F.col(g)["source"]))
        at = F.col(g)
        v = _place(F.col(u), F.col(worth), at["rate"])
        cut = at["cut"]
        inside = F.when(cut >= 0, v <= cut).otherwise(v < -cut)
        drawn = (F.col(size) > 0) & F.coalesce(at["all"] & v.isNotNull(), F.lit(False)) | ((F.col(size) > 0) & F.coalesce((v < 0) | inside, F.lit(False)))
        copies = at["whole"] + drawn.cast("long")
        return out.select(
            *passed, F.col(size).alias("size"), at["source_size"].cast("long").alias("source_size"), at["target"].cast("double").alias("target"),
            copies.alias("copies"), (copies * F.col(size)).alias("taken"),
        )

    def annotate(self) -> DataFrame:
        """``docs`` with size, source_size, target, copies and taken; columns of those names are replaced."""
        size, u, worth = fresh(self.docs, "mix_size", "mix_u", "mix_worth")
        new = dict(zip((size, u, worth), _keyed(self.docs, self.seed, self.utility), strict=True))
        kept = [c for c in self.docs.columns if c.lower() not in {"size", "source_size", "target", "copies", "taken"}]
        return self._copies(self.docs.withColumns(new), size, u, worth, kept)

    def judged(self) -> DataFrame:
        return self._copies(self.slim, "size", "u", "worth", ["doc_id"])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each with its number of copies."""
    return Mix(docs, **options).annotate().filter("copies > 0")
