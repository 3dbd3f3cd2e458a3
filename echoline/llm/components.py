"""Connected components of an edge table by alternating large-star and small-star steps.

The steps of a round are a grouped minimum and a join each, and at its end the edges of each partition are contracted
to stars in the partition's own task, so neither links nor components reach
the driver. Tables between rounds go to the shared folder. Edges that a count shows to be few
enough for one partition are contracted there, which ends the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import materialise


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least of its component, for nodes that are not the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with a star for each part that a partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(p.column(0).to_numpy(), p.column(1).to_numpy()) for p in batches]
        if parts:
            a, b = stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node goes to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them. ``edges``: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, one_task: int = 500_000) -> DataFrame:
    """``edges``: a, b long. Returns node, root: the least node of its component; nodes without edges are absent.

    The rounds end when the edges stay as they are; their number grows with the logarithm of the longest path.
    ``one_task``: so many edges fit one partition.
    """
    #: Written as they come: a task that makes edges in Python needs no second worker beside it.
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 7))")).first())
    seen, found = None, state(now)
    while found[0] > one_task and found != seen:
        seen = found
        now = materialise(_contracted(_small_star(_large_star(now))), "stars")
        found = state(now)
    if 0 < found[0] <= one_task:
        now = materialise(_contracted(now.coalesce(1)), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
