"""All registered queries outside the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoline.plans import decisions, drivers, network, signals, surveys, transforms  # noqa: F401
from echoline.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs recordings, locates sources along the pipe, clusters and ranks them."""
    return network.located_clusters(spark, sf_dir)
