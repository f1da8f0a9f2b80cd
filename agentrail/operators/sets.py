"""Set operations on id columns and multi-source unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_ids(current: DataFrame, seen: DataFrame, col: str = "trace_id") -> DataFrame:
    """Ids present now and not seen before (``EXCEPT DISTINCT``)."""
    return current.select(col).subtract(seen.select(col))


def live_ids(files: DataFrame, table: DataFrame, col: str = "trace_id") -> DataFrame:
    """Ids that have files and rows in the table (``INTERSECT DISTINCT``)."""
    return files.select(col).intersect(table.select(col))


def distinct_clusters(features: DataFrame) -> DataFrame:
    """Distinct (model, layer, feature_id) to look up once each."""
    return features.select("model", "layer", "feature_id").distinct()


def union_sources(*dfs: DataFrame, source_names: list[str] | None = None) -> DataFrame:
    """Tables from several producers in one: columns matched by name, a
    column missing on one side becomes null; optional ``source`` label."""
    if source_names:
        dfs = tuple(d.withColumn("source", F.lit(n)) for d, n in zip(dfs, source_names))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
