"""Listing and removal of annotations.

Each takes the current annotations (one row a step, see
``windows.latest_annotations``) as they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import valid_prefix

SHORT_ID = 12


def list_annotations(annotations: DataFrame, traces: DataFrame, prefix: str | None = None) -> DataFrame:
    """Annotations of captured traces, of one trace prefix if given: ids whole
    and as shown (12 characters), category, severity and notes ('—' for none).
    Annotations whose trace is gone are not listed."""
    a = annotations if prefix is None else annotations.where(F.col("trace_id").startswith(prefix))
    return a.join(traces.select("trace_id"), "trace_id", "left_semi").select(
        "trace_id", "step_id", F.substring("trace_id", 1, SHORT_ID).alias("trace"),
        F.substring("step_id", 1, SHORT_ID).alias("step"), "failure_category", "severity",
        F.coalesce(F.nullif(F.col("notes"), F.lit("")), F.lit("—")).alias("notes"))


def resolve_steps(steps: DataFrame, requests: DataFrame) -> DataFrame:
    """(trace_id, step_ref) -> step_id: the first step in order whose id starts
    with the reference, or the reference itself where none does or where it is no
    usable prefix.  A step goes out once for each distinct reference length of
    its trace and meets references by equality; rows with a null are dropped."""
    asked = requests.select("trace_id", "step_ref").dropna().distinct()
    sizes = (asked.where(valid_prefix(F.col("step_ref"))).groupBy("trace_id")
             .agg(F.collect_set(F.length("step_ref")).alias("sizes")))        # 128 lengths at most
    heads = (steps.select("trace_id", "step_id", "step_index").join(sizes, "trace_id")
             .select("trace_id", "step_id", "step_index", F.explode("sizes").alias("n"))
             .where(F.length("step_id") >= F.col("n"))
             .withColumn("step_ref", F.col("step_id").substr(F.lit(1), F.col("n"))))
    first = heads.groupBy("trace_id", "step_ref").agg(F.min(F.struct("step_index", "step_id"))["step_id"].alias("found"))
    return asked.join(first, ["trace_id", "step_ref"], "left").select(
        "trace_id", "step_ref", F.coalesce("found", "step_ref").alias("step_id"))


def remove_annotations(annotations: DataFrame, steps: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations left, outcome of every distinct request).  ``requests`` has
    trace_id and step_ref, a step id or its beginning; outcome: trace_id,
    step_ref, step_id, removed (false where that step has no annotation)."""
    key = ["trace_id", "step_id"]
    resolved = resolve_steps(steps, requests)
    left = annotations.join(resolved.select(*key).distinct(), key, "left_anti")
    had = annotations.select(*key).distinct().withColumn("_had", F.lit(True))
    outcome = resolved.join(had, key, "left").select(
        "trace_id", "step_ref", "step_id", F.coalesce("_had", F.lit(False)).alias("removed"))
    return left, outcome


def clear_annotations(annotations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations left, trace_id and cleared for every distinct id asked):
    all annotations of the traces go; a trace without any is not an error."""
    asked = ids.select("trace_id").dropna().distinct()
    had = annotations.select("trace_id").distinct().withColumn("_had", F.lit(True))
    return (annotations.join(asked, "trace_id", "left_anti"),
            asked.join(had, "trace_id", "left").select("trace_id", F.coalesce("_had", F.lit(False)).alias("cleared")))
