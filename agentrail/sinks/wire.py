"""Writing traces in the JSONL wire format.

Key order is fixed (header: _type, trace_id, name, framework, started_at,
ended_at, metadata; step: _type, step_id, parent_step_id, kind, name,
started_at, ended_at, inputs, outputs, metadata, error), separators are
compact, nulls are explicit, payloads are spliced in as compact JSON.
Deviation: non-ASCII characters are written as UTF-8, not ``\\uXXXX``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import json_compact, json_number, json_string


def wire_lines(traces: DataFrame, steps: DataFrame) -> DataFrame:
    """(trace_id, pos, line): pos 0 is the header, steps follow by index."""
    h = traces.select(
        "trace_id", F.lit(0).cast("bigint").alias("pos"),
        F.concat(F.lit('{"_type":"trace","trace_id":'), json_string("trace_id"),
                 F.lit(',"name":'), json_string("name"),
                 F.lit(',"framework":'), json_string("framework"),
                 F.lit(',"started_at":'), json_number("started_at"),
                 F.lit(',"ended_at":'), json_number("ended_at"),
                 F.lit(',"metadata":'), json_compact("metadata"), F.lit("}")).alias("line"))
    s = steps.select(
        "trace_id", (F.col("step_index") + 1).cast("bigint").alias("pos"),
        F.concat(F.lit('{"_type":"step","step_id":'), json_string("step_id"),
                 F.lit(',"parent_step_id":'), json_string("parent_step_id"),
                 F.lit(',"kind":'), json_string("kind"),
                 F.lit(',"name":'), json_string("name"),
                 F.lit(',"started_at":'), json_number("started_at"),
                 F.lit(',"ended_at":'), json_number("ended_at"),
                 F.lit(',"inputs":'), json_compact("inputs"),
                 F.lit(',"outputs":'), json_compact("outputs"),
                 F.lit(',"metadata":'), json_compact("metadata"),
                 F.lit(',"error":'), json_string("error"), F.lit("}")).alias("line"))
    return h.unionByName(s)


def save_wire(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One logical file per trace: lines are hash-partitioned by trace id,
    sorted by position inside each task and written under
    ``path/trace_id=<id>/``.  A trace is bounded in size, so one task per
    trace directory is fine; many traces spread over all tasks."""
    (lines.repartition("trace_id").sortWithinPartitions("trace_id", "pos")
     .select("trace_id", "line").write.mode(mode).partitionBy("trace_id").text(path))


def trace_texts(lines: DataFrame) -> DataFrame:
    """(file, text) rows like ``read_trace_files`` gives, built in memory:
    lines of a trace joined by newline in position order (per-trace
    aggregate, bounded by trace size)."""
    return (lines.groupBy("trace_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))),
                                          lambda x: x["line"]), "\n").alias("text"))
            .select(F.concat(F.lit("traces/"), F.col("trace_id"), F.lit(".jsonl")).alias("file"),
                    F.concat(F.col("text"), F.lit("\n")).alias("text")))


def save_wire_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Packed layout for large volumes: the wire lines as a Parquet table
    (trace_id, pos, line), clustered by trace so a trace's lines sit in one
    file; no per-trace file or directory is created."""
    (lines.repartition("trace_id").sortWithinPartitions("trace_id", "pos")
     .write.mode(mode).option("compression", "zstd").parquet(path))


def read_wire_lines(spark, path: str) -> DataFrame:
    """Packed wire lines -> (file, text) rows for the tolerant reader."""
    return trace_texts(spark.read.schema("trace_id string, pos bigint, line string").parquet(path))
