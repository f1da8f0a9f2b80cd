"""Trace files in the JSONL wire format: one file per trace, a header line
(``_type = "trace"``) followed by one line per step (``_type = "step"``).

Reading is tolerant: a blank line is dropped; a line that is not JSON, or
is JSON but not an object, is counted as skipped and never fails the job.

Scale notes: ``read_trace_lines`` reads large files by split, many tasks a
file, with line numbers from counts by split (``sources/lines.py``).  Where a
file's whole text is wanted (``read_trace_files``) it is one row and must fit
in a task's memory.  Per-file work is aggregates keyed by the file path, so
the only shuffles are the ``file`` group-bys, which combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import numbered_lines

# Envelope keys of a wire record (all read as raw JSON text, then typed).
ENVELOPE = ["_type", "trace_id", "name", "framework", "started_at", "ended_at", "metadata",
            "step_id", "parent_step_id", "kind", "inputs", "outputs", "error"]

TRACE_COLS = ["trace_id", "name", "framework", "started_at", "ended_at", "metadata"]
STEP_COLS = ["trace_id", "step_id", "step_index", "parent_step_id", "kind", "name",
             "started_at", "ended_at", "inputs", "outputs", "metadata", "error"]


def read_trace_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row per trace file under ``path`` (glob allowed)."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def is_json_object(line: Column) -> Column:
    """True iff the line is exactly one JSON value and that value is an
    object: wrapping it in ``[...]`` must give a one-element array (this
    rejects trailing garbage and concatenated objects), and it must start
    with ``{``."""
    return F.coalesce(
        (F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1)
        & F.ltrim(line).startswith("{"), F.lit(False))


def trace_lines(files: DataFrame) -> DataFrame:
    """(file, text) -> one row per non-blank physical line:
    ``file, pos, line, good, rec`` where ``rec`` is the parsed envelope
    (all fields as raw JSON text) for good lines."""
    lines = files.select("file", F.posexplode(F.split(F.col("text"), "\r\n|\r|\n")).alias("pos", "line"))
    return parsed_lines(lines.filter(~F.col("line").rlike(r"^\s*$")))


def parsed_lines(lines: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Non-blank lines (file, pos, line) with ``good`` and ``rec``, and the
    columns named by ``keep``."""
    ddl = ", ".join(f"`{k}` string" for k in ENVELOPE)
    good = is_json_object(F.col("line"))
    return lines.select("file", "pos", "line", *keep, good.alias("good"),
                        F.when(good, F.from_json("line", ddl)).alias("rec"))


def read_trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """``trace_lines`` of the files under ``path`` (glob allowed), read by
    split; ``pos`` is the 0-based physical line."""
    return parsed_lines(numbered_lines(spark, path).select("file", (F.col("line_no") - 1).alias("pos"), "line"))


def corrupt_line_report(lines: DataFrame) -> DataFrame:
    """Per file: parsed records and skipped lines."""
    return lines.groupBy("file").agg(F.count(F.when(F.col("good"), 1)).alias("records"),
                                     F.count(F.when(~F.col("good"), 1)).alias("skipped"))


def _num(c: Column) -> Column:
    return c.try_cast("double")


def file_stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(\.jsonl)?$", 1)


def split_traces(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, steps) from parsed lines.  Header = the **last** record with
    ``_type = "trace"`` in the file; steps = every ``_type = "step"``
    record in file order with a 0-based ``step_index``; other records are
    dropped.  Steps carry the header's trace id (the file stem when the
    header is missing)."""
    good = lines.filter("good")
    hdr = (good.filter(F.col("rec._type") == "trace")
           .groupBy("file").agg(F.max_by("rec", "pos").alias("h")))
    traces = hdr.select(
        "file",
        F.col("h.trace_id").alias("trace_id"), F.col("h.name").alias("name"),
        F.col("h.framework").alias("framework"),
        _num(F.col("h.started_at")).alias("started_at"), _num(F.col("h.ended_at")).alias("ended_at"),
        F.coalesce(F.col("h.metadata"), F.lit("{}")).alias("metadata"))
    # records are read and dealt by file once; headers come first there, so that
    # every step meets the last of them in a running window
    upto = Window.partitionBy("file").orderBy("_step", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(~F.col("_step") & F.col("file").isNotNull(), F.struct("pos", F.col("rec.trace_id").alias("id")))
    st = (good.filter(F.col("rec._type").isin("step", "trace")).withColumn("_step", F.col("rec._type") == "step")
          .withColumn("_tid", F.max(head).over(upto)["id"])
          .withColumn("step_index", (F.row_number().over(Window.partitionBy("file", "_step").orderBy("pos")) - 1).cast("int")))
    steps = (st.filter("_step")
             .select("file", F.coalesce("_tid", file_stem(F.col("file"))).alias("trace_id"),
                     F.col("rec.step_id").alias("step_id"), "step_index",
                     F.col("rec.parent_step_id").alias("parent_step_id"),
                     F.col("rec.kind").alias("kind"), F.col("rec.name").alias("name"),
                     _num(F.col("rec.started_at")).alias("started_at"),
                     _num(F.col("rec.ended_at")).alias("ended_at"),
                     F.coalesce(F.col("rec.inputs"), F.lit("{}")).alias("inputs"),
                     F.coalesce(F.col("rec.outputs"), F.lit("{}")).alias("outputs"),
                     F.coalesce(F.col("rec.metadata"), F.lit("{}")).alias("metadata"),
                     F.col("rec.error").alias("error")))
    return traces, steps


def read_headers(lines: DataFrame) -> DataFrame:
    """Header-only scan: the first parsed object of a file must be the
    header, otherwise the file yields nothing."""
    first = lines.filter("good").groupBy("file").agg(F.min_by("rec", "pos").alias("h"))
    return first.filter(F.col("h._type") == "trace").select(
        "file", F.col("h.trace_id").alias("trace_id"), F.col("h.name").alias("name"),
        F.col("h.framework").alias("framework"), _num(F.col("h.started_at")).alias("started_at"),
        _num(F.col("h.ended_at")).alias("ended_at"))


def strict_lines(lines: DataFrame) -> DataFrame:
    """Index policy: a file with any bad line is rejected whole."""
    bad = lines.filter(~F.col("good")).select("file").distinct()
    return lines.join(bad, "file", "left_anti")


def quarantine_split(lines: DataFrame) -> DataFrame:
    """Per file: ``quarantine`` when it has skipped lines or no trace header,
    with the reason text ('N corrupt line(s)' or 'no trace header')."""
    rep = lines.groupBy("file").agg(
        F.count(F.when(~F.col("good"), 1)).alias("skipped"),
        F.max(F.when(F.col("good") & (F.col("rec._type") == "trace"), True)).alias("_hdr"))
    bad = (F.col("skipped") > 0) | F.col("_hdr").isNull()
    return rep.select(
        "file", "skipped", bad.alias("quarantine"),
        F.when(F.col("skipped") > 0, F.concat(F.col("skipped").cast("string"), F.lit(" corrupt line(s)")))
        .when(F.col("_hdr").isNull(), F.lit("no trace header")).alias("reason"))


def dashboard_counts(files: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Dashboard tiles over raw files: traces (files), failed (header
    ``metadata.failed``), steps = physical lines - 1 of files whose first
    line is a header (corrupt lines count), annotations."""
    from ..operators.stats import failed_flag
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n"))
                         .alias("pos", "line"))
    per = lines.groupBy("file").agg(F.count(F.lit(1)).alias("_n"),
                                    F.min_by("line", "pos").alias("_first"))
    h = F.from_json(F.col("_first"), "_type string, metadata string")
    per = per.select("_n", F.when(is_json_object(F.col("_first")) & (h["_type"] == "trace"), True)
                     .alias("_hdr"), failed_flag(h["metadata"]).alias("_failed"))
    out = per.agg(F.count(F.lit(1)).alias("traces"),
                  F.count(F.when(F.col("_hdr") & F.col("_failed"), 1)).alias("failed"),
                  F.coalesce(F.sum(F.when(F.col("_hdr"), F.greatest(F.col("_n") - 1, F.lit(0)))), F.lit(0))
                  .cast("bigint").alias("steps"))
    if annotations is not None:
        out = out.withColumn("annotations", annotations.agg(F.count(F.lit(1))).scalar())
    return out
