"""Raw data in and out: wire reader / writer, corrupt-line accounting,
header / step split, strict reads, quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sinks import wire as WS
from ..sources import wire as WR
from ..sources.lines import numbered_lines
from .catalog import register

# DuckDB: wire_files -> non-blank lines with a validity flag.
LINES = r"""
, wl0 AS (SELECT file, string_split(text, chr(10)) AS parts FROM wire_files),
wl1 AS (SELECT file, parts, unnest(generate_series(1, len(parts))) AS i FROM wl0),
wl AS (SELECT file, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS line FROM wl1
       WHERE NOT regexp_matches(parts[i], '^\s*$')),
wg AS (SELECT *, CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END AS good
       FROM wl),
wr AS (SELECT *, CASE WHEN good THEN json_extract_string(line, '$._type') END AS rtype FROM wg)"""

HEADERS = r"""
, hh AS (SELECT file, arg_max(line, pos) AS h FROM wr WHERE good AND rtype = 'trace' GROUP BY file),
tr AS (SELECT file, json_extract_string(h, '$.trace_id') AS trace_id, json_extract_string(h, '$.name') AS name,
         json_extract_string(h, '$.framework') AS framework,
         TRY_CAST(json_extract_string(h, '$.started_at') AS DOUBLE) AS started_at,
         TRY_CAST(json_extract_string(h, '$.ended_at') AS DOUBLE) AS ended_at FROM hh)"""


def _lines(fx):
    return WR.trace_lines(fx.get("wire_files"))


@register("read_trace_lines", ["wire_files"], LINES + """
SELECT file, pos, good, rtype AS record_type,
  CASE WHEN good THEN coalesce(json_extract_string(line, '$.step_id'), json_extract_string(line, '$.trace_id')) END
    AS record_id
FROM wr""")
def q_read_trace_lines(fx):
    """Tolerant line read of trace files: position, validity, record type and id."""
    ln = _lines(fx)
    return ln.select("file", "pos", "good", F.col("rec._type").alias("record_type"),
                     F.coalesce(F.col("rec.step_id"), F.col("rec.trace_id")).alias("record_id")).withColumn(
        "pos", F.col("pos").cast("bigint"))


@register("trace_lines_by_split", ["wire_files"], LINES + """
SELECT good, rtype AS record_type,
  CASE WHEN good THEN coalesce(json_extract_string(line, '$.step_id'), json_extract_string(line, '$.trace_id')) END
    AS record_id, true AS in_order
FROM wr""")
def q_trace_lines_by_split(fx):
    """Lines written to files in the shared folder, each with its place in its
    file, and read back by split: records, and whether the place is the number."""
    path = scratch_path(fx.spark, "lines")
    own = _lines(fx).select("line").withColumn("nth", F.monotonically_increasing_id())
    place = F.col("nth") - F.shiftleft(F.shiftright("nth", 33), 33)
    own.select(F.concat(place.cast("string"), F.lit(" "), "line")).write.text(path)
    got = numbered_lines(fx.spark, path)
    cut = F.locate(" ", F.col("line"))
    ln = WR.parsed_lines(got.select("file", (F.col("line_no") - 1).alias("pos"),
                                    F.substring("line", F.lit(1), cut - 1).cast("bigint").alias("place"),
                                    F.expr("substring(line, locate(' ', line) + 1)").alias("line")), ["place"])
    return ln.select("good", F.col("rec._type").alias("record_type"),
                     F.coalesce(F.col("rec.step_id"), F.col("rec.trace_id")).alias("record_id"),
                     (F.col("place") == F.col("pos")).alias("in_order"))


@register("corrupt_line_report", ["wire_files"], LINES + """
SELECT file, count(CASE WHEN good THEN 1 END) AS records, count(CASE WHEN NOT good THEN 1 END) AS skipped
FROM wr GROUP BY file""")
def q_corrupt_line_report(fx):
    """Parsed records and skipped lines per trace file."""
    return WR.corrupt_line_report(_lines(fx))


@register("split_header_steps", ["wire_files"], LINES + HEADERS + """
SELECT file, trace_id, name, framework, started_at, ended_at FROM tr""")
def q_split_header_steps(fx):
    """Trace headers (last header record of each file wins)."""
    t, _ = WR.split_traces(_lines(fx))
    return t.select("file", "trace_id", "name", "framework", "started_at", "ended_at")


@register("split_steps", ["wire_files"], LINES + HEADERS + r"""
SELECT w.file, coalesce(tr.trace_id, regexp_extract(w.file, '([^/]+?)(\.jsonl)?$', 1)) AS trace_id,
  json_extract_string(w.line, '$.step_id') AS step_id,
  CAST(row_number() OVER (PARTITION BY w.file ORDER BY w.pos) - 1 AS BIGINT) AS step_index,
  json_extract_string(w.line, '$.kind') AS kind, json_extract_string(w.line, '$.name') AS name,
  TRY_CAST(json_extract_string(w.line, '$.started_at') AS DOUBLE) AS started_at,
  json_extract_string(w.line, '$.error') AS error,
  json_extract_string(w.line, '$.outputs.input_tokens') AS input_tokens
FROM wr w LEFT JOIN tr ON w.file = tr.file WHERE w.good AND w.rtype = 'step'""")
def q_split_steps(fx):
    """Step records of each file in order, with 0-based step index."""
    _, s = WR.split_traces(_lines(fx))
    return s.select("file", "trace_id", "step_id", F.col("step_index").cast("bigint").alias("step_index"),
                    "kind", "name", "started_at", "error",
                    F.get_json_object("outputs", "$.input_tokens").alias("input_tokens"))


@register("read_headers", ["wire_files"], LINES + """
, f AS (SELECT file, arg_min(line, pos) AS h FROM wr WHERE good GROUP BY file)
SELECT file, json_extract_string(h, '$.trace_id') AS trace_id, json_extract_string(h, '$.name') AS name
FROM f WHERE json_extract_string(h, '$._type') = 'trace'""")
def q_read_headers(fx):
    """Header-only scan (first parsed object must be the header)."""
    return WR.read_headers(_lines(fx)).select("file", "trace_id", "name")


@register("strict_read", ["wire_files"], LINES + """
SELECT file, count(*) AS lines FROM wr
WHERE file NOT IN (SELECT file FROM wr WHERE NOT good) GROUP BY file""")
def q_strict_read(fx):
    """Files accepted under the strict policy (no bad line), with line counts."""
    return WR.strict_lines(_lines(fx)).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


@register("quarantine_split", ["wire_files"], LINES + """
SELECT file, count(CASE WHEN NOT good THEN 1 END) AS skipped,
  (count(CASE WHEN NOT good THEN 1 END) > 0 OR count(CASE WHEN good AND rtype = 'trace' THEN 1 END) = 0)
    AS quarantine,
  CASE WHEN count(CASE WHEN NOT good THEN 1 END) > 0
         THEN CAST(count(CASE WHEN NOT good THEN 1 END) AS VARCHAR) || ' corrupt line(s)'
       WHEN count(CASE WHEN good AND rtype = 'trace' THEN 1 END) = 0 THEN 'no trace header' END AS reason
FROM wr GROUP BY file""")
def q_quarantine_split(fx):
    """Files to quarantine (skipped lines or no header) with the reason."""
    return WR.quarantine_split(_lines(fx))


@register("dashboard_counts", ["wire_files", "ev_annotations"], r"""
, p AS (SELECT file, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS parts FROM wire_files),
f AS (SELECT file, len(parts) AS n, parts[1] AS first FROM p),
g AS (SELECT *, CASE WHEN json_valid(first) AND json_type(first) = 'OBJECT'
                 THEN json_extract_string(first, '$._type') = 'trace' ELSE false END AS hdr FROM f)
SELECT count(*) AS traces,
  count(CASE WHEN hdr AND json_extract_string(first, '$.metadata.failed') = 'true' THEN 1 END) AS failed,
  CAST(coalesce(sum(CASE WHEN hdr THEN greatest(n - 1, 0) END), 0) AS BIGINT) AS steps,
  (SELECT count(*) FROM ev_annotations) AS annotations
FROM g""")
def q_dashboard_counts(fx):
    """Dashboard tiles from raw files (steps = physical lines - 1)."""
    return WR.dashboard_counts(fx.get("wire_files"), fx.get("ev_annotations"))


@register("write_wire", ["ev_traces", "ev_steps"], """
SELECT trace_id, CAST(0 AS BIGINT) AS pos,
  '{"_type":"trace","trace_id":' || to_json(trace_id) || ',"name":' || to_json(name) ||
  ',"framework":' || coalesce(CAST(to_json(framework) AS VARCHAR), 'null') ||
  ',"started_at":' || CAST(started_at AS VARCHAR) ||
  ',"ended_at":' || coalesce(CAST(ended_at AS VARCHAR), 'null') || ',"metadata":' || metadata || '}' AS line
FROM ev_traces
UNION ALL
SELECT trace_id, CAST(step_index + 1 AS BIGINT),
  '{"_type":"step","step_id":' || to_json(step_id) ||
  ',"parent_step_id":' || coalesce(CAST(to_json(parent_step_id) AS VARCHAR), 'null') ||
  ',"kind":' || to_json(kind) || ',"name":' || to_json(name) ||
  ',"started_at":' || CAST(started_at AS VARCHAR) ||
  ',"ended_at":' || coalesce(CAST(ended_at AS VARCHAR), 'null') ||
  ',"inputs":' || inputs || ',"outputs":' || outputs || ',"metadata":' || metadata ||
  ',"error":' || coalesce(CAST(to_json(error) AS VARCHAR), 'null') || '}'
FROM ev_steps""")
def q_write_wire(fx):
    """Wire-format text of every header and step line."""
    return WS.wire_lines(fx.get("ev_traces"), fx.get("ev_steps"))


@register("wire_roundtrip", ["ev_traces", "ev_steps"], """
SELECT trace_id, step_id, CAST(step_index AS BIGINT) AS step_index, kind, name, started_at, ended_at, error
FROM ev_steps""")
def q_wire_roundtrip(fx):
    """Steps written as wire text, read back by the tolerant reader and split."""
    text = WS.trace_texts(WS.wire_lines(fx.get("ev_traces"), fx.get("ev_steps")))
    _, s = WR.split_traces(WR.trace_lines(text))
    return s.select("trace_id", "step_id", F.col("step_index").cast("bigint").alias("step_index"),
                    "kind", "name", "started_at", "ended_at", "error")
