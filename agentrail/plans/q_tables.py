"""Table upkeep: keyed upsert, removal, full rebuild, drift check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..sinks import tables as TB
from ..sources import wire as WR
from .catalog import register
from .q_io import LINES


@register("upsert_traces", ["ev_traces"], """
SELECT trace_id, 'stale' AS name, framework FROM ev_traces WHERE started_at < 1705363200.0
UNION ALL
SELECT trace_id, name, framework FROM ev_traces WHERE started_at >= 1705363200.0""")
def q_upsert_traces(fx):
    """A stale copy of the whole trace table upserted with a batch of the
    traces captured from 2024-01-16 on: the batch replaces its ids, the
    others stay; applying the batch twice changes nothing."""
    t = fx.get("ev_traces")
    stale = t.select("trace_id", F.lit("stale").alias("name"), "framework")
    batch = t.filter(F.col("started_at") >= 1705363200.0).select("trace_id", "name", "framework")
    return TB.upsert(TB.upsert(stale, batch), batch)


@register("remove_traces", ["ev_traces", "ev_annotations"], """
SELECT trace_id FROM ev_traces WHERE trace_id NOT IN (SELECT trace_id FROM ev_annotations)""")
def q_remove_traces(fx):
    """Trace table after removing every annotated trace id."""
    return TB.remove(fx.get("ev_traces").select("trace_id"), fx.get("ev_annotations"))


@register("build_trace_tables", ["wire_files"], LINES + """
, pf AS (SELECT file, count(CASE WHEN NOT good THEN 1 END) AS bad,
           count(CASE WHEN good AND rtype = 'trace' THEN 1 END) AS hdr FROM wr GROUP BY file)
SELECT count(CASE WHEN bad = 0 AND hdr > 0 THEN 1 END) AS indexed,
  count(CASE WHEN bad > 0 OR hdr = 0 THEN 1 END) AS skipped FROM pf""")
def q_build_trace_tables(fx):
    """Full rebuild from trace files under the strict policy: files indexed
    and skipped."""
    _, _, report = TB.build_tables(WR.trace_lines(fx.get("wire_files")))
    return report


@register("build_trace_steps", ["wire_files"], LINES + """
, pf AS (SELECT file FROM wr GROUP BY file
         HAVING count(CASE WHEN NOT good THEN 1 END) = 0 AND count(CASE WHEN good AND rtype = 'trace' THEN 1 END) > 0)
SELECT count(*) AS steps, count(DISTINCT json_extract_string(line, '$.step_id')) AS step_ids
FROM wr WHERE file IN (SELECT file FROM pf) AND good AND rtype = 'step'""")
def q_build_trace_steps(fx):
    """Step table of the strict rebuild (row and id counts)."""
    _, steps, _ = TB.build_tables(WR.trace_lines(fx.get("wire_files")))
    return steps.agg(F.count(F.lit(1)).alias("steps"), F.countDistinct("step_id").alias("step_ids"))


@register("index_drift", ["ev_traces", "wire_files"], LINES + """
, disk AS (SELECT DISTINCT regexp_extract(file, '([^/]+?)(\\.jsonl)?$', 1) AS trace_id FROM wr
           GROUP BY file HAVING count(CASE WHEN NOT good THEN 1 END) = 0),
t AS (SELECT e.trace_id, e.started_at, d.trace_id IS NOT NULL AS on_disk FROM ev_traces e
      LEFT JOIN disk d ON e.trace_id = d.trace_id),
newest AS (SELECT * FROM t ORDER BY started_at DESC NULLS LAST, trace_id LIMIT 20)
SELECT (SELECT count(*) FROM t) AS table_rows, (SELECT count(*) FROM t WHERE NOT on_disk) AS phantoms,
  (SELECT count(*) FROM disk) AS disk_traces, (SELECT count(*) FROM newest) AS sampled,
  (SELECT count(*) FROM newest WHERE NOT on_disk) AS sample_phantoms,
  (SELECT count(*) FROM newest WHERE NOT on_disk) / greatest((SELECT count(*) FROM newest), 1) > 0.25 AS rebuild""")
def q_index_drift(fx):
    """Trace table vs trace files left after quarantining corrupt ones:
    phantom rows and whether the newest 20 say 'rebuild'."""
    lines = WR.trace_lines(fx.get("wire_files"))
    good_files = WR.strict_lines(lines).select("file").distinct()
    files = good_files.select(WR.file_stem(F.col("file")).alias("trace_id"))
    return J.index_drift(fx.get("ev_traces"), files)
