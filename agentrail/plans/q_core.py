"""Relational core: list, search, stats, joins, windows, sets, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import relational as R
from ..operators import sets as S
from ..operators import stats as ST
from ..operators import windows as W
from .catalog import register
from .fixtures import AS_OF

FAILED = "coalesce(json_extract_string(metadata, '$.failed') = 'true', false)"
STEP_COUNTS = "sc AS (SELECT trace_id, count(*) AS n FROM ev_steps GROUP BY trace_id)"
ANN_COUNTS = ("ac AS (SELECT trace_id, count(*) AS n FROM "
              "(SELECT DISTINCT trace_id, step_id FROM ev_annotations) d GROUP BY trace_id)")


def _latest(fx):
    return W.latest_annotations(fx.get("ev_annotations"))


# ---------------------------------------------------------------- listing --
@register("list_traces", ["ev_traces", "ev_steps", "ev_annotations"], f"""
, {STEP_COUNTS}, {ANN_COUNTS}
SELECT t.trace_id, t.name, t.framework, t.started_at,
  round((t.ended_at - t.started_at) * 1000, 3) AS duration_ms, {FAILED} AS failed,
  CAST(coalesce(sc.n, 0) AS BIGINT) AS step_count, CAST(coalesce(ac.n, 0) AS BIGINT) AS annotation_count
FROM ev_traces t LEFT JOIN sc ON t.trace_id = sc.trace_id LEFT JOIN ac ON t.trace_id = ac.trace_id
ORDER BY t.started_at DESC NULLS LAST, t.trace_id LIMIT 100""")
def q_list_traces(fx):
    """The 100 newest traces with duration, step and annotation counts."""
    return R.list_traces(fx.get("ev_traces"), fx.get("ev_steps"), _latest(fx), limit=100)


@register("latest_n", ["ev_traces"], """
SELECT trace_id, started_at FROM ev_traces ORDER BY started_at DESC NULLS LAST, trace_id LIMIT 50""")
def q_latest_n(fx):
    """The 50 newest traces."""
    return R.latest_n(fx.get("ev_traces"), 50).select("trace_id", "started_at")


@register("newest_first_rank", ["ev_traces"], """
SELECT trace_id, CAST(row_number() OVER (ORDER BY started_at DESC NULLS LAST, trace_id) AS BIGINT) AS rank
FROM ev_traces""")
def q_newest_first_rank(fx):
    """Rank of every trace by start time, newest first (distributed global rank)."""
    return R.rank_newest(fx.get("ev_traces")).select("trace_id", "rank")


def _search_sql(q: str) -> str:
    return f"""
, {STEP_COUNTS}, {ANN_COUNTS},
base AS (
  SELECT t.trace_id, t.name, t.framework, t.started_at,
    CAST(coalesce(sc.n, 0) AS BIGINT) AS step_count, CAST(coalesce(ac.n, 0) AS BIGINT) AS annotation_count
  FROM ev_traces t LEFT JOIN sc ON t.trace_id = sc.trace_id LEFT JOIN ac ON t.trace_id = ac.trace_id),
h AS (
  SELECT *, strpos(lower(coalesce(name, '') || ' ' || coalesce(framework, '') || ' ' || trace_id), '{q}') > 0
    AS match_header FROM base),
sh AS (
  SELECT DISTINCT s.trace_id FROM ev_steps s JOIN h ON s.trace_id = h.trace_id AND NOT h.match_header
  WHERE strpos(lower(coalesce(s.kind, '') || ' ' || coalesce(s.name, '') || ' ' || coalesce(s.error, '')), '{q}') > 0)
SELECT h.*, sh.trace_id IS NOT NULL AS match_steps FROM h LEFT JOIN sh ON h.trace_id = sh.trace_id
WHERE h.match_header OR sh.trace_id IS NOT NULL"""


@register("search_traces", ["ev_traces", "ev_steps", "ev_annotations"], _search_sql("http 429"))
def q_search_traces(fx):
    """Traces whose header or steps contain 'HTTP 429' (case-insensitive)."""
    return R.search_traces(fx.get("ev_traces"), fx.get("ev_steps"), _latest(fx), "  HTTP 429 ")


@register("search_traces_header", ["ev_traces", "ev_steps", "ev_annotations"], _search_sql("agent-4 "))
def q_search_traces_header(fx):
    """Search hitting trace headers ('agent-4 ' in name + framework)."""
    return R.search_traces(fx.get("ev_traces"), fx.get("ev_steps"), _latest(fx), "AGENT-4 ")


@register("filter_status", ["ev_traces", "ev_steps", "ev_annotations"], f"""
, {STEP_COUNTS}, {ANN_COUNTS}
SELECT t.trace_id, t.name, t.framework, t.started_at,
  round((t.ended_at - t.started_at) * 1000, 3) AS duration_ms, {FAILED} AS failed,
  CAST(coalesce(sc.n, 0) AS BIGINT) AS step_count, CAST(coalesce(ac.n, 0) AS BIGINT) AS annotation_count
FROM ev_traces t LEFT JOIN sc ON t.trace_id = sc.trace_id LEFT JOIN ac ON t.trace_id = ac.trace_id
WHERE {FAILED} AND strpos(lower(t.trace_id || ' ' || coalesce(t.name, '')), 'agent-1') > 0""")
def q_filter_status(fx):
    """Failed traces whose id or name contains 'agent-1'."""
    listed = R.list_traces(fx.get("ev_traces"), fx.get("ev_steps"), _latest(fx), limit=None)
    return R.filter_status(listed, "failed", "Agent-1")


@register("resolve_prefix", ["ev_traces", "ev_prefixes"], """
, m AS (
  SELECT p.prefix, min(t.trace_id) AS trace_id, count(*) AS matches
  FROM ev_prefixes p JOIN ev_traces t ON starts_with(t.trace_id, p.prefix)
  WHERE length(p.prefix) BETWEEN 1 AND 128 AND NOT regexp_matches(p.prefix, '[/\\\\*?\\[\\]\\x00-\\x1f]')
    AND NOT starts_with(p.prefix, '.')
  GROUP BY p.prefix)
SELECT p.prefix,
  (length(p.prefix) BETWEEN 1 AND 128 AND NOT regexp_matches(p.prefix, '[/\\\\*?\\[\\]\\x00-\\x1f]')
   AND NOT starts_with(p.prefix, '.')) AS valid,
  m.trace_id, CAST(coalesce(m.matches, 0) AS BIGINT) AS matches, coalesce(m.matches, 0) > 1 AS ambiguous
FROM ev_prefixes p LEFT JOIN m ON p.prefix = m.prefix""")
def q_resolve_prefix(fx):
    """Id prefixes resolved to traces (first match, match count, validity)."""
    return R.resolve_prefixes(fx.get("ev_traces"), fx.get("ev_prefixes"))


@register("bulk_delete_split", ["ev_traces", "ev_requests"], """
, r AS (SELECT q.*, trim(coalesce(q.id, '')) AS tid FROM ev_requests q),
m AS (
  SELECT r.batch_id, r.req_pos, min(t.trace_id) AS trace_id FROM r JOIN ev_traces t
    ON starts_with(t.trace_id, r.tid)
  WHERE length(r.tid) BETWEEN 1 AND 128 AND NOT regexp_matches(r.tid, '[/\\\\*?\\[\\]\\x00-\\x1f]')
    AND NOT starts_with(r.tid, '.')
  GROUP BY r.batch_id, r.req_pos),
j AS (SELECT r.*, m.trace_id,
        min(r.req_pos) OVER (PARTITION BY r.batch_id, m.trace_id) AS first_pos
      FROM r LEFT JOIN m ON r.batch_id = m.batch_id AND r.req_pos = m.req_pos)
SELECT batch_id, req_pos, id,
  CASE WHEN trace_id IS NOT NULL AND req_pos = first_pos THEN 'deleted' ELSE 'not_found' END AS outcome,
  CASE WHEN trace_id IS NOT NULL AND req_pos = first_pos THEN trace_id END AS trace_id
FROM j""")
def q_bulk_delete_split(fx):
    """Delete requests split into deleted and not_found."""
    return J.bulk_delete_split(fx.get("ev_traces"), fx.get("ev_requests"))


@register("filter_steps", ["ev_steps"], """
SELECT trace_id, step_id, step_index, name, error FROM ev_steps
WHERE kind = 'llm-call' AND error IS NOT NULL AND error <> ''""")
def q_filter_steps(fx):
    """Failing llm-call steps."""
    return (R.filter_steps(fx.get("ev_steps"), kind="llm-call", only_failing=True)
            .select("trace_id", "step_id", F.col("step_index").cast("bigint").alias("step_index"),
                    "name", "error"))


@register("trace_cards", ["ev_traces"], f"""
SELECT started_at, trace_id, coalesce(nullif(json_extract_string(metadata, '$.provider'), ''), '—') AS provider,
  coalesce(nullif(json_extract_string(metadata, '$.model'), ''), '—') AS model, {FAILED} AS failed
FROM ev_traces""")
def q_trace_cards(fx):
    """Live-view cards: start, id, provider, model, failed."""
    return R.trace_cards(fx.get("ev_traces"))


@register("purge_candidates", ["ev_traces", "ev_annotations"], f"""
SELECT t.trace_id, round({AS_OF} - coalesce(t.ended_at, t.started_at), 3) AS age_s
FROM ev_traces t
WHERE {AS_OF} - coalesce(t.ended_at, t.started_at) >= 7 * 86400
  AND NOT EXISTS (SELECT 1 FROM ev_annotations a WHERE a.trace_id = t.trace_id)""")
def q_purge_candidates(fx):
    """Traces older than 7 days at as_of, annotated ones kept."""
    return R.purge_candidates(fx.get("ev_traces"), fx.get("ev_annotations"), 7 * 86400, AS_OF,
                              keep_tagged=True)


# ------------------------------------------------------------ aggregates --
@register("trace_stats", ["ev_traces", "ev_steps", "ev_annotations"], f"""
, {STEP_COUNTS}
SELECT CAST(count(*) AS BIGINT) AS trace_count,
  CAST(sum(CASE WHEN {FAILED} THEN 1 ELSE 0 END) AS BIGINT) AS failed_count,
  CAST(coalesce(sum(sc.n), 0) AS BIGINT) AS step_count,
  (SELECT count(*) FROM ev_annotations) AS annotation_count,
  round(quantile_cont((t.ended_at - t.started_at) * 1000, 0.5), 3) AS median_duration_ms
FROM ev_traces t LEFT JOIN sc ON t.trace_id = sc.trace_id""")
def q_trace_stats(fx):
    """Counts and the exact median closed-trace duration."""
    out = ST.trace_stats(fx.get("ev_traces"), fx.get("ev_steps"), fx.get("ev_annotations"))
    return out.withColumn("median_duration_ms", F.round("median_duration_ms", 3))


@register("traces_by_framework", ["ev_traces"], """
SELECT coalesce(framework, '—') AS framework, count(*) AS traces FROM ev_traces GROUP BY 1""")
def q_traces_by_framework(fx):
    """Trace count per framework ('—' when missing)."""
    return ST.traces_by_framework(fx.get("ev_traces"))


@register("top_frameworks", ["ev_traces"], """
SELECT coalesce(framework, '—') AS framework, count(*) AS traces FROM ev_traces GROUP BY 1
ORDER BY traces DESC, framework""")
def q_top_frameworks(fx):
    """Frameworks by trace count, most used first."""
    return ST.top_frameworks(fx.get("ev_traces"))


@register("failure_categories", ["ev_annotations"], """
SELECT failure_category, count(*) AS annotations FROM (
  SELECT DISTINCT trace_id, step_id, failure_category FROM ev_annotations) a GROUP BY 1""")
def q_failure_categories(fx):
    """Annotations per failure category (latest write per step)."""
    return ST.failure_categories(_latest(fx))


@register("annotation_coverage", ["ev_annotations"], """
SELECT count(*) AS annotations, count(DISTINCT trace_id) AS annotated_traces FROM (
  SELECT DISTINCT trace_id, step_id FROM ev_annotations) a""")
def q_annotation_coverage(fx):
    """Annotated steps and distinct annotated traces (latest write per step)."""
    return ST.annotation_coverage(_latest(fx))


@register("trace_rollup", ["ev_steps"], """
SELECT trace_id, count(*) AS steps, count(error) AS failing_steps,
  round(coalesce(sum(ended_at - started_at), 0), 6) AS step_seconds,
  count(CASE WHEN kind = 'llm-call' THEN 1 END) AS llm_calls,
  CAST(coalesce(sum(CAST(trunc(TRY_CAST(coalesce(json_extract_string(outputs, '$.input_tokens'),
       json_extract_string(outputs, '$.input'), json_extract_string(inputs, '$.input_tokens')) AS DOUBLE)) AS BIGINT)), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(CAST(trunc(TRY_CAST(coalesce(json_extract_string(outputs, '$.output_tokens'),
       json_extract_string(outputs, '$.output'), json_extract_string(inputs, '$.output_tokens')) AS DOUBLE)) AS BIGINT)), 0) AS BIGINT) AS output_tokens
FROM ev_steps GROUP BY trace_id""")
def q_trace_rollup(fx):
    """Per trace: steps, failing steps, step time, llm calls, tokens."""
    return ST.trace_rollup(fx.get("ev_steps"))


@register("latency_percentiles", ["ev_steps"], """
SELECT kind, count(*) AS steps,
  round(quantile_cont((ended_at - started_at) * 1000, 0.5), 3) AS p50_ms,
  round(quantile_cont((ended_at - started_at) * 1000, 0.95), 3) AS p95_ms
FROM ev_steps WHERE ended_at IS NOT NULL GROUP BY kind""")
def q_latency_percentiles(fx):
    """Exact p50 / p95 step duration per kind."""
    out = ST.latency_percentiles(fx.get("ev_steps"))
    return out.select("kind", "steps", F.round("p50_ms", 3).alias("p50_ms"),
                      F.round("p95_ms", 3).alias("p95_ms"))


@register("rolling_failure_rate", ["ev_traces"], f"""
, d AS (
  SELECT CAST(make_timestamp(CAST(started_at * 1000000 AS BIGINT)) AS DATE) AS day, count(*) AS n,
    sum(CASE WHEN {FAILED} THEN 1 ELSE 0 END) AS f
  FROM ev_traces WHERE started_at IS NOT NULL GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day,
  CAST(sum(n) OVER w AS BIGINT) AS traces_window, CAST(sum(f) OVER w AS BIGINT) AS failed_window,
  round(sum(f) OVER w / sum(n) OVER w, 6) AS failure_rate
FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def q_rolling_failure_rate(fx):
    """Trailing 7-day failure rate per day."""
    return ST.rolling_failure_rate(fx.get("ev_traces"), days=7)


@register("daily_series", ["ev_traces"], f"""
, spine AS (
  SELECT CAST(d AS DATE) AS day, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS idx FROM range(
    CAST(make_timestamp(CAST({AS_OF} * 1000000 AS BIGINT)) AS DATE) - INTERVAL 13 DAY,
    CAST(make_timestamp(CAST({AS_OF} * 1000000 AS BIGINT)) AS DATE) + INTERVAL 1 DAY,
    INTERVAL 1 DAY) r(d)),
v AS (SELECT CAST(make_timestamp(CAST(started_at * 1000000 AS BIGINT)) AS DATE) AS day,
        sum(ended_at - started_at) AS s FROM ev_traces WHERE started_at IS NOT NULL GROUP BY 1)
SELECT CAST(spine.day AS VARCHAR) AS day, spine.idx, round(coalesce(v.s, 0), 6) AS value
FROM spine LEFT JOIN v ON spine.day = v.day""")
def q_daily_series(fx):
    """14 zero-filled day cells of summed trace durations ending at as_of."""
    return ST.daily_series(fx.get("ev_traces").withColumn("_dur", F.col("ended_at") - F.col("started_at")),
                           "started_at", "_dur", 14, AS_OF)


@register("table_info", ["ev_traces", "ev_steps", "ev_annotations"], """
SELECT 'traces' AS "table", count(*) AS rows FROM ev_traces
UNION ALL SELECT 'steps', count(*) FROM ev_steps
UNION ALL SELECT 'annotations', count(*) FROM ev_annotations""")
def q_table_info(fx):
    """Row counts of the derived trace, step and annotation tables."""
    return ST.table_info(traces=fx.get("ev_traces"), steps=fx.get("ev_steps"),
                         annotations=fx.get("ev_annotations"))


# ----------------------------------------------------------------- joins --
@register("join_annotation_counts", ["ev_traces", "ev_annotations"], """
SELECT t.trace_id, CAST(count(a.trace_id) AS BIGINT) AS annotation_count
FROM ev_traces t LEFT JOIN ev_annotations a ON t.trace_id = a.trace_id GROUP BY t.trace_id""")
def q_join_annotation_counts(fx):
    """Annotation writes per trace, 0 when none."""
    return J.join_annotation_counts(fx.get("ev_traces"), fx.get("ev_annotations")).select(
        "trace_id", "annotation_count")


@register("join_annotated_steps", ["ev_steps", "ev_annotations"], """
, la AS (SELECT trace_id, step_id, arg_max(failure_category, seq) AS failure_category,
           arg_max(severity, seq) AS severity FROM ev_annotations GROUP BY trace_id, step_id)
SELECT la.trace_id, la.step_id, la.failure_category, la.severity, s.kind, s.name,
  CAST(s.step_index AS BIGINT) AS step_index
FROM la JOIN ev_steps s ON la.trace_id = s.trace_id AND la.step_id = s.step_id""")
def q_join_annotated_steps(fx):
    """Latest annotation joined to its step; orphans dropped."""
    j = J.join_annotated_steps(fx.get("ev_steps"), _latest(fx))
    return j.select("trace_id", "step_id", "failure_category", "severity", "kind", "name",
                    F.col("step_index").cast("bigint").alias("step_index"))


@register("anti_keep_tagged", ["ev_traces", "ev_annotations"], """
SELECT trace_id FROM ev_traces t WHERE NOT EXISTS (
  SELECT 1 FROM ev_annotations a WHERE a.trace_id = t.trace_id)""")
def q_anti_keep_tagged(fx):
    """Traces without any annotation (left anti join)."""
    return J.anti_keep_tagged(fx.get("ev_traces"), fx.get("ev_annotations")).select("trace_id")


@register("anti_orphan_annotations", ["ev_traces", "ev_annotations"], """
SELECT trace_id, step_id, seq FROM ev_annotations a WHERE NOT EXISTS (
  SELECT 1 FROM ev_traces t WHERE a.trace_id = t.trace_id)""")
def q_anti_orphan_annotations(fx):
    """Annotations whose trace no longer exists (left anti join)."""
    return J.anti_orphan_annotations(fx.get("ev_annotations"), fx.get("ev_traces")).select(
        "trace_id", "step_id", "seq")


@register("link_parents", ["ev_steps"], """
SELECT s.trace_id, s.step_id, s.parent_step_id, p.kind AS parent_kind, p.name AS parent_name,
  (s.parent_step_id IS NOT NULL AND p.kind IS NULL) AS dangling
FROM ev_steps s LEFT JOIN ev_steps p ON s.trace_id = p.trace_id AND s.parent_step_id = p.step_id""")
def q_link_parents(fx):
    """Every step with its parent's kind and name."""
    return J.link_parents(fx.get("ev_steps"))


@register("pair_run_events", ["run_starts", "run_ends"], """
SELECT s.run_id, s.trace_id, s.kind, s.name, s.started_at, e.ended_at, e.error
FROM run_starts s LEFT JOIN (
  SELECT run_id, min(ended_at) AS ended_at, arg_min(error, ended_at) AS error FROM run_ends GROUP BY run_id) e
ON s.run_id = e.run_id""")
def q_pair_run_events(fx):
    """Start and end events paired into steps; unmatched starts stay open."""
    return J.pair_run_events(fx.get("run_starts"), fx.get("run_ends")).drop("outputs")


@register("positional_diff", ["ev_steps", "ev_groups"], """
, n AS (SELECT group_id, count(*) AS n FROM ev_groups GROUP BY group_id),
s AS (SELECT g.group_id, s.step_index, s.kind || ':' || s.name AS sig
      FROM ev_steps s JOIN ev_groups g ON s.trace_id = g.trace_id),
a AS (SELECT group_id, step_index, count(*) AS present, count(DISTINCT sig) AS sigs, min(sig) AS sig
      FROM s GROUP BY group_id, step_index)
SELECT a.group_id, CAST(a.step_index AS BIGINT) AS step_index, a.present,
  (a.present = n.n AND a.sigs = 1) AS aligned, CASE WHEN a.present = n.n AND a.sigs = 1 THEN a.sig END AS sig
FROM a JOIN n ON a.group_id = n.group_id""")
def q_positional_diff(fx):
    """Step-by-step alignment of the traces in each comparison group."""
    return J.positional_diff(fx.get("ev_steps"), fx.get("ev_groups"))


@register("header_diff", ["ev_traces", "ev_steps", "ev_pairs"], f"""
, {STEP_COUNTS},
h AS (SELECT t.trace_id, t.name, t.framework, coalesce(sc.n, 0) AS steps,
        round((t.ended_at - t.started_at) * 1000, 3) AS duration_ms, {FAILED} AS failed
      FROM ev_traces t LEFT JOIN sc ON t.trace_id = sc.trace_id)
SELECT p.left_id, p.right_id, l.name AS left_name, r.name AS right_name,
  l.framework AS left_framework, r.framework AS right_framework,
  CAST(l.steps AS BIGINT) AS left_steps, CAST(r.steps AS BIGINT) AS right_steps,
  l.duration_ms AS left_duration_ms, r.duration_ms AS right_duration_ms,
  round(r.duration_ms - l.duration_ms, 3) AS delta_ms, l.failed AS left_failed, r.failed AS right_failed
FROM ev_pairs p JOIN h l ON p.left_id = l.trace_id JOIN h r ON p.right_id = r.trace_id""")
def q_header_diff(fx):
    """Header comparison of consecutive traces of the same user."""
    return J.header_diff(fx.get("ev_traces"), fx.get("ev_steps"), fx.get("ev_pairs"))


# --------------------------------------------------------------- windows --
@register("step_index", ["ev_steps"], """
SELECT trace_id, step_id,
  CAST(row_number() OVER (PARTITION BY trace_id ORDER BY started_at, step_id) - 1 AS BIGINT) AS step_index
FROM ev_steps""")
def q_step_index(fx):
    """0-based step position within its trace by start time."""
    s = fx.get("ev_steps").drop("step_index").withColumn("_pos", F.struct("started_at", "step_id"))
    return W.with_step_index(s, "_pos").select(
        "trace_id", "step_id", F.col("step_index").cast("bigint").alias("step_index"))


@register("first_failing_step", ["ev_steps"], """
SELECT trace_id,
  CAST(coalesce(min(CASE WHEN error IS NOT NULL AND error <> '' THEN step_index END), 0) AS BIGINT)
    AS first_failing_index,
  count(CASE WHEN error IS NOT NULL AND error <> '' THEN 1 END) AS failing_steps
FROM ev_steps GROUP BY trace_id""")
def q_first_failing_step(fx):
    """Per trace: index of the first failing step (0 when none) and failing steps."""
    return W.first_failing(fx.get("ev_steps"))


@register("latest_annotation", ["ev_annotations"], """
SELECT trace_id, step_id, arg_max(severity, seq) AS severity, arg_max(notes, seq) AS notes,
  max(seq) AS seq FROM ev_annotations GROUP BY trace_id, step_id""")
def q_latest_annotation(fx):
    """Last write per (trace, step) wins."""
    return _latest(fx).select("trace_id", "step_id", "severity", "notes", "seq")


@register("upsert_annotation", ["ev_annotations"], """
SELECT trace_id, step_id, arg_max(failure_category, seq) AS failure_category,
  arg_max(severity, seq) AS severity, arg_max(notes, seq) AS notes, arg_max(annotator, seq) AS annotator
FROM ev_annotations GROUP BY trace_id, step_id""")
def q_upsert_annotation(fx):
    """Annotation table after applying every write in order (keyed upsert)."""
    return _latest(fx).select("trace_id", "step_id", "failure_category", "severity", "notes", "annotator")


# ------------------------------------------------------------------ sets --
@register("new_ids", ["ev_traces", "ev_annotations"], """
SELECT trace_id FROM ev_traces EXCEPT SELECT trace_id FROM ev_annotations""")
def q_new_ids(fx):
    """Trace ids not yet seen in the annotation feed."""
    return S.new_ids(fx.get("ev_traces"), fx.get("ev_annotations"))


@register("live_ids", ["ev_traces", "ev_annotations"], """
SELECT trace_id FROM ev_annotations INTERSECT SELECT trace_id FROM ev_traces""")
def q_live_ids(fx):
    """Annotated trace ids that still exist."""
    return S.live_ids(fx.get("ev_annotations"), fx.get("ev_traces"))


@register("union_sources", ["ev_traces", "cv_traces"], """
SELECT trace_id, name, framework, started_at, ended_at, 'events' AS source FROM ev_traces
UNION ALL
SELECT trace_id, name, framework, started_at, ended_at, 'conversations' FROM cv_traces""")
def q_union_sources(fx):
    """Traces of two producers in one table (columns matched by name)."""
    ev = fx.get("ev_traces").select("trace_id", "name", "framework", "started_at", "ended_at")
    cv = fx.get("cv_traces").select("trace_id", "started_at", "name", "ended_at", "framework")
    return S.union_sources(ev, cv, source_names=["events", "conversations"])
