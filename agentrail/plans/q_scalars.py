"""Scalar column functions: redaction, truncation, formats, ids, prompts,
conversation views, sparklines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import redact as RD
from ..functions import text as TX
from ..operators import costs
from ..sinks import exports as X
from .catalog import register
from .fixtures import AS_OF
from .q_costs import priced_sql

CUSTOM = [r"\b[0-9a-f]{40}\b", "([unclosed"]


def duck_redact(col: str, extra: list[str] = ()) -> str:
    out = col
    for _, p in RD.SECRET_VALUE_PATTERNS:
        pat = p.replace("(?iU)", "(?i)").replace("(?U)", "")
        out = f"regexp_replace({out}, '{pat}', '[redacted]', 'g')"
    for p in extra:
        out = f"regexp_replace({out}, '{p}', '[redacted]', 'g')"
    return out


@register("redact_text", ["secrets_text"], f"""
SELECT src, id, {duck_redact('text')} AS text FROM secrets_text""")
def q_redact_text(fx):
    """Whole documents and turns with the nine credential shapes redacted."""
    s = fx.get("secrets_text")
    return RD.redact_frame(s, "text").select("src", "id", "text")


@register("custom_patterns", ["secrets_text"], f"""
SELECT src, id, {duck_redact('text', [CUSTOM[0]])} AS text FROM secrets_text""")
def q_custom_patterns(fx):
    """Redaction with a user pattern (40 hex digits); an invalid one is skipped."""
    s = fx.get("secrets_text")
    return RD.redact_frame(s, "text", extra=CUSTOM, spark=fx.spark).select("src", "id", "text")


@register("secret_scan", ["secrets_text"], "SELECT src, id, concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(text, '{p.replace('(?iU)', '(?i)').replace('(?U)', '')}') THEN '{n}' END"
    for n, p in RD.SECRET_VALUE_PATTERNS) + ") AS hits FROM secrets_text")
def q_secret_scan(fx):
    """Which credential shapes occur in each text."""
    s = fx.get("secrets_text")
    return s.select("src", "id", RD.secret_scan("text").alias("hits"))


@register("truncate_text", ["documents"], """
SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '…[truncated]' ELSE text END AS text
FROM documents""")
def q_truncate_text(fx):
    """Document text capped at 4000 characters with the truncation mark."""
    d = fx.get("documents")
    return d.select("doc_id", TX.truncate_text("text").alias("text"))


@register("format_usd", ["ev_steps", "ev_traces"], priced_sql("ev_steps") + """
, pt AS (SELECT trace_id, USD(sum(cost_pico)) AS usd FROM priced_x WHERE cost_pico IS NOT NULL GROUP BY trace_id)
SELECT trace_id, usd, CASE WHEN usd = 0 THEN '$0.00' WHEN usd < 0.0001 THEN '<$0.0001'
  WHEN usd < 1 THEN '$' || printf('%.4f', round_even(CAST(usd AS DECIMAL(20,6)), 4))
  ELSE '$' || printf('%,.2f', round_even(CAST(usd AS DECIMAL(20,6)), 2)) END AS usd_text FROM pt""")
def q_format_usd(fx):
    """Per-trace spend rendered for display."""
    p = costs.price_steps(fx.get("ev_steps"))
    t = p.filter(F.col("cost_pico").isNotNull()).groupBy("trace_id").agg(costs.sum_usd().alias("usd"))
    return t.select("trace_id", "usd", TX.format_usd("usd").alias("usd_text"))


@register("duration_ms", ["ev_steps"], """
SELECT step_id, (ended_at - started_at) * 1000.0 AS duration_ms,
  greatest((ended_at - started_at) * 1000.0, 0.0) AS duration_ms_clamped FROM ev_steps""")
def q_duration_ms(fx):
    """Raw and clamped step durations."""
    s = fx.get("ev_steps")
    return s.select("step_id", TX.duration_ms("started_at", "ended_at").alias("duration_ms"),
                    TX.duration_ms("started_at", "ended_at", clamp=True).alias("duration_ms_clamped"))


@register("format_duration", ["ev_steps"], """
SELECT step_id, CASE WHEN d IS NULL OR d < 0 THEN '—' WHEN d < 1 THEN '<1 ms'
  WHEN d < 10 THEN printf('%.1f', d) || ' ms' WHEN d < 1000 THEN printf('%.0f', d) || ' ms'
  ELSE printf('%.2f', d / 1000) || ' s' END AS duration_text
FROM (SELECT step_id, (ended_at - started_at) * 1000.0 AS d FROM ev_steps) s""")
def q_format_duration(fx):
    """Step durations rendered for display."""
    s = fx.get("ev_steps")
    return s.select("step_id", TX.format_duration(TX.duration_ms("started_at", "ended_at")).alias("duration_text"))


@register("human_bytes", ["documents"], """
SELECT doc_id, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B'
  WHEN n_chars < 1048576 THEN printf('%.1f', n_chars / 1024) || ' KB'
  ELSE printf('%.2f', n_chars / 1048576) || ' MB' END AS size_text FROM documents""")
def q_human_bytes(fx):
    """Document sizes rendered for display."""
    d = fx.get("documents")
    return d.select("doc_id", TX.human_bytes("n_chars").alias("size_text"))


@register("relative_time", ["ev_traces"], f"""
SELECT trace_id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's ago' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
  WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS ago
FROM (SELECT trace_id, greatest(0, CAST(trunc({AS_OF} - started_at) AS BIGINT)) AS s FROM ev_traces) t""")
def q_relative_time(fx):
    """How long before as_of each trace started ('3h ago')."""
    t = fx.get("ev_traces")
    return t.select("trace_id", TX.relative_time(F.lit(AS_OF) - F.col("started_at")).alias("ago"))


@register("format_age", ["ev_traces"], f"""
SELECT trace_id, CASE WHEN a >= 86400 THEN printf('%.1f', round_even(CAST(a / 86400 AS DECIMAL(38,12)), 1)) || 'd'
  WHEN a >= 3600 THEN printf('%.1f', round_even(CAST(a / 3600 AS DECIMAL(38,12)), 1)) || 'h'
  WHEN a >= 60 THEN printf('%.1f', round_even(CAST(a / 60 AS DECIMAL(38,12)), 1)) || 'm'
  ELSE printf('%.0f', round_even(CAST(a AS DECIMAL(38,12)), 0)) || 's' END AS age
FROM (SELECT trace_id, round({AS_OF} - started_at, 0) AS a FROM ev_traces) t""")
def q_format_age(fx):
    """Coarse age of each trace at as_of (whole seconds)."""
    t = fx.get("ev_traces")
    return t.select("trace_id", TX.format_age(F.round(F.lit(AS_OF) - F.col("started_at"), 0)).alias("age"))


@register("parse_duration", ["duration_texts"], """
SELECT event_id, CASE WHEN length(t) > 0 AND secs >= 0 THEN secs END AS seconds FROM (
  SELECT event_id, t, TRY_CAST(trim(CASE WHEN right(t, 1) IN ('s', 'm', 'h', 'd') THEN left(t, length(t) - 1) ELSE t END)
    AS DOUBLE) * CASE right(t, 1) WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END AS secs
  FROM (SELECT event_id, lower(trim(text)) AS t FROM duration_texts) a) b""")
def q_parse_duration(fx):
    """Duration texts ('7d', '24h', '30m', '3600s', '90') to seconds; bad -> null."""
    d = fx.get("duration_texts")
    return d.select("event_id", TX.parse_duration_seconds("text").alias("seconds"))


@register("safe_int", ["ev_steps"], r"""
SELECT step_id, CASE WHEN json_type(outputs, '$.status') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(outputs, '$.status') AS BIGINT)
  WHEN json_type(outputs, '$.status') = 'DOUBLE' THEN CAST(trunc(CAST(json_extract_string(outputs, '$.status') AS DOUBLE)) AS BIGINT)
  END AS status,
  CASE WHEN json_type(outputs, '$.rate_limited') = 'BOOLEAN' THEN NULL END AS rate_limited_int
FROM ev_steps""")
def q_safe_int(fx):
    """Integer reading of JSON values (booleans are not integers)."""
    s = fx.get("ev_steps").select("step_id", F.try_parse_json("outputs").alias("v"))
    return s.select("step_id", X.safe_int_v(F.variant_get("v", "$.status", "variant")).alias("status"),
                    X.safe_int_v(F.variant_get("v", "$.rate_limited", "variant")).alias("rate_limited_int"))


def _spans(fx):
    return X.spans(fx.get("ev_steps"))


SPAN_IDS = r"""
, sp AS (SELECT *, regexp_replace(lower(trace_id), '[^0-9a-f]', '', 'g') AS th,
    regexp_replace(lower(step_id), '[^0-9a-f]', '', 'g') AS sh FROM ev_steps)"""


@register("otlp_trace_id", ["ev_steps"], SPAN_IDS + """
SELECT step_id, CASE WHEN length(th) >= 32 THEN substr(th, 1, 32) ELSE lpad(th, 32, '0') END AS trace_id_hex FROM sp""")
def q_otlp_trace_id(fx):
    """OTLP trace id (32 hex) of every step's trace."""
    return _spans(fx).select("step_id", "trace_id_hex")


@register("otlp_span_id", ["ev_steps"], SPAN_IDS + """
SELECT step_id, CASE WHEN length(sh) >= 16 THEN substr(sh, 1, 16) ELSE rpad(sh, 16, '0') END AS span_id_hex FROM sp""")
def q_otlp_span_id(fx):
    """OTLP span id (16 hex) of every step."""
    return _spans(fx).select("step_id", "span_id_hex")


@register("unix_nanos", ["ev_steps"], """
SELECT step_id, coalesce(CAST(CAST(trunc(started_at * 1e9) AS BIGINT) AS VARCHAR), '0') AS start_unix_nano FROM ev_steps""")
def q_unix_nanos(fx):
    """Step start as OTLP nanosecond text."""
    return _spans(fx).select("step_id", "start_unix_nano")


@register("span_kind_status", ["ev_steps"], """
SELECT step_id, CASE WHEN kind IN ('llm-call', 'tool-call') THEN 3 ELSE 1 END AS kind,
  CASE WHEN (error IS NOT NULL AND error <> '') OR
            (json_type(outputs, '$.status') IN ('BIGINT', 'UBIGINT') AND CAST(json_extract_string(outputs, '$.status') AS BIGINT) >= 500)
       THEN 2 ELSE 1 END AS status_code FROM ev_steps""")
def q_span_kind_status(fx):
    """OTLP span kind (CLIENT for llm / tool calls) and status."""
    return _spans(fx).select("step_id", "kind", "status_code")


@register("sparkline", ["ev_traces"], f"""
, spine AS (SELECT CAST(d AS DATE) AS day FROM range(
    CAST(make_timestamp(CAST({AS_OF} * 1000000 AS BIGINT)) AS DATE) - INTERVAL 13 DAY,
    CAST(make_timestamp(CAST({AS_OF} * 1000000 AS BIGINT)) AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY) r(d)),
fw AS (SELECT DISTINCT coalesce(framework, '—') AS framework FROM ev_traces),
cnt AS (SELECT coalesce(framework, '—') AS framework,
          CAST(make_timestamp(CAST(started_at * 1000000 AS BIGINT)) AS DATE) AS day, count(*) AS n
        FROM ev_traces GROUP BY 1, 2),
series AS (SELECT fw.framework, list(CAST(coalesce(cnt.n, 0) AS DOUBLE) ORDER BY spine.day) AS v
           FROM fw CROSS JOIN spine LEFT JOIN cnt ON cnt.framework = fw.framework AND cnt.day = spine.day
           GROUP BY fw.framework)
SELECT framework, CASE WHEN list_max(v) = 0 THEN '' ELSE array_to_string(list_transform(v,
    lambda y: substr(' ▁▂▃▄▅▆▇█', CAST(least(8, round_even(y / list_max(v) * 8, 0)) AS INT) + 1, 1)), '') END AS spark
FROM series""")
def q_sparkline(fx):
    """14-day trace-count sparkline per framework ending at as_of."""
    t = fx.get("ev_traces").withColumn("framework", F.coalesce("framework", F.lit("—")))
    end = F.to_date(F.timestamp_micros(F.lit(int(AS_OF * 1_000_000))))
    counts = (t.groupBy("framework", costs.day_of(F.col("started_at")).alias("day"))
              .agg(F.count(F.lit(1)).alias("n")))
    grid = t.select("framework").distinct().select(
        "framework", F.explode(F.sequence(F.date_sub(end, 13), end)).alias("day"))
    cells = (grid.join(counts, ["framework", "day"], "left").groupBy("framework")
             .agg(F.array_sort(F.collect_list(F.struct("day", F.coalesce("n", F.lit(0)).cast("double").alias("v"))))
                  .alias("_c")))
    return cells.select("framework", TX.sparkline(F.transform("_c", lambda x: x["v"])).alias("spark"))
