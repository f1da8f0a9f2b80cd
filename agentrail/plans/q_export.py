"""Exports: flat steps, OTLP spans, corpus, leaderboard, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..session import scratch_path
from ..sinks import exports as X
from ..dims import CORPUS_CATEGORIES
from .catalog import register
from .fixtures import AS_OF

FAILED = "coalesce(json_extract_string(t.metadata, '$.failed') = 'true', false)"


def _safe_int_sql(j: str, path: str) -> str:
    t = f"json_type({j}, '{path}')"
    x = f"json_extract_string({j}, '{path}')"
    return (f"(CASE WHEN {t} IN ('BIGINT', 'UBIGINT') THEN CAST({x} AS BIGINT) "
            f"WHEN {t} = 'DOUBLE' THEN CAST(trunc(CAST({x} AS DOUBLE)) AS BIGINT) "
            rf"WHEN {t} = 'VARCHAR' AND regexp_matches({x}, '^\s*[+-]?[0-9]+\s*$') THEN CAST(trim({x}) AS BIGINT) END)")


def _truthy_sql(j: str, path: str) -> str:
    t = f"json_type({j}, '{path}')"
    x = f"json_extract_string({j}, '{path}')"
    return (f"(CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN false WHEN {t} = 'BOOLEAN' THEN {x} = 'true' "
            f"WHEN {t} = 'VARCHAR' THEN length({x}) > 0 WHEN {t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') "
            f"THEN CAST({x} AS DOUBLE) <> 0 ELSE {x} NOT IN ('[]', '{{}}') END)")


FLAT_SQL = f"""
SELECT s.trace_id, t.name AS trace_name, t.framework AS trace_framework, {FAILED} AS trace_failed,
  t.started_at AS trace_started_at, t.ended_at AS trace_ended_at, s.step_id,
  CAST(s.step_index AS INTEGER) AS step_index, s.kind AS step_kind, s.name AS step_name,
  s.started_at AS step_started_at, s.ended_at AS step_ended_at,
  (s.ended_at - s.started_at) * 1000.0 AS duration_ms,
  json_extract_string(s.inputs, '$.provider') AS provider, json_extract_string(s.inputs, '$.model') AS model,
  {_safe_int_sql('s.outputs', '$.input_tokens')} AS input_tokens,
  {_safe_int_sql('s.outputs', '$.output_tokens')} AS output_tokens,
  CASE WHEN {_truthy_sql('s.outputs', '$.finish_reason')} THEN json_extract_string(s.outputs, '$.finish_reason')
       ELSE json_extract_string(s.outputs, '$.stop_reason') END AS finish_reason,
  {_safe_int_sql('s.outputs', '$.status')} AS http_status,
  {_truthy_sql('s.outputs', '$.rate_limited')} AS rate_limited, s.error,
  s.inputs AS inputs_json, s.outputs AS outputs_json
FROM ev_steps s JOIN ev_traces t ON s.trace_id = t.trace_id"""


@register("export_flat_steps", ["ev_traces", "ev_steps"], FLAT_SQL)
def q_export_flat_steps(fx):
    """The 23-column flat step rows of the analytics export."""
    return X.flat_steps(fx.get("ev_traces"), fx.get("ev_steps"))


@register("read_flat_steps", ["ev_traces", "ev_steps"], FLAT_SQL)
def q_read_flat_steps(fx):
    """All flat steps written as ZSTD Parquet to the shared checkpoint
    folder and read back with the fixed schema."""
    path = scratch_path(fx.spark, "flat-steps")
    X.save_flat_steps(X.flat_steps(fx.get("ev_traces"), fx.get("ev_steps")), path)
    return X.read_flat_steps(fx.spark, path)


@register("export_flat_steps_prefix", ["ev_traces", "ev_steps"], FLAT_SQL + " WHERE starts_with(s.trace_id, 'u00001')")
def q_export_flat_steps_prefix(fx):
    """The export's id-prefix option (the feature under test): only traces
    whose id starts with 'u00001'; the filter is pushed to the scan."""
    return X.flat_steps(fx.get("ev_traces"), fx.get("ev_steps"), prefix="u00001")


def _attr_sql(key: str, kind: str, val: str) -> str:
    if kind == "string":
        body = f"'{{\"stringValue\":' || to_json({val}) || '}}'"
    elif kind == "int":
        body = f"'{{\"intValue\":\"' || CAST({val} AS VARCHAR) || '\"}}'"
    else:
        body = "'{\"boolValue\":true}'"
    return f"'{{\"key\":\"{key}\",\"value\":' || {body} || '}}'"


def _int_sql(j: str, path: str) -> str:
    return f"CASE WHEN json_type({j}, '{path}') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string({j}, '{path}') AS BIGINT) END"


def _str_sql(j: str, path: str) -> str:
    return f"CASE WHEN json_type({j}, '{path}') = 'VARCHAR' THEN json_extract_string({j}, '{path}') END"


SPAN_FRAGS = [
    _attr_sql("agentrail.kind", "string", "k"),
    f"CASE WHEN k = 'llm-call' AND prov IS NOT NULL THEN {_attr_sql('gen_ai.system', 'string', 'prov')} END",
    f"CASE WHEN k = 'llm-call' AND prov IS NOT NULL THEN {_attr_sql('gen_ai.operation.name', 'string', chr(39) + 'chat' + chr(39))} END",
    f"CASE WHEN k = 'llm-call' AND model IS NOT NULL THEN {_attr_sql('gen_ai.request.model', 'string', 'model')} END",
    f"CASE WHEN k = 'llm-call' AND model IS NOT NULL THEN {_attr_sql('gen_ai.response.model', 'string', 'model')} END",
    f"CASE WHEN k = 'llm-call' AND maxt IS NOT NULL THEN {_attr_sql('gen_ai.request.max_tokens', 'int', 'maxt')} END",
    f"CASE WHEN k = 'llm-call' AND {_truthy_sql('inputs', '$.stream')} THEN {_attr_sql('gen_ai.request.streaming', 'bool', '')} END",
    f"CASE WHEN k = 'llm-call' AND itok IS NOT NULL THEN {_attr_sql('gen_ai.usage.input_tokens', 'int', 'itok')} END",
    f"CASE WHEN k = 'llm-call' AND otok IS NOT NULL THEN {_attr_sql('gen_ai.usage.output_tokens', 'int', 'otok')} END",
    f"CASE WHEN k = 'llm-call' AND fin IS NOT NULL THEN {_attr_sql('gen_ai.response.finish_reason', 'string', 'fin')} END",
    f"CASE WHEN k = 'llm-call' AND {_truthy_sql('outputs', '$.rate_limited')} THEN {_attr_sql('gen_ai.response.rate_limited', 'bool', '')} END",
    f"CASE WHEN tr IS NOT NULL THEN {_attr_sql('agentrail.transport', 'string', 'tr')} END",
    f"CASE WHEN meth IS NOT NULL THEN {_attr_sql('http.request.method', 'string', 'meth')} END",
    f"CASE WHEN upath IS NOT NULL THEN {_attr_sql('url.path', 'string', 'upath')} END",
    f"CASE WHEN st IS NOT NULL THEN {_attr_sql('http.response.status_code', 'int', 'st')} END",
    f"CASE WHEN k = 'tool-call' AND name IS NOT NULL THEN {_attr_sql('agentrail.tool.name', 'string', 'name')} END",
]


SPANS_SQL = f"""
, sp AS (SELECT *, coalesce(nullif(kind, ''), 'custom') AS k,
    {_str_sql('inputs', '$.provider')} AS prov, {_str_sql('inputs', '$.model')} AS model,
    {_int_sql('inputs', '$.max_tokens')} AS maxt, {_int_sql('outputs', '$.input_tokens')} AS itok,
    {_int_sql('outputs', '$.output_tokens')} AS otok,
    coalesce({_str_sql('outputs', '$.finish_reason')}, {_str_sql('outputs', '$.stop_reason')}) AS fin,
    {_str_sql('metadata', '$.transport')} AS tr, {_str_sql('metadata', '$.method')} AS meth,
    {_str_sql('metadata', '$.path')} AS upath, {_int_sql('outputs', '$.status')} AS st,
    regexp_replace(lower(trace_id), '[^0-9a-f]', '', 'g') AS th,
    regexp_replace(lower(step_id), '[^0-9a-f]', '', 'g') AS sh,
    regexp_replace(lower(parent_step_id), '[^0-9a-f]', '', 'g') AS ph
  FROM ev_steps)
SELECT trace_id, step_id, step_index,
  CASE WHEN length(th) >= 32 THEN substr(th, 1, 32) ELSE lpad(th, 32, '0') END AS trace_id_hex,
  CASE WHEN length(sh) >= 16 THEN substr(sh, 1, 16) ELSE rpad(sh, 16, '0') END AS span_id_hex,
  CASE WHEN parent_step_id IS NOT NULL AND parent_step_id <> '' THEN
    CASE WHEN length(ph) >= 16 THEN substr(ph, 1, 16) ELSE rpad(ph, 16, '0') END END AS parent_span_id_hex,
  coalesce(nullif(name, ''), k) AS name,
  CASE WHEN k IN ('llm-call', 'tool-call') THEN 3 ELSE 1 END AS kind,
  coalesce(CAST(CAST(trunc(started_at * 1e9) AS BIGINT) AS VARCHAR), '0') AS start_unix_nano,
  coalesce(CAST(CAST(trunc(coalesce(CASE WHEN ended_at <> 0 THEN ended_at END, started_at) * 1e9) AS BIGINT) AS VARCHAR), '0')
    AS end_unix_nano,
  '[' || concat_ws(',', {', '.join(SPAN_FRAGS)}) || ']' AS attributes_json,
  CASE WHEN (error IS NOT NULL AND error <> '') OR st >= 500 THEN 2 ELSE 1 END AS status_code,
  CASE WHEN error IS NOT NULL AND error <> '' THEN error
       WHEN st >= 500 THEN 'upstream returned ' || CAST(st AS VARCHAR) END AS status_message
FROM sp"""


@register("export_spans", ["ev_steps"], SPANS_SQL)
def q_export_spans(fx):
    """Every step as an OTLP span (ids, nanos, kind, status, GenAI attributes)."""
    return X.spans(fx.get("ev_steps")).withColumn("step_index", F.col("step_index").cast("int"))


_SPANS_CTE, _, _SPANS_BODY = SPANS_SQL.partition("\nSELECT trace_id, step_id, step_index,")


@register("export_resource_spans", ["ev_traces", "ev_steps"], _SPANS_CTE + f"""
, one AS (SELECT trace_id, step_id, step_index,{_SPANS_BODY}),
per AS (SELECT trace_id, count(*) AS n, string_agg('{{"traceId":"' || trace_id_hex || '","spanId":"' || span_id_hex ||
    coalesce('","parentSpanId":"' || parent_span_id_hex, '') || '","name":' || to_json(name) || ',"kind":' || kind ||
    ',"startTimeUnixNano":"' || start_unix_nano || '","endTimeUnixNano":"' || end_unix_nano || '","attributes":' || attributes_json ||
    ',"status":{{"code":' || status_code || coalesce(',"message":' || to_json(status_message), '') || '}}}}', ','
    ORDER BY step_index) AS spans FROM one GROUP BY trace_id)
SELECT t.trace_id, coalesce(per.n, 0) AS span_count, '{{"resource":{{"attributes":[' || concat_ws(',',
    {_attr_sql('service.name', 'string', "'agentrail'")}, {_attr_sql('service.namespace', 'string', "'agentrail'")},
    {_attr_sql('agentrail.trace.name', 'string', "coalesce(t.name, '')")}, {_attr_sql('agentrail.trace.id', 'string', 't.trace_id')},
    CASE WHEN t.framework IS NOT NULL THEN {_attr_sql('agentrail.trace.framework', 'string', 't.framework')} END,
    CASE WHEN json_extract_string(t.metadata, '$.failed') = 'true'
      THEN '{{"key":"agentrail.trace.failed","value":{{"boolValue":true}}}}' END,
    CASE WHEN json_extract_string(t.metadata, '$.error') IS NOT NULL
      THEN {_attr_sql('agentrail.trace.error', 'string', "json_extract_string(t.metadata, '$.error')")} END) ||
  ']}},"scopeSpans":[{{"scope":{{"name":"agentrail"}},"spans":[' || coalesce(per.spans, '') || ']}}]}}' AS resource_spans
FROM ev_traces t LEFT JOIN per ON t.trace_id = per.trace_id""")
def q_export_resource_spans(fx):
    """One OTLP resourceSpans JSON document per trace."""
    return X.resource_spans(fx.get("ev_traces"), fx.get("ev_steps"))


CORPUS_NOTES = """
, la AS (SELECT trace_id, step_id, arg_max(failure_category, seq) AS failure_category,
           arg_max(severity, seq) AS severity FROM ev_annotations GROUP BY trace_id, step_id)"""
CORPUS_ROWS = """
SELECT 'lb-' || substr(la.trace_id, 1, 8) || '-' || substr(la.step_id, 1, 6) AS id, t.framework,
  la.trace_id, la.step_id, la.failure_category, la.severity, 'CC-BY-4.0' AS license
FROM la JOIN ev_steps s ON la.trace_id = s.trace_id AND la.step_id = s.step_id
JOIN ev_traces t ON la.trace_id = t.trace_id"""
CORPUS_SQL = CORPUS_NOTES + CORPUS_ROWS


def _corpus(fx):
    return X.export_corpus(fx.get("ev_traces"), fx.get("ev_steps"), W.latest_annotations(fx.get("ev_annotations")))


@register("export_corpus", ["ev_traces", "ev_steps", "ev_annotations"], CORPUS_SQL)
def q_export_corpus(fx):
    """Benchmark corpus records: one per annotation that finds its step."""
    return _corpus(fx).drop("record_json")


@register("corpus_record_id", ["ev_traces", "ev_steps", "ev_annotations"], """
, la AS (SELECT DISTINCT trace_id, step_id FROM ev_annotations)
SELECT la.trace_id, la.step_id, 'lb-' || substr(la.trace_id, 1, 8) || '-' || substr(la.step_id, 1, 6) AS id
FROM la""")
def q_corpus_record_id(fx):
    """Corpus record id ('lb-' + 8 + '-' + 6) of every annotated step."""
    a = W.latest_annotations(fx.get("ev_annotations"))
    return a.select("trace_id", "step_id", X.corpus_record_id(F.col("trace_id"), F.col("step_id")).alias("id"))


@register("validate_corpus", ["ev_traces", "ev_steps", "ev_annotations"], CORPUS_NOTES + f"""
, rec AS ({CORPUS_ROWS})
SELECT id, regexp_full_match(id, 'lb-[a-z0-9-]+') AS id_ok, '' AS missing_keys, failure_category AS category,
  failure_category IN ({", ".join(f"'{c}'" for c in CORPUS_CATEGORIES)}) AS category_ok FROM rec""")
def q_validate_corpus(fx):
    """Exported corpus lines checked for id pattern, keys and category."""
    return X.validate_corpus(_corpus(fx).select("record_json")).drop("record_json")


@register("leaderboard", ["replay_results", "corpus_categories"], """
SELECT count(*) AS total, count(CASE WHEN ok THEN 1 END) AS replayed, count(CASE WHEN NOT ok THEN 1 END) AS errors,
  CASE WHEN count(*) > 0 THEN count(CASE WHEN NOT ok THEN 1 END) / count(*) ELSE 0.0 END AS fail_rate
FROM replay_results""")
def q_leaderboard(fx):
    """Replay totals and fail rate."""
    t, _ = X.leaderboard(fx.get("replay_results"), fx.get("corpus_categories"))
    return t


@register("leaderboard_categories", ["replay_results", "corpus_categories"], """
SELECT coalesce(c.category, 'unknown') AS category, count(CASE WHEN r.ok THEN 1 END) AS replayed,
  count(CASE WHEN NOT r.ok THEN 1 END) AS errors
FROM replay_results r LEFT JOIN corpus_categories c ON r.id = c.id GROUP BY 1""")
def q_leaderboard_categories(fx):
    """Replayed / errors per corpus category ('unknown' when missing)."""
    _, c = X.leaderboard(fx.get("replay_results"), fx.get("corpus_categories"))
    return c


@register("leaderboard_entry", ["replay_results", "corpus_categories"], """
, c AS (SELECT coalesce(c.category, 'unknown') AS category, count(CASE WHEN r.ok THEN 1 END) AS replayed,
    count(CASE WHEN NOT r.ok THEN 1 END) AS errors
  FROM replay_results r LEFT JOIN corpus_categories c ON r.id = c.id GROUP BY 1)
SELECT 'benchmark' AS corpus, (SELECT count(*) FROM corpus_categories) AS corpus_size, 'openai' AS provider,
  'gpt-4o' AS model, CAST(sum(replayed + errors) AS BIGINT) AS total, CAST(sum(replayed) AS BIGINT) AS replayed,
  CAST(sum(errors) AS BIGINT) AS errors, sum(errors) / sum(replayed + errors) AS fail_rate,
  '{' || string_agg('"' || category || '":{"replayed":' || replayed || ',"errors":' || errors || '}', ',' ORDER BY category) ||
    '}' AS categories, '2024-01-31T00:00:00+00:00' AS timestamp, '1' AS version
FROM c""")
def q_leaderboard_entry(fx):
    """The leaderboard's entry: header, totals and counts by category."""
    cats = fx.get("corpus_categories")
    e = X.leaderboard_entry(fx.get("replay_results"), cats, "benchmark", cats.count(), "openai", "gpt-4o", AS_OF)
    return e.withColumn("categories", F.to_json("categories"))


@register("leaderboard_records", ["replay_results"], """
SELECT id, '{"id":' || JQ(id) || ',"ok":' || CAST(ok AS VARCHAR) ||
  CASE WHEN error IS NULL THEN '' ELSE ',"error":' || JQ(error) END || '}' AS line
FROM replay_results""")
def q_leaderboard_records(fx):
    """The leaderboard's records, one JSON line a replay result."""
    return X.leaderboard_records(fx.get("replay_results"))


@register("gate", ["replay_results"], """
SELECT 'fail-rate' AS metric, count(CASE WHEN NOT ok THEN 1 END) / count(*) AS actual, 0.2 AS threshold,
  count(CASE WHEN NOT ok THEN 1 END) / count(*) > 0.2 AS breach FROM replay_results""")
def q_gate(fx):
    """CI gate 'fail-rate=20%' on the leaderboard."""
    t, _ = X.leaderboard(fx.get("replay_results"), fx.get("corpus_categories"))
    return X.gate(t, "fail-rate=20%")


def _j(col: str) -> str:
    return f"coalesce(CAST(to_json({col}) AS VARCHAR), 'null')"


def _n(col: str) -> str:
    return f"coalesce(CAST({col} AS VARCHAR), 'null')"


def _object(**fields: str) -> str:
    """SQL text of a JSON object, given the SQL of its values."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + " || '}'"


STEP_OBJECT = _object(step_id=_j("step_id"), kind=_j("kind"), name=_j("name"), started_at=_n("started_at"), ended_at=_n("ended_at"),
                      inputs="inputs", outputs="outputs", error=_j("error"))
NOTE_OBJECT = _object(step_id=_j("step_id"), failure_category=_j("failure_category"), severity=_j("severity"), notes=_j("notes"))
TRACE_OBJECT = _object(trace_id=_j("t.trace_id"), name=_j("t.name"), framework=_j("t.framework"), started_at=_n("t.started_at"),
                       ended_at=_n("t.ended_at"), metadata="t.metadata", steps="'[' || coalesce(sc.j, '') || ']'",
                       annotations="'[' || coalesce(ac.j, '') || ']'")
LATEST_NOTES = """
, la AS (SELECT trace_id, step_id, max(seq) AS seq, arg_max(failure_category, seq) AS failure_category,
  arg_max(severity, seq) AS severity, arg_max(notes, seq) AS notes, arg_max(mitigation, seq) AS mitigation,
  arg_max(annotator, seq) AS annotator, arg_max(tags, seq) AS tags FROM ev_annotations GROUP BY trace_id, step_id)"""


@register("trace_document", ["ev_traces", "ev_steps", "ev_annotations"], LATEST_NOTES + f"""
, sc AS (SELECT trace_id, count(*) AS n, string_agg({STEP_OBJECT}, ',' ORDER BY step_index) AS j FROM ev_steps GROUP BY trace_id),
ac AS (SELECT trace_id, count(*) AS n, string_agg({NOTE_OBJECT}, ',' ORDER BY step_id) AS j FROM la GROUP BY trace_id)
SELECT t.trace_id, coalesce(sc.n, 0) AS step_count, coalesce(ac.n, 0) AS annotation_count, {TRACE_OBJECT} AS document
FROM ev_traces t LEFT JOIN sc ON t.trace_id = sc.trace_id LEFT JOIN ac ON t.trace_id = ac.trace_id""")
def q_trace_document(fx):
    """Per trace JSON document with its steps and annotations."""
    return X.trace_documents(fx.get("ev_traces"), fx.get("ev_steps"), W.latest_annotations(fx.get("ev_annotations")))


WHOLE_NOTE = _object(trace_id=_j("la.trace_id"), step_id=_j("la.step_id"), failure_category=_j("failure_category"),
                     severity=_j("severity"), notes=_j("notes"), mitigation=_j("mitigation"), annotator=_j("annotator"),
                     tags=_j("tags"), circuit_attribution="'null'")
FENCE = "chr(10) || '```'"


@register("case_file_markdown", ["ev_traces", "ev_steps", "ev_annotations"], LATEST_NOTES + f"""
, nt AS (SELECT *, {WHOLE_NOTE} AS j FROM la),
an AS (SELECT trace_id, string_agg(concat_ws(chr(10), '', '### ' || failure_category || ' · ' || severity, '', notes, '',
    '**Mitigation:** ' || mitigation, '', '**Tags:** ' || array_to_string(tags, ', '), '', '*— annotated by ' || annotator || '*'),
    chr(10) ORDER BY seq) AS blocks FROM nt GROUP BY trace_id),
st AS (SELECT s.trace_id, s.step_index,
    '| ' || (s.step_index + 1) || ' | `' || s.kind || '` | ' || s.name || CASE WHEN nt.j IS NOT NULL THEN ' ◉' ELSE '' END ||
      ' | ' || printf('%.1f', coalesce((s.ended_at - s.started_at) * 1000, 0)) || ' ms | ' ||
      CASE WHEN s.error IS NOT NULL THEN '**failed**' ELSE 'ok' END || ' |' AS line,
    CASE WHEN s.error IS NOT NULL THEN concat_ws(chr(10), '', '### Step `' || s.name || '` (' || s.kind || ')',
      '```', s.error || {FENCE}, '', '**Inputs**', '```json', s.inputs || {FENCE}, '', '**Outputs**', '```json', s.outputs || {FENCE},
      chr(10) || '**Annotation**' || chr(10) || '```json' || chr(10) || nt.j || {FENCE}) END AS detail
  FROM ev_steps s LEFT JOIN nt ON s.trace_id = nt.trace_id AND s.step_id = nt.step_id),
sa AS (SELECT trace_id, string_agg(line, chr(10) ORDER BY step_index) AS lines,
  string_agg(detail, chr(10) ORDER BY step_index) AS details FROM st GROUP BY trace_id),
tt AS (SELECT *, json_extract_string(metadata, '$.failed') = 'true' AS failed, json_extract_string(metadata, '$.error') AS err FROM ev_traces)
SELECT t.trace_id, concat_ws(chr(10), '# Case File · ' || t.name, '',
  '> `' || substr(t.trace_id, 1, 12) || '` · ' || coalesce(t.framework, 'untagged') || ' · ' ||
    strftime(make_timestamp(CAST(trunc(t.started_at * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S') || ' · ' ||
    printf('%.0f', coalesce((t.ended_at - t.started_at) * 1000, 0)) || ' ms · **' ||
    CASE WHEN t.failed THEN '❗ failed' ELSE '✓ ok' END || '**', '',
  CASE WHEN t.failed THEN concat_ws(chr(10), '## Top-level error', '```', t.err, '```', '') END,
  '## Annotations' || chr(10) || an.blocks || chr(10),
  '## Steps', '', '| # | kind | name | duration | status |', '|---|------|------|---------:|--------|', sa.lines,
  chr(10) || '## Failure detail' || chr(10) || sa.details) AS markdown
FROM tt t LEFT JOIN sa ON t.trace_id = sa.trace_id LEFT JOIN an ON t.trace_id = an.trace_id""")
def q_case_file_markdown(fx):
    """Markdown case file per trace: badge, error, annotations, steps and the
    detail of every failing step."""
    return X.case_files(fx.get("ev_traces"), fx.get("ev_steps"), W.latest_annotations(fx.get("ev_annotations")))
