"""HTTP call logs: normalisation into llm-call steps, provider detection,
response summaries, tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources import http as H
from . import sqlvals
from .catalog import register

PROVIDER_CTES = f""",
{sqlvals.PROVIDERS}, {sqlvals.PATH_HINTS},
hp AS (SELECT h.host, arg_min(p.label, p.priority) AS prov
       FROM (SELECT DISTINCT lower(host) AS host FROM {{src}}) h JOIN providers p
       ON CASE WHEN p.strategy = 'contains' THEN strpos(h.host, lower(p.host_pattern)) > 0
               ELSE h.host = lower(p.host_pattern) OR ends_with(h.host, '.' || lower(p.host_pattern)) END
       WHERE length(h.host) > 0 GROUP BY h.host),
pp AS (SELECT c.path, arg_min(ph.provider, ph.priority) AS prov
       FROM (SELECT DISTINCT coalesce(path, '') AS path FROM {{src}}) c JOIN path_hints ph
       ON strpos(c.path, ph.hint) > 0 GROUP BY c.path)"""


def _falsy_or_sql(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR json_type({a}) = 'NULL' OR TRY_CAST(json_extract_string({a}, '$') AS DOUBLE) = 0 "
            f"OR json_extract_string({a}, '$') = '' OR json_extract_string({a}, '$') = 'false' THEN {b} ELSE {a} END")


NORM_SQL = PROVIDER_CTES.format(src="http_calls") + f""",
n0 AS (
  SELECT c.*, coalesce(hp.prov, pp.prov,
      CASE WHEN json_type(request_body) = 'OBJECT' AND json_extract(request_body, '$.model') IS NOT NULL
                AND json_type(request_body, '$.messages') = 'ARRAY' THEN 'openai-compatible:' || c.host END) AS provider,
    CAST(response_body AS JSON) AS r
  FROM http_calls c LEFT JOIN hp ON lower(c.host) = hp.host LEFT JOIN pp ON coalesce(c.path, '') = pp.path),
n1 AS (
  SELECT *,
    coalesce(CASE WHEN json_type(request_body, '$.model') = 'VARCHAR' THEN json_extract_string(request_body, '$.model') END,
             CASE WHEN strpos(path, '/models/') > 0 THEN nullif(regexp_extract(path, '/models/([^:/]*)', 1), '') END) AS model,
    coalesce(
      CASE WHEN json_type(r, '$.candidates[0].content.parts[0]') = 'OBJECT'
            AND json_type(r, '$.candidates[0].content.parts[0].text') = 'VARCHAR'
           THEN json_extract_string(r, '$.candidates[0].content.parts[0].text') END,
      CASE WHEN json_type(r, '$.content[0]') = 'OBJECT' AND json_type(r, '$.content[0].text') = 'VARCHAR'
           THEN json_extract_string(r, '$.content[0].text') END,
      CASE WHEN json_type(r, '$.choices[0]') = 'OBJECT' AND json_type(r, '$.choices[0].message.content') = 'VARCHAR'
           THEN json_extract_string(r, '$.choices[0].message.content') END) AS text,
    CASE WHEN json_type(r, '$.choices[0]') = 'OBJECT' THEN json_extract_string(r, '$.choices[0].finish_reason') END
      AS finish_reason,
    CASE WHEN json_type(r, '$.content[0]') = 'OBJECT' THEN json_extract_string(r, '$.stop_reason') END AS stop_reason,
    TRY_CAST(json_extract_string(CASE WHEN json_type(r, '$.usage') = 'OBJECT'
        THEN {_falsy_or_sql("json_extract(r, '$.usage.input_tokens')", "json_extract(r, '$.usage.prompt_tokens')")}
        WHEN json_type(r, '$.usageMetadata') = 'OBJECT' THEN json_extract(r, '$.usageMetadata.promptTokenCount') END, '$')
      AS BIGINT) AS input_tokens,
    TRY_CAST(json_extract_string(CASE WHEN json_type(r, '$.usage') = 'OBJECT'
        THEN {_falsy_or_sql("json_extract(r, '$.usage.output_tokens')", "json_extract(r, '$.usage.completion_tokens')")}
        WHEN json_type(r, '$.usageMetadata') = 'OBJECT' THEN json_extract(r, '$.usageMetadata.candidatesTokenCount') END, '$')
      AS BIGINT) AS output_tokens,
    coalesce(status = 429 OR (json_type(r, '$.error') = 'OBJECT' AND TRY_CAST(json_extract_string(r, '$.error.code') AS BIGINT) = 429),
             false) AS rate_limited,
    coalesce(error, CASE WHEN status >= 400 THEN 'HTTP ' || CAST(status AS VARCHAR) || ': ' || coalesce(
        CASE WHEN json_type(r, '$.error.message') = 'VARCHAR' THEN json_extract_string(r, '$.error.message') END,
        CASE WHEN json_type(r, '$.error') = 'VARCHAR' THEN json_extract_string(r, '$.error') END,
        CASE WHEN json_type(r, '$.message') = 'VARCHAR' THEN json_extract_string(r, '$.message') END,
        response_body, '') END) AS err,
    CASE WHEN provider = 'anthropic' THEN coalesce(len(list_filter(CAST(json_extract(r, '$.content[*]') AS JSON[]),
                lambda b: json_extract_string(b, '$.type') = 'tool_use')), 0)
         WHEN provider = 'openai' OR starts_with(provider, 'openai-compatible:')
           THEN coalesce(json_array_length(r, '$.choices[0].message.tool_calls'), 0)
         WHEN provider = 'gemini' THEN coalesce(len(list_filter(CAST(json_extract(r, '$.candidates[*].content.parts[*]') AS JSON[]),
                lambda p: json_extract(p, '$.functionCall') IS NOT NULL)), 0)
         ELSE 0 END AS tool_call_count
  FROM n0)"""


def _norm(fx):
    return H.normalize_llm_calls(fx.get("http_calls"))


@register("normalize_llm_calls", ["http_calls"], NORM_SQL + """
SELECT call_id, provider, model, coalesce(provider, 'unknown') || ':' || coalesce(model, 'unknown') AS name,
  input_tokens, output_tokens, text, finish_reason, stop_reason, status, rate_limited, err AS error,
  CAST(tool_call_count AS INT) AS tool_call_count
FROM n1""")
def q_normalize_llm_calls(fx):
    """HTTP call log rows -> llm-call steps with provider, model, tokens,
    text, finish/stop reason, rate limit, error and tool-call count."""
    n = _norm(fx)
    return n.select("call_id", "provider", "model", "name", "input_tokens", "output_tokens", "text",
                    "finish_reason", "stop_reason", "status", "rate_limited", "error",
                    F.size("tool_calls").alias("tool_call_count"))


@register("response_summary", ["http_calls"], NORM_SQL + """
SELECT call_id, text, finish_reason, stop_reason, input_tokens, output_tokens FROM n1""")
def q_response_summary(fx):
    """Text, reasons and token counts from the three response shapes."""
    return _norm(fx).select("call_id", "text", "finish_reason", "stop_reason", "input_tokens", "output_tokens")


@register("extract_model", ["http_calls"], NORM_SQL + "SELECT call_id, model FROM n1")
def q_extract_model(fx):
    """Model from the request body, else from the URL path."""
    return _norm(fx).select("call_id", "model")


@register("rate_limited_flag", ["http_calls"], NORM_SQL + "SELECT call_id, rate_limited FROM n1")
def q_rate_limited_flag(fx):
    """Rate limited: status 429 or a body error code 429."""
    return _norm(fx).select("call_id", "rate_limited")


@register("error_message", ["http_calls"], NORM_SQL + "SELECT call_id, err AS error FROM n1")
def q_error_message(fx):
    """'HTTP <status>: <message>' of failed calls."""
    return _norm(fx).select("call_id", "error")


@register("resolve_provider", ["http_calls"], NORM_SQL + "SELECT call_id, provider FROM n1")
def q_resolve_provider(fx):
    """Provider of each call: host, then path hint, then OpenAI-compatible body."""
    return _norm(fx).select("call_id", "provider")


@register("openai_compatible", ["http_calls"], """
SELECT call_id, coalesce(json_type(request_body) = 'OBJECT' AND json_extract(request_body, '$.model') IS NOT NULL
  AND json_type(request_body, '$.messages') = 'ARRAY', false) AS openai_compatible FROM http_calls""")
def q_openai_compatible(fx):
    """Request bodies in the OpenAI chat shape (model + messages list)."""
    c = fx.get("http_calls")
    return c.select("call_id", F.coalesce(H.openai_compatible(F.try_parse_json("request_body")), F.lit(False))
                    .alias("openai_compatible"))


@register("response_tool_calls", ["http_calls"], NORM_SQL + """
, a AS (SELECT call_id, CAST(json_extract(r, '$.content[*]') AS JSON[]) AS l FROM n1 WHERE provider = 'anthropic'),
a2 AS (SELECT call_id, unnest(list_filter(l, lambda b: json_extract_string(b, '$.type') = 'tool_use')) AS b FROM a),
o AS (SELECT call_id, unnest(CAST(json_extract(r, '$.choices[0].message.tool_calls[*]') AS JSON[])) AS t FROM n1
      WHERE provider = 'openai' OR starts_with(provider, 'openai-compatible:')),
g AS (SELECT call_id, unnest(list_filter(CAST(json_extract(r, '$.candidates[*].content.parts[*]') AS JSON[]),
        lambda p: json_extract(p, '$.functionCall') IS NOT NULL)) AS p FROM n1 WHERE provider = 'gemini')
SELECT call_id, json_extract_string(b, '$.name') AS name, CAST(json_extract(b, '$.input') AS VARCHAR) AS arguments FROM a2
UNION ALL
SELECT call_id, json_extract_string(t, '$.function.name'),
  CAST(CAST(json_extract_string(t, '$.function.arguments') AS JSON) AS VARCHAR) FROM o
UNION ALL
SELECT call_id, json_extract_string(p, '$.functionCall.name'), CAST(json_extract(p, '$.functionCall.args') AS VARCHAR) FROM g""")
def q_response_tool_calls(fx):
    """Tool calls the model asked for, one row each, in all three shapes."""
    return H.explode_tool_calls(_norm(fx)).select("call_id", "name", "arguments")


@register("tool_call_frequency", ["http_calls"], NORM_SQL + """
, a AS (SELECT call_id, CAST(json_extract(r, '$.content[*]') AS JSON[]) AS l FROM n1 WHERE provider = 'anthropic'),
names AS (
  SELECT json_extract_string(unnest(list_filter(l, lambda b: json_extract_string(b, '$.type') = 'tool_use')), '$.name') AS tool FROM a
  UNION ALL
  SELECT json_extract_string(unnest(CAST(json_extract(r, '$.choices[0].message.tool_calls[*]') AS JSON[])), '$.function.name')
  FROM n1 WHERE provider = 'openai' OR starts_with(provider, 'openai-compatible:')
  UNION ALL
  SELECT json_extract_string(unnest(list_filter(CAST(json_extract(r, '$.candidates[*].content.parts[*]') AS JSON[]),
        lambda p: json_extract(p, '$.functionCall') IS NOT NULL)), '$.functionCall.name') FROM n1 WHERE provider = 'gemini')
SELECT tool, count(*) AS calls FROM names GROUP BY tool""")
def q_tool_call_frequency(fx):
    """Tool calls by tool name."""
    return H.tool_call_frequency(_norm(fx))


@register("explode_tool_calls", ["http_calls"], NORM_SQL + """
SELECT call_id, CAST(tool_call_count AS BIGINT) AS n FROM n1 WHERE tool_call_count > 0""")
def q_explode_tool_calls(fx):
    """Table function: calls exploded to tool-call rows (counted per call)."""
    return (H.explode_tool_calls(_norm(fx)).groupBy("call_id").agg(F.count(F.lit(1)).alias("n")))


@register("detect_provider", ["hosts"], PROVIDER_CTES.format(src="hosts") + """
SELECT page_id, hosts.host, hp.prov AS provider FROM hosts LEFT JOIN hp ON lower(hosts.host) = hp.host""")
def q_detect_provider(fx):
    """Provider of each host (suffix / contains rules, list order wins)."""
    return J.detect_provider(fx.get("hosts"), "host").select("page_id", "host", "provider")


@register("detect_provider_path", ["hosts"], PROVIDER_CTES.format(src="hosts") + """
SELECT page_id, hosts.path, pp.prov AS path_provider FROM hosts LEFT JOIN pp ON coalesce(hosts.path, '') = pp.path""")
def q_detect_provider_path(fx):
    """Provider from the URL path hint (first match in list order)."""
    return J.detect_provider_path(fx.get("hosts"), "path").select("page_id", "path", "path_provider")
