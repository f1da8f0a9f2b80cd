"""Stand-in inputs built from the driver's tables.

Each view only shapes rows into the schema an operator expects (traces,
steps with JSON payloads, annotations, wire text, ...).  It does none of
the operators' work: payloads are JSON text that the library parses, wire
files are text that the readers split and parse, and so on.

The same SQL text (after ``dialect.render``) builds the view in Spark and,
as a CTE, in the DuckDB oracle, so both engines see identical input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path
from .dialect import render

BASE_TABLES = ["events", "conversations", "documents", "labels", "embeddings",
               "pages", "benchmark"]

# Fixed reference time of every time-dependent query (2024-01-31 00:00 UTC).
AS_OF = 1706659200.0

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], sql) -> None:
    """Register a stand-in view; ``sql`` is one text for both engines or a
    dict {'spark': ..., 'duckdb': ...} where the dialects differ."""
    VIEWS[name] = (deps, sql)


def _sql_for(name: str, dialect: str) -> str:
    sql = VIEWS[name][1]
    return sql[dialect] if isinstance(sql, dict) else sql


# -- events -> one step per event -------------------------------------------
view("ev_base", ["events"], """
SELECT event_id, user_id, event_type, ts, k, epoch, trace_id, step_id,
  CASE event_type WHEN 'click' THEN 'tool-call' WHEN 'view' THEN 'thought'
       ELSE 'llm-call' END AS kind,
  CASE k % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'gemini'
       ELSE 'selfhost' END AS provider,
  CASE event_id % 6 WHEN 0 THEN 'claude-haiku-4-5' WHEN 1 THEN 'gpt-4o'
       WHEN 2 THEN 'gemini-2.5-flash' WHEN 3 THEN 'openai:gpt-4o-mini'
       WHEN 4 THEN 'my-tune-v1' END AS model,
  CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 429
       WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status,
  CASE WHEN k = 0 THEN NULL ELSE k * 100 END AS input_tokens,
  CASE WHEN k = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS output_tokens
FROM (
  SELECT event_id, user_id, event_type, value, ts,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
    CAST(EPOCH_US(ts) AS DOUBLE) / 1000000 AS epoch,
    'u' || lpad(CAST(user_id AS STRING), 6, '0') || '-' || CAST(CAST(ts AS DATE) AS STRING) AS trace_id,
    's' || lpad(CAST(event_id AS STRING), 11, '0') AS step_id
  FROM events) e
""")

view("ev_steps", ["ev_base"], """
SELECT trace_id, step_id,
  CAST(row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) - 1 AS INT) AS step_index,
  CASE WHEN k % 2 = 0 THEN lag(step_id) OVER (PARTITION BY trace_id ORDER BY ts, event_id) END
    AS parent_step_id,
  kind,
  CASE WHEN kind = 'llm-call' THEN provider || ':' || coalesce(model, 'gpt-4o-mini')
       ELSE event_type END AS name,
  epoch AS started_at,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE epoch + CAST(k + 1 AS DOUBLE) / 10 END AS ended_at,
  CASE kind
    WHEN 'llm-call' THEN '{"model":' || coalesce('"' || model || '"', 'null') ||
      ',"provider":"' || provider || '","messages":[{"role":"system","content":"be brief"},' ||
      '{"role":"user","content":"question ' || CAST(event_id AS STRING) || '"}]}'
    WHEN 'tool-call' THEN '{"tool":"' || event_type || '","arguments":{"k":' || CAST(k AS STRING) || '}}'
    ELSE '{"prompt":"think ' || CAST(event_id AS STRING) || '"}' END AS inputs,
  '{"status":' || CAST(http_status AS STRING) ||
    ',"input_tokens":' || coalesce(CAST(input_tokens AS STRING), 'null') ||
    ',"output_tokens":' || coalesce(CAST(output_tokens AS STRING), 'null') ||
    CASE WHEN kind = 'llm-call' THEN ',"text":"answer ' || CAST(event_id AS STRING) ||
      '","finish_reason":"' || CASE WHEN http_status >= 400 THEN 'error' ELSE 'stop' END || '"'
      ELSE '' END ||
    CASE WHEN http_status = 429 THEN ',"rate_limited":true' ELSE '' END || '}' AS outputs,
  '{"transport":"events"}' AS metadata,
  CASE WHEN http_status >= 400 THEN 'HTTP ' || CAST(http_status AS STRING) END AS error
FROM ev_base
""")

view("ev_traces", ["ev_base", "ev_steps"], """
SELECT b.trace_id,
  'agent-' || CAST(min(b.user_id) % 5 AS STRING) AS name,
  CASE min(b.user_id) % 6 WHEN 0 THEN 'langgraph' WHEN 1 THEN 'crewai' WHEN 2 THEN 'autogen'
       WHEN 3 THEN 'dspy' WHEN 4 THEN 'proxy' END AS framework,
  min(s.started_at) AS started_at,
  CASE WHEN count(s.ended_at) = count(*) THEN max(s.ended_at) END AS ended_at,
  '{"failed":' || CASE WHEN max(b.http_status) >= 400 THEN 'true' ELSE 'false' END ||
    ',"error":' || coalesce('"' || min(s.error) || '"', 'null') ||
    ',"provider":"' || min(b.provider) || '"}' AS metadata
FROM ev_base b JOIN ev_steps s ON b.step_id = s.step_id
GROUP BY b.trace_id
""")

view("ev_annotations", ["ev_base"], """
SELECT CASE WHEN event_id % 97 = 0 THEN 'x' || trace_id ELSE trace_id END AS trace_id,
  step_id,
  CASE k % 6 WHEN 0 THEN 'hallucination' WHEN 1 THEN 'loop' WHEN 2 THEN 'tool-misuse'
       WHEN 3 THEN 'off-task' WHEN 4 THEN 'context-drop' ELSE 'other' END AS failure_category,
  CASE WHEN r = 1 THEN 'critical' ELSE
    CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END
  END AS severity,
  CASE WHEN r = 1 THEN 'revised ' ELSE 'note ' END || CAST(event_id AS STRING) AS notes,
  'retry with backoff' AS mitigation,
  'a' || CAST(user_id % 3 AS STRING) AS annotator,
  ARR('auto', 'k' || CAST(k % 3 AS STRING)) AS tags,
  CAST(NULL AS STRING) AS circuit_attribution,
  event_id * 2 + r AS seq
FROM (SELECT *, 0 AS r FROM ev_base WHERE http_status >= 400
      UNION ALL
      SELECT *, 1 AS r FROM ev_base WHERE http_status >= 400 AND event_id % 10 = 0) a
""")

# -- conversations -> one step per turn --------------------------------------
view("cv_steps", ["conversations"], """
SELECT 'c' || CAST(conv_id AS STRING) AS trace_id,
  'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS step_id,
  CAST(turn AS INT) AS step_index,
  CAST(NULL AS STRING) AS parent_step_id,
  CASE role WHEN 'assistant' THEN 'llm-call' WHEN 'system' THEN 'custom' ELSE 'io' END AS kind,
  role AS name,
  CAST(1704067200 + conv_id * 3600 + turn * 10 AS DOUBLE) AS started_at,
  CAST(1704067200 + conv_id * 3600 + turn * 10 + 5 AS DOUBLE) AS ended_at,
  '{"model":"claude-haiku-4-5","messages":[' ||
    coalesce(WSTRAGG(msg, ',', PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || ']}' AS inputs,
  CASE WHEN role = 'assistant' THEN '{"text":' || JQ(text) || '}' ELSE '{}' END AS outputs,
  '{}' AS metadata,
  CAST(NULL AS STRING) AS error
FROM (SELECT *, '{"role":"' || role || '","content":' || JQ(text) || '}' AS msg
      FROM conversations) c
""")

view("cv_traces", ["conversations"], """
SELECT 'c' || CAST(conv_id AS STRING) AS trace_id, 'conversation' AS name,
  'chat' AS framework, CAST(1704067200 + conv_id * 3600 AS DOUBLE) AS started_at,
  CAST(1704067200 + conv_id * 3600 + max(turn) * 10 + 5 AS DOUBLE) AS ended_at,
  '{"failed":false}' AS metadata
FROM conversations GROUP BY conv_id
""")


view("ev_prefixes", ["ev_traces"], """
SELECT DISTINCT substr(trace_id, 1, 7) AS prefix FROM ev_traces
UNION ALL SELECT trace_id FROM ev_traces
UNION ALL SELECT 'x' || substr(trace_id, 2, 17) FROM ev_traces
UNION ALL SELECT '' UNION ALL SELECT '../' || min(trace_id) FROM ev_traces
UNION ALL SELECT '.' || min(trace_id) FROM ev_traces UNION ALL SELECT 'u0*' 
""")

view("ev_requests", ["ev_traces"], """
SELECT batch_id,
  CAST(row_number() OVER (PARTITION BY batch_id ORDER BY trace_id) - 1 AS BIGINT) AS req_pos, id
FROM (SELECT CASE WHEN CAST(substr(trace_id, 17, 2) AS INT) <= 4 THEN 0
                  ELSE CAST(substr(trace_id, 17, 2) AS INT) END AS batch_id, trace_id,
  CASE WHEN CAST(substr(trace_id, 2, 6) AS INT) % 7 = 0 THEN '  '
       WHEN CAST(substr(trace_id, 2, 6) AS INT) % 5 = 0 THEN substr(trace_id, 1, 7)
       WHEN CAST(substr(trace_id, 2, 6) AS INT) % 3 = 0 THEN 'z' || trace_id
       ELSE ' ' || trace_id || ' ' END AS id
FROM ev_traces) r
""")

view("ev_groups", ["ev_traces"], """
SELECT substr(trace_id, 9, 10) || '/' || CAST(IDIV(CAST(substr(trace_id, 2, 6) AS INT), 3) AS STRING)
  AS group_id, trace_id
FROM ev_traces
""")

view("ev_pairs", ["ev_traces"], """
SELECT left_id, right_id FROM (
  SELECT trace_id AS left_id,
    lead(trace_id) OVER (PARTITION BY substr(trace_id, 1, 7) ORDER BY trace_id) AS right_id
  FROM ev_traces) p
WHERE right_id IS NOT NULL
""")

view("run_starts", ["ev_steps"], """
SELECT step_id AS run_id, trace_id, kind, name, started_at FROM ev_steps
""")

view("run_ends", ["ev_steps"], """
SELECT step_id AS run_id, ended_at, error, outputs FROM ev_steps WHERE ended_at IS NOT NULL
UNION ALL
SELECT 'orphan-' || step_id, ended_at, error, outputs FROM ev_steps
WHERE ended_at IS NOT NULL AND step_index = 0
""")


view("wire_files", ["ev_traces", "ev_steps"], """
SELECT 'traces/' || trace_id || '.jsonl' AS file, STRAGG(line, chr(10), k) || chr(10) AS text
FROM (
  SELECT trace_id, CAST(0 AS BIGINT) AS k,
    '{"_type":"trace","trace_id":"' || trace_id || '","name":"' || name || '","framework":' ||
    coalesce('"' || framework || '"', 'null') || ',"started_at":' ||
    CAST(CAST(started_at AS DECIMAL(20,6)) AS STRING) || ',"ended_at":' ||
    coalesce(CAST(CAST(ended_at AS DECIMAL(20,6)) AS STRING), 'null') || ',"metadata":' || metadata || '}' AS line
  FROM ev_traces
  WHERE (CAST(substr(trace_id, 2, 6) AS INT) + CAST(substr(trace_id, 17, 2) AS INT)) % 37 <> 0
  UNION ALL
  SELECT trace_id, CAST((step_index + 1) * 10 AS BIGINT),
    '{"_type":"step","step_id":"' || step_id || '","parent_step_id":' ||
    coalesce('"' || parent_step_id || '"', 'null') || ',"kind":"' || kind || '","name":"' || name ||
    '","started_at":' || CAST(CAST(started_at AS DECIMAL(20,6)) AS STRING) || ',"ended_at":' ||
    coalesce(CAST(CAST(ended_at AS DECIMAL(20,6)) AS STRING), 'null') || ',"inputs":' || inputs ||
    ',"outputs":' || outputs || ',"metadata":' || metadata || ',"error":' ||
    coalesce('"' || error || '"', 'null') || '}' ||
    CASE WHEN eid % 50 = 1 THEN chr(10) || 'garbage {not json' ELSE '' END ||
    CASE WHEN eid % 75 = 2 THEN chr(10) || '[1,2]' ELSE '' END ||
    CASE WHEN eid % 40 = 3 THEN chr(10) || '   ' ELSE '' END ||
    CASE WHEN eid % 60 = 4 THEN chr(10) || '{"_type":"note","n":1} trailing' ELSE '' END ||
    CASE WHEN eid % 45 = 5 THEN chr(10) || '{"_type":"note","n":2}' ELSE '' END
  FROM (SELECT *, CAST(substr(step_id, 2) AS BIGINT) AS eid FROM ev_steps) s
  UNION ALL SELECT trace_id, CAST(1000000 AS BIGINT),
    '{"_type":"trace","trace_id":"' || trace_id || '","name":"renamed","framework":null,' ||
    '"started_at":1.5,"ended_at":null,"metadata":{}}'
  FROM ev_traces
  WHERE (CAST(substr(trace_id, 2, 6) AS INT) + CAST(substr(trace_id, 17, 2) AS INT)) % 41 = 0
) l GROUP BY trace_id
""")


view("trace_docs", ["ev_traces", "ev_steps"], """
SELECT t.trace_id AS doc_id,
  '{' ||
  CASE WHEN u % 19 = 0 THEN '"trace_id":"bad/' || t.trace_id || '",'
       WHEN u % 29 = 0 THEN '' ELSE '"trace_id":"' || t.trace_id || '",' END ||
  CASE WHEN u % 11 = 0 THEN '' ELSE '"name":"' || t.name || '",' END ||
  '"framework":' || coalesce('"' || t.framework || '"', 'null') || ',' ||
  CASE WHEN u % 23 = 0 THEN '' ELSE '"started_at":' || CAST(CAST(t.started_at AS DECIMAL(20,6)) AS STRING) || ',' END ||
  '"ended_at":' || CASE WHEN u % 23 = 0 THEN 'null'
                        ELSE coalesce(CAST(CAST(t.ended_at AS DECIMAL(20,6)) AS STRING), 'null') END || ',' ||
  '"metadata":' || t.metadata || ',' ||
  '"steps":' || CASE WHEN u % 17 = 0 THEN '"not a list"' ELSE '[' || coalesce(s.steps, '') || ']' END ||
  '}' AS doc
FROM (SELECT *, CAST(substr(trace_id, 2, 6) AS INT) AS u FROM ev_traces) t
LEFT JOIN (
  SELECT trace_id, STRAGG(sj, ',', step_index) AS steps FROM (
    SELECT trace_id, step_index,
      '{' || CASE WHEN CAST(substr(trace_id, 2, 6) AS INT) % 29 = 0 THEN ''
                  ELSE '"step_id":"' || step_id || '",' END ||
      '"parent_step_id":' || coalesce('"' || parent_step_id || '"', 'null') ||
      ',"kind":"' || CASE WHEN CAST(substr(trace_id, 2, 6) AS INT) % 13 = 0 AND step_index = 0
                          THEN repeat('k', 65) ELSE kind END ||
      '","name":"' || name || '",' ||
      CASE WHEN CAST(substr(trace_id, 2, 6) AS INT) % 23 = 0 THEN ''
           ELSE '"started_at":' || CAST(CAST(started_at AS DECIMAL(20,6)) AS STRING) || ',' END ||
      '"ended_at":' || coalesce(CAST(CAST(ended_at AS DECIMAL(20,6)) AS STRING), 'null') ||
      ',"inputs":' || inputs || ',"outputs":' || outputs || ',"metadata":' || metadata ||
      ',"error":' || coalesce('"' || error || '"', 'null') || '}' AS sj
    FROM ev_steps) x
  GROUP BY trace_id) s ON t.trace_id = s.trace_id
""")


view("replay_results", ["benchmark"], """
SELECT 'lb-' || CAST(item_id AS STRING) AS id, item_id % 3 <> 0 AS ok,
  CASE WHEN item_id % 3 = 0 THEN 'replay failed: ' || text END AS error
FROM benchmark
""")

view("corpus_categories", ["benchmark"], """
SELECT 'lb-' || CAST(item_id AS STRING) AS id,
  CASE item_id % 4 WHEN 0 THEN 'hallucination' WHEN 1 THEN 'loop' WHEN 2 THEN 'tool-misuse'
       ELSE 'off-task' END AS category
FROM benchmark WHERE item_id % 10 <> 0
""")


_EMB_SPARK = """SELECT vec_id, label, p.pos AS pos, CAST(p.v AS DOUBLE) AS v
  FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, v"""
_EMB_DUCK = """SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"""

_FEAT_ANN = """
SELECT 'e' || lpad(CAST(IDIV(vec_id, 4) AS STRING), 6, '0') AS trace_id,
  'v' || lpad(CAST(vec_id AS STRING), 8, '0') AS step_id,
  CASE label % 6 WHEN 0 THEN 'hallucination' WHEN 1 THEN 'loop' WHEN 2 THEN 'tool-misuse'
       WHEN 3 THEN 'off-task' WHEN 4 THEN 'context-drop' ELSE 'other' END AS failure_category,
  '{"model":"gpt2-small","sae":"gpt2-small-res-jb","method":"sae","top_features":[' ||
    STRAGG(fj, ',', rk) || ']}' AS circuit_attribution
FROM (
  SELECT vec_id, label, rk,
    '{"feature_id":' || CAST(pos AS STRING) || ',"activation":' || CAST(v AS STRING) ||
    ',"layer":"blocks.6.hook_resid_pre"' ||
    CASE WHEN pos % 5 = 0 THEN ',"description":"feature ' || CAST(pos AS STRING) || ' of ' ||
      CAST(label AS STRING) || '"' ELSE '' END || '}' AS fj
  FROM (SELECT vec_id, label, pos, v,
          row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS rk
        FROM (@EMB@) e WHERE v > 0) r
  ) f
GROUP BY vec_id, label
"""
view("feat_annotations", ["embeddings"], {"spark": _FEAT_ANN.replace("@EMB@", _EMB_SPARK),
                                          "duckdb": _FEAT_ANN.replace("@EMB@", _EMB_DUCK)})

_ACTS = """
SELECT IDIV(vec_id, 10) AS step, CAST(vec_id % 10 AS BIGINT) AS token, CAST(pos AS BIGINT) AS feature, v AS value
FROM (@EMB@) e
"""
view("activations", ["embeddings"], {"spark": _ACTS.replace("@EMB@", _EMB_SPARK),
                                     "duckdb": _ACTS.replace("@EMB@", _EMB_DUCK)})

view("explanations", ["embeddings"], """
SELECT 'gpt2-small' AS model, '6-res-jb' AS layer, CAST(f AS BIGINT) AS feature_id,
  'explains feature ' || CAST(f AS STRING) AS text
FROM (SELECT DISTINCT CAST(vec_id % 64 AS BIGINT) AS f FROM embeddings) x WHERE f % 3 <> 2
""")


view("http_calls", ["ev_base"], """
SELECT event_id AS call_id,
  CASE WHEN fam = 0 THEN 'api.anthropic.com'
       WHEN fam = 1 AND user_id % 5 = 0 THEN 'llm-gateway.internal'
       WHEN fam = 1 THEN 'api.openai.com'
       WHEN user_id % 4 = 0 THEN 'us-central1-aiplatform.googleapis.com'
       ELSE 'generativelanguage.googleapis.com' END AS host,
  'POST' AS method,
  CASE WHEN fam = 0 THEN '/v1/messages'
       WHEN fam = 1 AND user_id % 5 = 0 THEN '/proxy/chat'
       WHEN fam = 1 THEN '/v1/chat/completions'
       ELSE '/v1beta/models/gemini-2.5-flash:generateContent' END AS path,
  CASE WHEN fam = 0 THEN '{"model":"claude-haiku-4-5","max_tokens":256,"messages":[{"role":"user","content":"q ' ||
         CAST(event_id AS STRING) || '"}' ||
         CASE WHEN event_type = 'click' THEN ',{"role":"assistant","content":[{"type":"text","text":"checking"},' ||
           '{"type":"tool_use","id":"tu_prev_' || CAST(event_id AS STRING) || '","name":"search","input":{"q":"prev"}}]}'
           ELSE '' END || ']}'
       WHEN fam = 1 THEN '{"model":"gpt-4o","stream":false,"messages":[{"role":"user","content":"q ' ||
         CAST(event_id AS STRING) || '"}' ||
         CASE WHEN event_type = 'click' THEN ',{"role":"assistant","content":null,"tool_calls":[{"id":"call_prev_' ||
           CAST(event_id AS STRING) || '","type":"function","function":{"name":"lookup","arguments":"[1]"}}]}'
           ELSE '' END || ']}'
       ELSE '{"contents":[{"role":"user","parts":[{"text":"q ' || CAST(event_id AS STRING) || '"}]}]}' END
    AS request_body,
  http_status AS status,
  CASE WHEN http_status = 429 THEN '{"error":{"code":429,"message":"rate limited"}}'
       WHEN http_status >= 500 THEN '{"error":{"message":"upstream boom"}}'
       WHEN fam = 0 THEN '{"id":"msg_' || CAST(event_id AS STRING) || '","content":[{"type":"text","text":"a ' ||
         CAST(event_id AS STRING) || '"}' ||
         CASE WHEN event_type = 'click' THEN ',{"type":"tool_use","id":"tu_' || CAST(event_id AS STRING) ||
           '","name":"search","input":{"q":"k' || CAST(k AS STRING) || '"}}' ELSE '' END ||
         '],"stop_reason":"end_turn","usage":{"input_tokens":' || coalesce(CAST(input_tokens AS STRING), 'null') ||
         ',"output_tokens":' || coalesce(CAST(output_tokens AS STRING), 'null') || '}}'
       WHEN fam = 1 THEN '{"choices":[{"message":{"role":"assistant","content":"a ' || CAST(event_id AS STRING) || '"' ||
         CASE WHEN event_type = 'click' THEN ',"tool_calls":[{"id":"call_' || CAST(event_id AS STRING) ||
           '","type":"function","function":{"name":"lookup","arguments":"[' || CAST(k AS STRING) || ']"}}]'
           ELSE '' END ||
         '},"finish_reason":"stop"}],"usage":{"prompt_tokens":' || coalesce(CAST(input_tokens AS STRING), 'null') ||
         ',"completion_tokens":' || coalesce(CAST(output_tokens AS STRING), 'null') || '}}'
       ELSE '{"candidates":[{"content":{"parts":[' ||
         CASE WHEN event_type = 'click' THEN '{"functionCall":{"name":"fetch","args":{"k":' || CAST(k AS STRING) ||
           '}}}' ELSE '{"text":"a ' || CAST(event_id AS STRING) || '"}' END ||
         ']}}],"usageMetadata":{"promptTokenCount":' || coalesce(CAST(input_tokens AS STRING), 'null') ||
         ',"candidatesTokenCount":' || coalesce(CAST(output_tokens AS STRING), 'null') || '}}' END
    AS response_body,
  CAST(NULL AS STRING) AS error, epoch AS started_at, epoch + 0.5 AS ended_at
FROM (SELECT *, k % 3 AS fam FROM ev_base) b
""")

view("hosts", ["pages"], """
SELECT page_id, CASE page_id % 12
    WHEN 0 THEN 'api.anthropic.com' WHEN 1 THEN 'eu.api.openai.com' WHEN 2 THEN 'api.openai.com.evil.net'
    WHEN 3 THEN 'bedrock-runtime.us-east-1.amazonaws.com' WHEN 4 THEN 'us-central1-aiplatform.googleapis.com'
    WHEN 5 THEN 'localhost' WHEN 6 THEN '127.0.0.1' WHEN 7 THEN 'openrouter.ai' WHEN 8 THEN 'API.GROQ.COM'
    WHEN 9 THEN 'lambda.amazonaws.com' WHEN 10 THEN 'unknown.example.com'
    ELSE regexp_extract(url, '^https?://([^/:?#]+)', 1) END AS host,
  CASE page_id % 4 WHEN 0 THEN '/v1/messages' WHEN 1 THEN '/api/v1/chat/completions'
    WHEN 2 THEN '/v1beta/models/gemini-2.0-flash:streamGenerateContent' ELSE '/healthz' END AS path
FROM pages
""")


_SECRET = """CASE n % 9 WHEN 0 THEN 'Bearer ' || substr(md5(CAST(n AS STRING)), 1, 12)
  WHEN 1 THEN 'sk-' || substr(md5(CAST(n AS STRING)), 1, 20)
  WHEN 2 THEN 'sk-ant-' || substr(md5(CAST(n AS STRING)), 1, 24)
  WHEN 3 THEN 'sk-or-' || substr(md5(CAST(n AS STRING)), 1, 18)
  WHEN 4 THEN 'gsk_' || substr(md5(CAST(n AS STRING)), 1, 22)
  WHEN 5 THEN 'gho_' || substr(md5(CAST(n AS STRING)), 1, 22)
  WHEN 6 THEN 'ghp_' || substr(md5(CAST(n AS STRING)), 1, 22)
  WHEN 7 THEN 'AIza' || substr(md5(CAST(n AS STRING)), 1, 24)
  ELSE 'eyJ' || substr(md5(CAST(n AS STRING)), 1, 10) || '.' || substr(md5(CAST(n AS STRING)), 11, 10) || '.' ||
       substr(md5(CAST(n AS STRING)), 21, 10) END"""

view("secrets_text", ["documents", "conversations"], """
SELECT src, n AS id, CASE WHEN n % 7 = 0 THEN text || ' ' || """ + _SECRET + """ ELSE text END AS text
FROM (SELECT 'doc' AS src, doc_id AS n, text FROM documents
      UNION ALL SELECT 'conv', conv_id * 100 + turn, text FROM conversations) t
""")

view("duration_texts", ["events"], """
SELECT event_id, CASE event_id % 8
    WHEN 0 THEN CAST(value AS STRING) || 'd' WHEN 1 THEN ' ' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || 'H '
    WHEN 2 THEN CAST(CAST(floor(value) AS BIGINT) AS STRING) || 'm' WHEN 3 THEN CAST(CAST(floor(value) AS BIGINT) AS STRING) || 's'
    WHEN 4 THEN CAST(CAST(floor(value) AS BIGINT) AS STRING) WHEN 5 THEN '-' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || 'h'
    WHEN 6 THEN event_type || 'd' ELSE '' END AS text
FROM events
""")


_PIECES = """
SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS call_id,
  CASE conv_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'gemini' END AS provider,
  text, length(text) AS n_chars, @N@ AS n_pieces, i, substr(text, CAST(i * 20 + 1 AS INT), 20) AS piece,
  CAST(1704067200 + conv_id * 3600 + turn * 10 AS DOUBLE) AS t0
FROM (SELECT *, @EXPLODE@ FROM conversations WHERE role = 'assistant') c
"""
_N = "CAST(greatest(ceil(length(text) / 20.0), 1) AS BIGINT)"
_P_SPARK = _PIECES.replace("@N@", _N).replace(
    "@EXPLODE@", "explode(sequence(CAST(0 AS BIGINT), " + _N + " - 1)) AS i")
_P_DUCK = _PIECES.replace("@N@", _N).replace(
    "@EXPLODE@", "unnest(generate_series(CAST(0 AS BIGINT), " + _N + " - 1)) AS i")
view("stream_pieces", ["conversations"], {"spark": _P_SPARK, "duckdb": _P_DUCK})

view("stream_events", ["stream_pieces"], """
SELECT call_id, provider, t0, CAST(i AS BIGINT) AS seq,
  CASE provider
    WHEN 'anthropic' THEN '{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":' || JQ(piece) || '}}'
    WHEN 'openai' THEN '{"choices":[{"index":0,"delta":{"content":' || JQ(piece) || '},"finish_reason":null}]}'
    ELSE '{"candidates":[{"content":{"role":"model","parts":[{"text":' || JQ(piece) || '}]}}]}' END AS event
FROM stream_pieces
UNION ALL
SELECT DISTINCT call_id, provider, t0, CAST(-1 AS BIGINT),
  CASE provider
    WHEN 'anthropic' THEN '{"type":"message_start","message":{"usage":{"input_tokens":' || CAST(n_chars AS STRING) || ',"output_tokens":1}}}'
    WHEN 'openai' THEN '{"choices":[{"index":0,"delta":{"role":"assistant","content":""},"finish_reason":null}]}'
    ELSE '{"candidates":[{"content":{"role":"model","parts":[]}}]}' END
FROM stream_pieces
UNION ALL
SELECT DISTINCT call_id, provider, t0, CAST(1000000 AS BIGINT),
  CASE provider
    WHEN 'anthropic' THEN '{"type":"message_delta","delta":{"stop_reason":"end_turn"},"usage":{"output_tokens":' ||
      CAST(n_pieces AS STRING) || '}}'
    WHEN 'openai' THEN '{"choices":[{"index":0,"delta":{},"finish_reason":"stop"}],"usage":{"prompt_tokens":' ||
      CAST(n_chars AS STRING) || ',"completion_tokens":' || CAST(n_pieces AS STRING) || '}}'
    ELSE '{"candidates":[{"content":{"role":"model","parts":[]},"finishReason":"STOP"}],"usageMetadata":{"promptTokenCount":' ||
      CAST(n_chars AS STRING) || ',"candidatesTokenCount":' || CAST(n_pieces AS STRING) || '}}' END
FROM stream_pieces
""")

view("stream_chunks", ["stream_events"], """
SELECT call_id, seq, 'data: ' || event AS line,
  t0 + CASE WHEN seq >= 1000000 THEN 0.9 ELSE CAST(seq + 2 AS DOUBLE) / 1000 END AS received_at
FROM stream_events
UNION ALL SELECT DISTINCT call_id, CAST(-2 AS BIGINT), ': keep-alive', t0 FROM stream_events
UNION ALL SELECT DISTINCT call_id, CAST(1000001 AS BIGINT), 'data: [DONE]', t0 + 0.95 FROM stream_events
""")


view("secret_json", ["documents"], """
SELECT doc_id, '{"api_key":"' || md5(CAST(doc_id AS STRING)) || '","note":' || JQ(text) ||
  ',"tokens":' || CAST(n_chars AS STRING) || ',"nested":{"Authorization":"Bearer ' || md5(lang) ||
  '","items":[' || JQ(source) || ',{"password":"x","keep":1}]},"deep":' ||
  '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"secret":"x"}}}}}}}}}}}' AS payload
FROM documents
""")


# Request bodies with inline media in the known shapes (the media are the
# documents' texts), secrets in and beside them, and counts of tokens.
_B64 = {
    "spark": "regexp_replace(base64(CAST(text AS BINARY)), '[^A-Za-z0-9+/=]', '')",
    "duckdb": "to_base64(encode(text))",
}
_MEDIA_CALLS = """
SELECT doc_id, text, CASE doc_id %% 4
  WHEN 0 THEN '{"model":"m","max_tokens":256,"usage":{"total_tokens":7},"messages":[{"role":"user","content":[' ||
    '{"type":"image","source":{"type":"base64","media_type":"image/png","data":"' || %(b64)s ||
    '"}},{"type":"text","text":"key sk-' || md5(CAST(doc_id AS STRING)) || '"}]}]}'
  WHEN 1 THEN '{"stream":true,"token":"x","messages":[{"role":"user","content":[{"type":"image_url","image_url":' ||
    '{"url":"data:image/png;base64,' || %(b64)s || '"}},{"type":"image_url","image_url":{"url":"https://a.example/b"}}]}]}'
  WHEN 2 THEN '{"api_key":"k","contents":[{"role":"user","parts":[{"inlineData":{"mimeType":"image/png","data":"' ||
    %(b64)s || '"}},{"password":"p"}]}]}'
  ELSE '{"stream":false,"max_tokens":5,"prompt":"use sk-' || md5(CAST(doc_id AS STRING)) || ' now"}' END AS body
FROM documents
"""
view("media_calls", ["documents"], {d: _MEDIA_CALLS % {"b64": b} for d, b in _B64.items()})


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n in BASE_TABLES:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def cte(names: list[str]) -> str:
    """``WITH`` clause (DuckDB dialect) defining ``names`` and their deps."""
    parts = [f"{n} AS MATERIALIZED ({render(_sql_for(n, 'duckdb'), 'duckdb').strip()})" for n in _order(names)]
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""


class Fixtures:
    """Spark-side builder: ``fx.get('ev_steps')`` returns the view as a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # every day bucket and epoch conversion of the library is UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(table_path(self.sf_dir, name))
        return self._cache[name]

    def get(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.table(name)
        if name not in self._cache:
            deps = VIEWS[name][0]
            text = render(_sql_for(name, "spark"), "spark")
            for d in deps:
                alias = f"_ar{id(self):x}_{d}"
                self.get(d).createOrReplaceTempView(alias)
                text = _sub_table(text, d, alias)
            self._cache[name] = self.spark.sql(text)
        return self._cache[name]


def _sub_table(sql: str, name: str, alias: str) -> str:
    import re
    return re.sub(rf"(?<![\w'\".]){name}(?![\w'\"])", alias, sql)
