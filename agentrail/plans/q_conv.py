"""Conversation views over recorded chats: prompts, replies, last user
turn, replay inputs, chat bubbles."""

from __future__ import annotations

from ..functions import text as TX
from ..operators import windows as W
from .catalog import register

MSGS = "CAST(json_extract(inputs, '$.messages[*]') AS JSON[])"


@register("prompt_text", ["cv_steps"], f"""
SELECT step_id, coalesce(array_to_string(list_transform({MSGS},
    lambda m: '[' || coalesce(json_extract_string(m, '$.role'), '?') || '] ' || json_extract_string(m, '$.content')),
    chr(10)), '') AS prompt
FROM cv_steps""")
def q_prompt_text(fx):
    """Prompt of every conversation step as '[role] text' lines."""
    s = fx.get("cv_steps")
    return s.select("step_id", TX.prompt_text("inputs").alias("prompt"))


@register("response_text", ["cv_steps"], """
SELECT step_id, coalesce(CASE WHEN json_type(outputs, '$.text') = 'VARCHAR' THEN json_extract_string(outputs, '$.text') END,
  CASE WHEN json_type(outputs, '$.answer') = 'VARCHAR' THEN json_extract_string(outputs, '$.answer') END, '') AS response
FROM cv_steps""")
def q_response_text(fx):
    """Reply text of every step (text, else answer, else '')."""
    s = fx.get("cv_steps")
    return s.select("step_id", TX.response_text("outputs").alias("response"))


@register("last_user_turn", ["cv_steps"], f"""
SELECT trace_id, step_id, coalesce(json_extract_string(list_filter({MSGS},
    lambda m: json_extract_string(m, '$.role') = 'user' AND json_type(m, '$.content') = 'VARCHAR')[-1], '$.content'), '')
  AS last_user_text
FROM cv_steps""")
def q_last_user_turn(fx):
    """The last user message before every conversation step."""
    return W.last_user_turn(fx.get("cv_steps"))


@register("replay_inputs", ["cv_steps"], f"""
, c AS (SELECT trace_id, step_index,
    CASE WHEN kind = 'llm-call' THEN nullif(array_to_string(list_transform(list_filter({MSGS},
      lambda m: json_type(m, '$.content') = 'VARCHAR'), lambda m: json_extract_string(m, '$.content')), chr(10)), '') END AS p,
    CASE WHEN kind = 'llm-call' THEN
      CASE WHEN json_type(inputs, '$.model') = 'VARCHAR' THEN nullif(json_extract_string(inputs, '$.model'), '')
           WHEN strpos(name, ':') > 0 THEN nullif(substr(name, strpos(name, ':') + 1), '') END END AS m
  FROM cv_steps)
SELECT trace_id, coalesce(arg_min(p, CASE WHEN p IS NOT NULL THEN step_index END), '') AS prompt,
  coalesce(arg_min(m, CASE WHEN m IS NOT NULL THEN step_index END), '') AS model
FROM c GROUP BY trace_id""")
def q_replay_inputs(fx):
    """Prompt and model a replay of each conversation would use."""
    return W.replay_inputs(fx.get("cv_steps"))


@register("conversation_bubbles", ["cv_steps"], f"""
, l AS (SELECT trace_id, step_id, {MSGS} AS ms,
          CASE WHEN json_type(outputs, '$.text') = 'VARCHAR' THEN json_extract_string(outputs, '$.text') END AS reply
        FROM cv_steps WHERE kind = 'llm-call'),
x AS (SELECT trace_id, step_id, ms, reply,
        unnest(generate_series(1, len(ms) + CASE WHEN reply IS NOT NULL THEN 1 ELSE 0 END)) AS i FROM l)
SELECT trace_id, step_id, CAST(i - 1 AS BIGINT) AS pos,
  CASE WHEN i > len(ms) THEN 'assistant'
       WHEN coalesce(json_extract_string(ms[i], '$.role'), 'user') = 'model' THEN 'assistant'
       ELSE coalesce(json_extract_string(ms[i], '$.role'), 'user') END AS role,
  CASE WHEN i > len(ms) THEN reply ELSE json_extract_string(ms[i], '$.content') END AS text,
  i > len(ms) AS is_reply
FROM x""")
def q_conversation_bubbles(fx):
    """Chat bubbles (request messages then reply) of every assistant turn."""
    return W.conversation_bubbles(fx.get("cv_steps"))
