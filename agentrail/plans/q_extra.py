"""Remaining operators: price list, per-step cost, span parts, previews,
tool calls in requests, AnyValue, sinks, step tail."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text as TX
from ..operators import costs
from ..operators import features as FT
from ..operators import udf as U
from ..session import materialize, scratch_path
from ..sinks import exports as X
from ..sinks.protocol import FlatParquetSink, Sink, WireSink
from ..sources import http as H
from ..sources import wire as WR
from ..streaming import jobs as S
from .catalog import register
from .q_costs import priced_sql
from .q_export import SPAN_FRAGS, _int_sql, _str_sql
from .q_features import FEATS


@register("top_features", ["feat_annotations"], FEATS + """
SELECT feature_id, count(*) AS hits FROM feats GROUP BY feature_id ORDER BY hits DESC, feature_id LIMIT 5""")
def q_top_features(fx):
    """The 5 most common attributed features."""
    return FT.feature_frequency(FT.explode_features(fx.get("feat_annotations")), None, 5).select("feature_id", "hits")


@register("price_list", ["ev_steps"], priced_sql("ev_steps") + """
, used AS (SELECT price_model, count(*) AS n FROM priced_x WHERE cost_pico IS NOT NULL GROUP BY price_model)
SELECT p.provider, p.model, p.in_per_m, p.out_per_m, CAST(coalesce(u.n, 0) AS BIGINT) AS priced_calls
FROM prices p LEFT JOIN used u ON p.model = u.price_model ORDER BY p.provider, p.model""")
def q_price_list(fx):
    """The price table by provider and model, with the calls each row priced."""
    used = (costs.price_steps(fx.get("ev_steps")).filter(F.col("cost_pico").isNotNull())
            .groupBy(F.col("price_model").alias("model")).agg(F.count(F.lit(1)).alias("n")))
    p = dims.prices_df(fx.spark)
    return (p.join(used, "model", "left").orderBy("provider", "model")
            .select("provider", "model", "in_per_m", "out_per_m",
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("priced_calls")))


@register("estimate_cost", ["ev_steps"], priced_sql("ev_steps") + """
SELECT step_id, cost_usd FROM priced_x""")
def q_estimate_cost(fx):
    """Cost of every llm call (null when tokens or a price are missing)."""
    return costs.price_steps(fx.get("ev_steps")).select("step_id", "cost_usd")


SPAN_BASE = f"""
, sp AS (SELECT *, coalesce(nullif(kind, ''), 'custom') AS k,
    {_str_sql('inputs', '$.provider')} AS prov, {_str_sql('inputs', '$.model')} AS model,
    {_int_sql('inputs', '$.max_tokens')} AS maxt, {_int_sql('outputs', '$.input_tokens')} AS itok,
    {_int_sql('outputs', '$.output_tokens')} AS otok,
    coalesce({_str_sql('outputs', '$.finish_reason')}, {_str_sql('outputs', '$.stop_reason')}) AS fin,
    {_str_sql('metadata', '$.transport')} AS tr, {_str_sql('metadata', '$.method')} AS meth,
    {_str_sql('metadata', '$.path')} AS upath, {_int_sql('outputs', '$.status')} AS st
  FROM ev_steps)"""


@register("span_kind", ["ev_steps"], SPAN_BASE + """
SELECT step_id, CASE WHEN k IN ('llm-call', 'tool-call') THEN 3 ELSE 1 END AS kind FROM sp""")
def q_span_kind(fx):
    """OTLP span kind of every step (CLIENT for llm and tool calls, else INTERNAL)."""
    return X.spans(fx.get("ev_steps")).select("step_id", "kind")


@register("span_status", ["ev_steps"], SPAN_BASE + """
SELECT step_id, CASE WHEN (error IS NOT NULL AND error <> '') OR st >= 500 THEN 2 ELSE 1 END AS status_code,
  CASE WHEN error IS NOT NULL AND error <> '' THEN error WHEN st >= 500 THEN 'upstream returned ' || CAST(st AS VARCHAR) END
    AS status_message FROM sp""")
def q_span_status(fx):
    """OTLP span status of every step (ERROR on error or status >= 500) and its message."""
    return X.spans(fx.get("ev_steps")).select("step_id", "status_code", "status_message")


@register("gen_ai_attributes", ["ev_steps"], SPAN_BASE + f"""
SELECT step_id, '[' || concat_ws(',', {', '.join(SPAN_FRAGS)}) || ']' AS attributes_json FROM sp""")
def q_gen_ai_attributes(fx):
    """OTLP attribute list (GenAI conventions, HTTP, tool name) of every step."""
    return X.spans(fx.get("ev_steps")).select("step_id", "attributes_json")


@register("prompt_preview", ["cv_steps"], """
SELECT step_id, coalesce(nullif(array_to_string(list_filter(list_transform(
    CAST(json_extract(inputs, '$.messages[*]') AS JSON[]),
    lambda m: CASE WHEN json_type(m, '$.content') = 'VARCHAR' AND length(json_extract_string(m, '$.content')) > 0
      THEN CASE WHEN coalesce(json_extract_string(m, '$.role'), '') <> ''
                THEN json_extract_string(m, '$.role') || ': ' || json_extract_string(m, '$.content')
                ELSE json_extract_string(m, '$.content') END END), lambda x: x IS NOT NULL), chr(10)), ''), '') AS preview
FROM cv_steps""")
def q_prompt_preview(fx):
    """Display prompt ('role: text' lines) of every conversation step."""
    return fx.get("cv_steps").select("step_id", TX.prompt_preview("inputs").alias("preview"))


@register("reply_preview", ["cv_steps"], """
SELECT step_id, coalesce(CASE WHEN json_type(outputs, '$.text') = 'VARCHAR' AND length(trim(json_extract_string(outputs, '$.text'))) > 0
  THEN json_extract_string(outputs, '$.text') END, '') AS reply FROM cv_steps""")
def q_reply_preview(fx):
    """Display reply of every conversation step (text / output / reply / completion)."""
    return fx.get("cv_steps").select("step_id", TX.reply_preview("outputs").alias("reply"))


@register("token_summary", ["ev_steps"], """
SELECT step_id, CASE WHEN i IS NULL AND o IS NULL THEN ''
  ELSE concat_ws(' · ', 'in ' || CAST(i AS VARCHAR), 'out ' || CAST(o AS VARCHAR)) || ' tokens' END AS tokens
FROM (SELECT step_id,
  CASE WHEN json_type(outputs, '$.input_tokens') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(outputs, '$.input_tokens') AS BIGINT) END AS i,
  CASE WHEN json_type(outputs, '$.output_tokens') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(outputs, '$.output_tokens') AS BIGINT) END AS o
  FROM ev_steps) t""")
def q_token_summary(fx):
    """'in N · out M tokens' of every step with integer token counts."""
    return fx.get("ev_steps").select("step_id", TX.token_summary("outputs").alias("tokens"))


@register("message_tool_calls", ["http_calls"], """
, m AS (SELECT call_id, unnest(CAST(json_extract(request_body, '$.messages[*]') AS JSON[])) AS msg FROM http_calls),
a AS (SELECT call_id, unnest(list_filter(CAST(json_extract(msg, '$.content[*]') AS JSON[]),
        lambda b: json_extract_string(b, '$.type') = 'tool_use')) AS b FROM m WHERE json_type(msg, '$.content') = 'ARRAY'),
o AS (SELECT call_id, unnest(CAST(json_extract(msg, '$.tool_calls[*]') AS JSON[])) AS t FROM m
      WHERE json_type(msg, '$.tool_calls') = 'ARRAY')
SELECT call_id, json_extract_string(b, '$.name') AS name, CAST(json_extract(b, '$.input') AS VARCHAR) AS arguments FROM a
UNION ALL
SELECT call_id, json_extract_string(t, '$.function.name'), CAST(CAST(json_extract_string(t, '$.function.arguments') AS JSON) AS VARCHAR)
FROM o""")
def q_message_tool_calls(fx):
    """Tool calls already present in the request messages of each call."""
    c = fx.get("http_calls").select("call_id", H.message_tool_calls(
        F.get_json_object("request_body", "$.messages")).alias("tool_calls"))
    return H.explode_tool_calls(c).select("call_id", "name", "arguments")


def _any_string(path: str) -> str:
    x = f"json_extract_string(inputs, '{path}')"
    return f"""'{{"stringValue":' || coalesce(JQ({x}), '""') || '}}'"""


def _any_object(members: dict[str, str]) -> str:
    """SQL text of an AnyValue object from its members' AnyValues."""
    inside = " || '},' || ".join(f"""'{{"key":"{k}","value":' || {v}""" for k, v in members.items())
    return f"""'{{"kvlistValue":{{"values":[' || {inside} || '}}]}}}}'"""


def _any_message(i: int) -> str:
    return _any_object({k: _any_string(f"$.messages[{i}].{k}") for k in ("role", "content")})


ANY_MESSAGES = f"""'{{"arrayValue":{{"values":[' || {_any_message(0)} || ',' || {_any_message(1)} || ']}}}}'"""
ANY_COUNT = """'{"intValue":"' || json_extract_string(inputs, '$.arguments.k') || '"}'"""


@register("otlp_any_value", ["ev_steps"], f"""
SELECT step_id, CASE kind
  WHEN 'llm-call' THEN {_any_object({"model": _any_string("$.model"), "provider": _any_string("$.provider"),
                                     "messages": ANY_MESSAGES})}
  WHEN 'tool-call' THEN {_any_object({"tool": _any_string("$.tool"), "arguments": _any_object({"k": ANY_COUNT})})}
  ELSE {_any_object({"prompt": _any_string("$.prompt")})} END AS any_value
FROM ev_steps""")
def q_otlp_any_value(fx):
    """Step inputs rendered as OTLP AnyValue JSON (recursive tagged union)."""
    return fx.get("ev_steps").select("step_id", U.otlp_any_value("inputs").alias("any_value"))


@register("sink_protocol", ["ev_steps"], """
SELECT trace_id, count(*) AS wire_steps, count(*) AS flat_steps FROM ev_steps GROUP BY trace_id""")
def q_sink_protocol(fx):
    """Traces saved through the Sink protocol (wire files and flat Parquet)
    and read back."""
    base = scratch_path(fx.spark, "sinks")
    sinks: list[Sink] = [WireSink(f"{base}/wire"), FlatParquetSink(f"{base}/flat")]
    t, s = materialize(fx.get("ev_traces"), "traces"), materialize(fx.get("ev_steps"), "steps")   # read by each sink
    for sink in sinks:
        sink.save(t, s)
    from ..sinks.wire import read_wire_lines
    traces, steps = WR.split_traces(WR.trace_lines(read_wire_lines(fx.spark, f"{base}/wire")))
    flat = X.read_flat_steps(fx.spark, f"{base}/flat")
    return (steps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("wire_steps"))
            .join(flat.groupBy("trace_id").agg(F.count(F.lit(1)).alias("flat_steps")), "trace_id", "full"))


@register("step_tail", ["ev_steps"], """
SELECT count(*) AS callbacks, count(CASE WHEN step_index = 0 THEN 1 END) AS failures FROM ev_steps WHERE ended_at IS NOT NULL""")
def q_step_tail(fx):
    """Finished steps handed to a callback per micro-batch (on the
    executors); a failing callback does not stop the stream."""
    base = scratch_path(fx.spark, "tail")
    s = fx.get("ev_steps")
    s.repartition(4, "step_id").write.parquet(f"{base}/in")
    stream = S.parquet_stream(fx.spark, f"{base}/in", s.schema, max_files=1)

    def callback(row):
        if row["step_index"] == 0:
            raise RuntimeError("callback failure is swallowed")

    S.tail(stream, callback, f"{base}/ckpt", report=f"{base}/report").awaitTermination()
    return S.tail_report(fx.spark, f"{base}/report").agg(
        F.sum("calls").alias("callbacks"), F.sum("failures").alias("failures"))
