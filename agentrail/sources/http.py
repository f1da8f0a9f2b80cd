"""HTTP call logs of LLM APIs -> llm-call steps.

Input rows: ``call_id, host, method, path, request_body, status,
response_body, error, started_at, ended_at`` (bodies are JSON text).
Each body is parsed once into a VARIANT column; every field below is an
expression over it.  Provider resolution: forced -> host (bounded
provider list, matched once per distinct host) -> URL path hint ->
OpenAI-compatible body (``openai-compatible:<host>``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import detect_provider, detect_provider_path


def _t(v: Column) -> Column:
    return F.schema_of_variant(v)


def _g(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant")


def _str(v: Column, path: str) -> Column:
    x = _g(v, path)
    return F.when(_t(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _is_obj(x: Column) -> Column:
    return F.coalesce(_t(x).startswith("OBJECT"), F.lit(False))


def _is_arr(x: Column) -> Column:
    return F.coalesce(_t(x).startswith("ARRAY"), F.lit(False))


def _falsy_or(a: Column, b: Column) -> Column:
    """Python ``a or b`` on two JSON values given as VARIANT."""
    ta = _t(a)
    falsy = (a.isNull() | (ta == "VOID") | (F.try_variant_get(a, "$", "double") == 0)
             | (F.try_variant_get(a, "$", "string") == "")
             | (ta == "BOOLEAN") & ~F.coalesce(F.try_variant_get(a, "$", "boolean"), F.lit(False)))
    return F.when(falsy, b).otherwise(a)


def extract_model(path: Column, req: Column) -> Column:
    """Body ``model`` (a string), else the URL segment after ``/models/`` up
    to ':' or '/'."""
    tail = F.regexp_extract(path, r"/models/([^:/]*)", 1)
    return F.coalesce(_str(req, "$.model"), F.when(F.instr(path, "/models/") > 0, F.nullif(tail, F.lit(""))))


def openai_compatible(req: Column) -> Column:
    """Body is an object with ``model`` and a list ``messages``."""
    return _is_obj(req) & _g(req, "$.model").isNotNull() & _is_arr(_g(req, "$.messages"))


def response_summary(resp: Column) -> dict[str, Column]:
    """text, finish_reason, stop_reason, input_tokens, output_tokens of a
    response body in the OpenAI, Anthropic or Gemini shape (later shapes
    override the text of earlier ones; usage ``a or b``)."""
    ch0 = _g(resp, "$.choices[0]")
    c0 = _g(resp, "$.content[0]")
    cand_txt = _str(resp, "$.candidates[0].content.parts[0].text")
    text = F.coalesce(
        F.when(_is_obj(_g(resp, "$.candidates[0].content.parts[0]")), cand_txt),
        F.when(_is_obj(c0), _str(resp, "$.content[0].text")),
        F.when(_is_obj(ch0), _str(resp, "$.choices[0].message.content")))
    usage = _g(resp, "$.usage")
    gem = _g(resp, "$.usageMetadata")
    tin = F.when(_is_obj(usage), _falsy_or(_g(usage, "$.input_tokens"), _g(usage, "$.prompt_tokens"))) \
        .when(_is_obj(gem), _g(gem, "$.promptTokenCount"))
    tout = F.when(_is_obj(usage), _falsy_or(_g(usage, "$.output_tokens"), _g(usage, "$.completion_tokens"))) \
        .when(_is_obj(gem), _g(gem, "$.candidatesTokenCount"))
    return {
        "text": text,
        "finish_reason": F.when(_is_obj(ch0), F.try_variant_get(ch0, "$.finish_reason", "string")),
        "stop_reason": F.when(_is_obj(c0), F.try_variant_get(resp, "$.stop_reason", "string")),
        "input_tokens": F.try_variant_get(tin, "$", "bigint"),
        "output_tokens": F.try_variant_get(tout, "$", "bigint"),
    }


def error_message(status: Column, resp_text: Column, resp: Column, limit: int | None = None) -> Column:
    """'HTTP <status>: <msg>' for status >= 400, msg = error.message ->
    error (text) -> message -> raw body; whole, or its first ``limit``
    characters."""
    msg = F.coalesce(_str(resp, "$.error.message"), _str(resp, "$.error"), _str(resp, "$.message"), resp_text,
                     F.lit(""))
    full = F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), msg)
    return F.when(status >= 400, full if limit is None else F.substring(full, 1, limit))


def response_tool_calls(provider: Column, resp: Column) -> Column:
    """array<struct<name, arguments (JSON text), id>> in the three response
    shapes (Anthropic content blocks, OpenAI message tool_calls with
    argument text parsed when JSON, Gemini functionCall parts)."""
    elem = "struct<name:string, arguments:string, id:string>"
    blocks = F.try_variant_get(resp, "$.content", "array<variant>")
    anth = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use"),
                       lambda b: F.struct(F.try_variant_get(b, "$.name", "string").alias("name"),
                                          F.coalesce(F.to_json(_g(b, "$.input")), F.lit("{}")).alias("arguments"),
                                          F.try_variant_get(b, "$.id", "string").alias("id")))
    tcs = F.try_variant_get(resp, "$.choices[0].message.tool_calls", "array<variant>")

    def oa_args(tc: Column) -> Column:
        raw = _g(tc, "$.function.arguments")
        s = F.try_variant_get(raw, "$", "string")
        parsed = F.to_json(F.try_parse_json(s))
        return F.when(_t(raw) == "STRING", F.coalesce(parsed, F.to_json(raw))).otherwise(
            F.coalesce(F.to_json(raw), F.lit("{}")))

    oai = F.transform(tcs, lambda tc: F.struct(F.try_variant_get(tc, "$.function.name", "string").alias("name"),
                                               oa_args(tc).alias("arguments"),
                                               F.try_variant_get(tc, "$.id", "string").alias("id")))
    cands = F.try_variant_get(resp, "$.candidates", "array<variant>")
    parts = F.flatten(F.transform(cands, lambda c: F.coalesce(
        F.try_variant_get(c, "$.content.parts", "array<variant>"), F.array().cast("array<variant>"))))
    gem = F.transform(F.filter(parts, lambda p: _g(p, "$.functionCall").isNotNull()),
                      lambda p: F.struct(F.try_variant_get(p, "$.functionCall.name", "string").alias("name"),
                                         F.coalesce(F.to_json(_g(p, "$.functionCall.args")), F.lit("{}"))
                                         .alias("arguments"), F.lit(None).cast("string").alias("id")))
    empty = F.array().cast(f"array<{elem}>")
    return (F.when(provider == "anthropic", F.coalesce(anth, empty))
            .when((provider == "openai") | provider.startswith("openai-compatible:"), F.coalesce(oai, empty))
            .when(provider == "gemini", F.coalesce(gem, empty)).otherwise(empty))


def normalize_llm_calls(calls: DataFrame, forced_provider: str | None = None, error_limit: int | None = None) -> DataFrame:
    """One llm-call row per HTTP call with typed summary columns and the
    step's ``inputs`` / ``outputs`` / ``metadata`` JSON.  Error texts are whole,
    or cut to ``error_limit`` characters."""
    c = calls.select("*", F.try_parse_json("request_body").alias("_req"),
                     F.try_parse_json("response_body").alias("_resp"))
    if forced_provider:
        c = c.withColumn("provider", F.lit(forced_provider.lower()))
    else:
        c = detect_provider(c, "host").withColumnRenamed("provider", "_host_provider")
        c = detect_provider_path(c, "path")
        c = c.withColumn("provider", F.coalesce(
            "_host_provider", "path_provider",
            F.when(openai_compatible(F.col("_req")), F.concat(F.lit("openai-compatible:"), F.col("host")))))
    req, resp = F.col("_req"), F.col("_resp")
    summ = response_summary(resp)
    rl = (F.col("status") == 429) | (
        _is_obj(_g(resp, "$.error")) & (F.try_variant_get(resp, "$.error.code", "bigint") == 429))
    out = c.select(
        "call_id", "host", "method", "path", "provider", "started_at", "ended_at", "status",
        extract_model(F.col("path"), req).alias("model"),
        summ["text"].alias("text"), summ["finish_reason"].alias("finish_reason"),
        summ["stop_reason"].alias("stop_reason"), summ["input_tokens"].alias("input_tokens"),
        summ["output_tokens"].alias("output_tokens"), F.coalesce(rl, F.lit(False)).alias("rate_limited"),
        response_tool_calls(F.coalesce(F.col("provider"), F.lit("")), resp).alias("tool_calls"),
        F.coalesce(F.col("error"), error_message(F.col("status"), F.col("response_body"), resp, error_limit)).alias("error"),
        F.when(_is_arr(_g(req, "$.messages")), F.to_json(_g(req, "$.messages"))).alias("_messages"),
        F.try_variant_get(req, "$.max_tokens", "bigint").alias("_max_tokens"))
    return out.withColumn("name", F.concat(F.coalesce("provider", F.lit("unknown")), F.lit(":"),
                                           F.coalesce("model", F.lit("unknown"))))


def message_tool_calls(messages_json: Column) -> Column:
    """Tool calls already present in a request's messages: Anthropic
    ``tool_use`` content blocks and OpenAI assistant ``tool_calls``."""
    msgs = F.try_variant_get(F.try_parse_json(messages_json), "$", "array<variant>")

    def per_msg(m: Column) -> Column:
        blocks = F.try_variant_get(m, "$.content", "array<variant>")
        a = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use"),
                        lambda b: F.struct(F.try_variant_get(b, "$.name", "string").alias("name"),
                                           F.coalesce(F.to_json(_g(b, "$.input")), F.lit("{}")).alias("arguments"),
                                           F.try_variant_get(b, "$.id", "string").alias("id")))
        tcs = F.try_variant_get(m, "$.tool_calls", "array<variant>")
        o = F.transform(tcs, lambda tc: F.struct(
            F.try_variant_get(tc, "$.function.name", "string").alias("name"),
            F.coalesce(F.to_json(F.try_parse_json(F.try_variant_get(tc, "$.function.arguments", "string"))),
                       F.to_json(_g(tc, "$.function.arguments")), F.lit("{}")).alias("arguments"),
            F.try_variant_get(tc, "$.id", "string").alias("id")))
        empty = F.array().cast("array<struct<name:string, arguments:string, id:string>>")
        return F.concat(F.coalesce(a, empty), F.coalesce(o, empty))

    return F.flatten(F.transform(msgs, per_msg))


def tool_call_frequency(calls: DataFrame, col: str = "tool_calls") -> DataFrame:
    """Tool calls by name (explode + group)."""
    return (calls.select(F.explode(col).alias("tc")).groupBy(F.col("tc.name").alias("tool"))
            .agg(F.count(F.lit(1)).alias("calls")))


def explode_tool_calls(calls: DataFrame, key: str = "call_id", col: str = "tool_calls") -> DataFrame:
    """Table function: one row per tool call (position kept)."""
    return calls.select(key, F.posexplode(col).alias("pos", "tc")).select(
        key, "pos", F.col("tc.name").alias("name"), F.col("tc.arguments").alias("arguments"),
        F.col("tc.id").alias("id"))
