"""Streamed LLM responses: chunk lines and SDK stream events -> one call.

Both inputs are long tables keyed by ``call_id`` with a ``seq`` order.
Assembly is an ordered string aggregate per call (bounded by one
response); token counts and reasons are "last non-null by seq", i.e.
``max_by(value, seq)`` over the non-null rows - plain hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sse_payload, sse_piece


def _ordered_concat(piece: str, order: str = "seq") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(piece)))),
                                    lambda x: x[piece]), "")


def _last(col: str, order: str = "seq") -> Column:
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """(call_id, seq, line) -> (call_id, text, chunks): text deltas of all
    stream lines concatenated in ``seq`` order."""
    c = chunks.select("call_id", "seq", sse_piece("line").alias("_piece"),
                      sse_payload("line").isNotNull().alias("_data"))
    return c.groupBy("call_id").agg(_ordered_concat("_piece").alias("text"),
                                    F.count(F.when(F.col("_data"), 1)).alias("chunks"))


def accumulate_stream_events(events: DataFrame) -> DataFrame:
    """(call_id, seq, provider, event JSON) -> per call: text, input and
    output tokens, stop / finish reason.

    Anthropic: text of ``content_block_delta`` text deltas, input tokens
    from ``message_start``, output tokens and stop reason from the last
    ``message_delta`` carrying them.  OpenAI: ``choices[0].delta.content``
    text, last non-null usage and finish reason.  Gemini: parts text, last
    ``usageMetadata`` and ``finishReason``."""
    v = F.try_parse_json("event")
    e = events.select("call_id", "seq", "provider", v.alias("_v"))
    et = F.try_variant_get(F.col("_v"), "$.type", "string")
    prov = F.col("provider")

    def g(path: str, typ: str = "string") -> Column:
        return F.try_variant_get(F.col("_v"), path, typ)

    anth_piece = F.when((et == "content_block_delta") & (g("$.delta.type") == "text_delta"), g("$.delta.text"))
    oai_piece = g("$.choices[0].delta.content")
    gem_piece = F.array_join(F.transform(g("$.candidates[0].content.parts", "array<variant>"),
                                         lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    piece = (F.when(prov == "anthropic", anth_piece).when(prov == "openai", oai_piece)
             .when(prov == "gemini", gem_piece))
    tin = (F.when(prov == "anthropic", F.when(et == "message_start", g("$.message.usage.input_tokens", "bigint")))
           .when(prov == "openai", g("$.usage.prompt_tokens", "bigint"))
           .when(prov == "gemini", g("$.usageMetadata.promptTokenCount", "bigint")))
    tout = (F.when(prov == "anthropic", F.when(et == "message_delta", g("$.usage.output_tokens", "bigint")))
            .when(prov == "openai", g("$.usage.completion_tokens", "bigint"))
            .when(prov == "gemini", g("$.usageMetadata.candidatesTokenCount", "bigint")))
    reason = (F.when(prov == "anthropic", F.when(et == "message_delta", g("$.delta.stop_reason")))
              .when(prov == "openai", g("$.choices[0].finish_reason"))
              .when(prov == "gemini", g("$.candidates[0].finishReason")))
    x = e.select("call_id", "seq", "provider", F.coalesce(piece, F.lit("")).alias("_piece"),
                 tin.alias("_in"), tout.alias("_out"), reason.alias("_reason"))
    return x.groupBy("call_id", "provider").agg(
        _ordered_concat("_piece").alias("text"), _last("_in").alias("input_tokens"),
        _last("_out").alias("output_tokens"), _last("_reason").alias("stop_reason"))
