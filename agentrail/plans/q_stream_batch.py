"""Streamed responses assembled in batch: SSE chunks and SDK events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..sources import sse
from .catalog import register


@register("assemble_chunks", ["stream_pieces"], """
SELECT DISTINCT call_id, text FROM stream_pieces""")
def q_assemble_chunks(fx):
    """SSE chunk lines of every streamed reply assembled back into its text."""
    return sse.assemble_chunks(fx.get("stream_chunks")).select("call_id", "text")


@register("sse_text", ["stream_pieces"], """
SELECT DISTINCT call_id, text FROM stream_pieces""")
def q_sse_text(fx):
    """Whole SSE bodies (one text per call) reduced to their text."""
    c = fx.get("stream_chunks")
    body = (c.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))),
                                                                lambda x: x["line"]), "\n").alias("body")))
    return body.select("call_id", TX.sse_text("body").alias("text"))


@register("accumulate_stream_events", ["stream_pieces"], """
SELECT DISTINCT call_id, provider, text, CAST(n_chars AS BIGINT) AS input_tokens, CAST(n_pieces AS BIGINT) AS output_tokens,
  CASE provider WHEN 'anthropic' THEN 'end_turn' WHEN 'openai' THEN 'stop' ELSE 'STOP' END AS stop_reason
FROM stream_pieces""")
def q_accumulate_stream_events(fx):
    """SDK stream events folded into text, token counts and stop reason."""
    return sse.accumulate_stream_events(fx.get("stream_events"))
