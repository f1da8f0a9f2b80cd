"""Python-worker operators and sidecar readers (rows-only checks plus
unit tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import redact as RD
from ..operators import udf as U
from ..session import scratch_path
from ..sinks import exports as X
from ..sources import sidecars as SC
from ..operators import windows as W
from .catalog import register
from .q_features import ANY_TEXT, HASH_SQL, SPOKEN_SQL
from .q_scalars import duck_redact


@register("sequence_diff")
def q_sequence_diff(fx):
    """difflib alignment of the step names of consecutive traces of a user."""
    return U.sequence_diff(fx.get("ev_steps"), fx.get("ev_pairs"))


@register("redact_json", ["secret_json"], f"""
, clean AS (SELECT doc_id, {duck_redact('text')} AS note, {duck_redact('source')} AS source FROM documents)
SELECT doc_id, '{{"api_key":"[redacted]","note":' || JQ(note) || ',"tokens":"[redacted]","nested":' ||
  '{{"Authorization":"[redacted]","items":[' || JQ(source) || ',{{"password":"[redacted]","keep":1}}]}},"deep":' ||
  '{{"a":{{"b":{{"c":{{"d":{{"e":{{"f":{{"g":{{"h":{{"i":{{"secret":"[redacted]"}}}}}}}}}}}}}}}}}}}}}}' AS payload
FROM clean""")
def q_redact_json(fx):
    """JSON payloads redacted by key name and value pattern, at any depth."""
    s = fx.get("secret_json")
    return s.select("doc_id", RD.redact_json("payload").alias("payload"))


# The bodies of media_calls with their media summed up, in SQL.
SUMMARY = """
, m AS (SELECT *, doc_id % 4 AS shape, to_base64(encode(text)) AS b64,
    '{"_media_summary":true,"media_type":"image/png","size_bytes":' || CAST(strlen(text) AS VARCHAR) ||
    ',"sha256":"' || sha256(text) || '"}' AS summary FROM media_calls),
scrubbed AS (SELECT doc_id, shape, CASE
    WHEN shape = 0 AND length(b64) > 64 THEN replace(body,
      '{"type":"base64","media_type":"image/png","data":"' || b64 || '"}', summary)
    WHEN shape = 1 AND length(b64) + 22 > 64 THEN replace(body, '{"url":"data:image/png;base64,' || b64 || '"}', summary)
    WHEN shape = 2 AND length(b64) > 64 THEN replace(body,
      '{"mimeType":"image/png","data":"' || b64 || '"}', summary)
    ELSE body END AS body FROM m)"""


@register("scrub_media", ["media_calls"], SUMMARY + """
SELECT doc_id, body FROM scrubbed""")
def q_scrub_media(fx):
    """Request bodies whose inline media (the documents) are replaced by
    summaries; remote images stay."""
    return fx.get("media_calls").select("doc_id", U.scrub_media("body").alias("body"))


@register("scrub_media_calls", ["http_calls"], """
SELECT call_id, request_body FROM http_calls""")
def q_scrub_media_calls(fx):
    """Request bodies without media come back as they are."""
    c = fx.get("http_calls")
    return c.select("call_id", U.scrub_media("request_body").alias("request_body"))


@register("captured_inputs", ["media_calls"], SUMMARY + """
SELECT doc_id, CASE shape
  WHEN 0 THEN '{' || replace(substr(body, strpos(body, '"messages":'), length(body) - strpos(body, '"messages":')),
    'sk-' || md5(CAST(doc_id AS VARCHAR)), '[redacted]') || ',"max_tokens":256}'
  WHEN 1 THEN '{' || substr(body, strpos(body, '"messages":'), length(body) - strpos(body, '"messages":')) || ',"stream":true}'
  WHEN 2 THEN '{' || replace(substr(body, strpos(body, '"contents":')), '{"password":"p"}', '{"password":"[redacted]"}')
  ELSE '{"prompt":"use [redacted] now","max_tokens":5}' END AS inputs
FROM scrubbed""")
def q_captured_inputs(fx):
    """What is stored of request bodies: spoken members only, media summed up
    before secrets inside them are redacted."""
    return fx.get("media_calls").select("doc_id", U.captured_inputs("body").alias("inputs"))


@register("attribute_steps", ["ev_steps"], HASH_SQL)
def q_attribute_steps(fx):
    """Feature attribution of llm-call steps with the built-in hash scorer."""
    return U.attribute_steps(fx.get("ev_steps"), "hash")


@register("attribute_steps_scorer", ["ev_steps"], SPOKEN_SQL + f"""
, l AS (SELECT trace_id, step_id, unnest(regexp_extract_all(prompt || response, '[a-z]')) AS letter FROM a WHERE {ANY_TEXT}),
n AS (SELECT trace_id, step_id, letter, count(*) AS n FROM l GROUP BY trace_id, step_id, letter),
k AS (SELECT *, row_number() OVER (PARTITION BY trace_id, step_id ORDER BY n DESC, letter) - 1 AS rank FROM n)
SELECT trace_id, step_id, rank, CAST(ascii(letter) AS BIGINT) AS feature_id, CAST(n AS DOUBLE) AS activation,
  'letters' AS layer FROM k WHERE rank < 3""")
def q_attribute_steps_scorer(fx):
    """Feature attribution of llm-call steps with a user's scorer, one Arrow
    batch at a time.  The scorer is a local function, so it travels by value."""
    def letters(frame):
        """The commonest letters of prompt and response, each a feature by its
        code point with its number as activation."""
        from collections import Counter

        import pandas as pd
        rows = []
        for t, s, text in zip(frame["trace_id"], frame["step_id"], frame["prompt"] + frame["response"]):
            seen = Counter(c for c in text if "a" <= c <= "z")
            best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:3]
            rows += [(t, s, k, ord(c), float(n), "letters") for k, (c, n) in enumerate(best)]
        return pd.DataFrame(rows, columns=["trace_id", "step_id", "rank", "feature_id", "activation", "layer"])

    return U.attribute_steps(fx.get("ev_steps"), letters)


@register("read_annotations", ["ev_annotations"], """
SELECT trace_id, step_id, arg_max(failure_category, seq) AS failure_category, arg_max(severity, seq) AS severity,
  arg_max(notes, seq) AS notes, arg_max(annotator, seq) AS annotator
FROM ev_annotations GROUP BY trace_id, step_id""")
def q_read_annotations(fx):
    """Annotation sidecars (one JSON array per trace) parsed back to rows."""
    a = W.latest_annotations(fx.get("ev_annotations"))
    ann = F.struct("trace_id", "step_id", "failure_category", "notes", "mitigation", "severity",
                   "annotator", "tags", "circuit_attribution")
    files = (a.groupBy("trace_id").agg(F.to_json(F.array_sort(F.collect_list(ann))).alias("text"))
             .select(F.concat(F.lit("annotations/"), "trace_id", F.lit(".json")).alias("file"), "text"))
    return SC.parse_annotations(files).select("trace_id", "step_id", "failure_category", "severity", "notes",
                                              "annotator")


@register("read_corpus", ["ev_traces", "ev_steps", "ev_annotations"], """
, la AS (SELECT DISTINCT trace_id, step_id FROM ev_annotations)
SELECT 'lb-' || substr(la.trace_id, 1, 8) || '-' || substr(la.step_id, 1, 6) AS id, t.framework, 'CC-BY-4.0' AS license
FROM la JOIN ev_steps s ON la.trace_id = s.trace_id AND la.step_id = s.step_id
JOIN ev_traces t ON la.trace_id = t.trace_id""")
def q_read_corpus(fx):
    """Exported corpus lines written to the shared folder and read back by
    the strict corpus reader."""
    path = scratch_path(fx.spark, "corpus")
    corpus = X.export_corpus(fx.get("ev_traces"), fx.get("ev_steps"), W.latest_annotations(fx.get("ev_annotations")))
    corpus.select("record_json").write.text(path)
    return SC.read_corpus(fx.spark, path).select("id", "framework", "license")
