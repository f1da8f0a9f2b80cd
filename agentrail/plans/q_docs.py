"""Trace documents: validation (schema and ingest rules) and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import documents as D
from .catalog import register
from .fixtures import AS_OF

NUM = "('BIGINT', 'UBIGINT', 'DOUBLE')"
BAD_ID = r"regexp_matches({x}, '[/\\\x00\n\r\t]')"


def _safe_id_err(x: str, label_sql: str) -> str:
    return (f"CASE WHEN coalesce(length({x}), 0) = 0 THEN {label_sql} || ' must be non-empty' "
            f"WHEN length({x}) > 128 THEN {label_sql} || ' exceeds 128 chars' "
            f"WHEN {BAD_ID.format(x=x)} THEN {label_sql} || ' contains a forbidden character (path separator, null, control)' "
            f"WHEN starts_with({x}, '.') THEN {label_sql} || ' cannot be ''.'', ''..'' or hidden-dotfile-style' END")


def _truthy(t: str, x: str) -> str:
    return (f"(CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN false WHEN {t} = 'BOOLEAN' THEN {x} = 'true' "
            f"WHEN {t} IN {NUM} THEN TRY_CAST({x} AS DOUBLE) <> 0 WHEN {t} = 'VARCHAR' THEN length({x}) > 0 "
            f"ELSE {x} NOT IN ('[]', '{{}}') END)")


DOC_COLS = """
, d AS (SELECT doc_id, doc, json_type(doc) AS t,
    json_type(doc, '$.name') AS tn, json_extract_string(doc, '$.name') AS nm,
    json_type(doc, '$.steps') AS ts, json_type(doc, '$.trace_id') AS tt, json_extract_string(doc, '$.trace_id') AS tid,
    json_type(doc, '$.framework') AS tf, json_extract_string(doc, '$.framework') AS fw,
    json_type(doc, '$.metadata') AS tm, json_extract_string(doc, '$.metadata') AS md,
    json_type(doc, '$.metadata.failed') AS tmf, json_type(doc, '$.metadata.error') AS tme,
    json_type(doc, '$.started_at') AS tsa, json_extract_string(doc, '$.started_at') AS sa,
    json_type(doc, '$.ended_at') AS tea, json_extract_string(doc, '$.ended_at') AS ea
  FROM trace_docs),
st0 AS (SELECT doc_id, doc, unnest(generate_series(0, CAST(coalesce(json_array_length(doc, '$.steps'), 0) AS BIGINT) - 1)) AS idx
        FROM trace_docs WHERE json_type(doc, '$.steps') = 'ARRAY'),
st AS (SELECT doc_id, doc, idx, json_extract(doc, '$.steps[' || idx || ']') AS s FROM st0),
sx AS (SELECT doc_id, doc, idx, s, json_type(s) AS t,
    json_type(s, '$.kind') AS tk, json_extract_string(s, '$.kind') AS kind,
    json_type(s, '$.name') AS tn, json_extract_string(s, '$.name') AS nm,
    json_type(s, '$.step_id') AS ti, json_extract_string(s, '$.step_id') AS sid,
    json_type(s, '$.parent_step_id') AS tp, json_type(s, '$.started_at') AS tsa,
    json_extract_string(s, '$.started_at') AS sa, json_type(s, '$.ended_at') AS tea,
    json_extract_string(s, '$.ended_at') AS ea, json_type(s, '$.inputs') AS tin, json_type(s, '$.outputs') AS tout,
    json_type(s, '$.metadata') AS tmd, json_type(s, '$.error') AS terr
  FROM st)"""

INGEST_ERRORS = DOC_COLS + f""",
he AS (SELECT doc_id, CASE
    WHEN t IS DISTINCT FROM 'OBJECT' THEN 'trace payload must be a JSON object'
    WHEN tn IS DISTINCT FROM 'VARCHAR' OR length(nm) = 0 THEN 'trace.name is required and must be a non-empty string'
    WHEN ts IS DISTINCT FROM 'ARRAY' THEN 'trace.steps must be a list (may be empty)'
    WHEN {_truthy('tt', 'tid')} AND ({_safe_id_err('tid', "'trace_id'")}) IS NOT NULL
      THEN {_safe_id_err('tid', "'trace_id'")}
    WHEN {_truthy('tsa', 'sa')} AND tsa NOT IN {NUM} AND tsa <> 'BOOLEAN' AND TRY_CAST(sa AS DOUBLE) IS NULL
      THEN 'trace.started_at must be a number'
    WHEN tea IS NOT NULL AND tea <> 'NULL' AND tea NOT IN {NUM} AND tea <> 'BOOLEAN' AND TRY_CAST(ea AS DOUBLE) IS NULL
      THEN 'trace.ended_at must be a number'
    WHEN {_truthy('tm', 'md')} AND tm <> 'OBJECT' THEN 'trace.metadata must be an object'
  END AS e FROM d),
se AS (SELECT doc_id, idx, CASE
    WHEN t IS DISTINCT FROM 'OBJECT' THEN 'steps[' || idx || '] must be an object'
    WHEN tk IS DISTINCT FROM 'VARCHAR' OR length(kind) = 0 THEN 'steps[' || idx || '].kind must be a non-empty string'
    WHEN length(kind) > 64 THEN 'steps[' || idx || '].kind exceeds 64 chars'
    WHEN tn IS DISTINCT FROM 'VARCHAR' OR length(nm) = 0 THEN 'steps[' || idx || '].name is required'
    WHEN {_truthy('ti', 'sid')} AND ({_safe_id_err('sid', "'steps[' || idx || '].step_id'")}) IS NOT NULL
      THEN {_safe_id_err('sid', "'steps[' || idx || '].step_id'")}
  END AS e FROM sx),
ve AS (SELECT he.doc_id, coalesce(he.e, s1.e) AS error FROM he
       LEFT JOIN (SELECT doc_id, arg_min(e, idx) AS e FROM se WHERE e IS NOT NULL GROUP BY doc_id) s1
       ON he.doc_id = s1.doc_id)"""

SCHEMA_ERRORS = DOC_COLS + f""",
he AS (SELECT doc_id, CASE
    WHEN t IS DISTINCT FROM 'OBJECT' THEN '$: must be an object'
    WHEN tn IS NULL THEN '$: ''name'' is a required property'
    WHEN ts IS NULL THEN '$: ''steps'' is a required property'
    WHEN tt IS NOT NULL AND tt <> 'VARCHAR' THEN '$.trace_id: must be a string'
    WHEN length(tid) < 1 THEN '$.trace_id: shorter than 1'
    WHEN length(tid) > 128 THEN '$.trace_id: longer than 128'
    WHEN tn <> 'VARCHAR' THEN '$.name: must be a string'
    WHEN length(nm) < 1 THEN '$.name: shorter than 1'
    WHEN length(nm) > 256 THEN '$.name: longer than 256'
    WHEN tf IS NOT NULL AND tf NOT IN ('VARCHAR', 'NULL') THEN '$.framework: must be a string or null'
    WHEN tf = 'VARCHAR' AND length(fw) > 64 THEN '$.framework: longer than 64'
    WHEN tsa IS NOT NULL AND tsa NOT IN {NUM} THEN '$.started_at: must be a number'
    WHEN tea IS NOT NULL AND tea NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL') THEN '$.ended_at: must be a number or null'
    WHEN tm IS NOT NULL AND tm <> 'OBJECT' THEN '$.metadata: must be an object'
    WHEN tmf IS NOT NULL AND tmf <> 'BOOLEAN' THEN '$.metadata.failed: must be a boolean'
    WHEN tme IS NOT NULL AND tme <> 'VARCHAR' THEN '$.metadata.error: must be a string'
    WHEN ts <> 'ARRAY' THEN '$.steps: must be an array'
  END AS e FROM d),
se AS (SELECT doc_id, idx, CASE
    WHEN t IS DISTINCT FROM 'OBJECT' THEN '$.steps[' || idx || ']: must be an object'
    WHEN tk IS NULL THEN '$.steps[' || idx || ']: ''kind'' is a required property'
    WHEN tn IS NULL THEN '$.steps[' || idx || ']: ''name'' is a required property'
    WHEN ti IS NOT NULL AND ti <> 'VARCHAR' THEN '$.steps[' || idx || '].step_id: must be a string'
    WHEN length(sid) < 1 THEN '$.steps[' || idx || '].step_id: shorter than 1'
    WHEN length(sid) > 128 THEN '$.steps[' || idx || '].step_id: longer than 128'
    WHEN tp IS NOT NULL AND tp NOT IN ('VARCHAR', 'NULL') THEN '$.steps[' || idx || '].parent_step_id: must be a string or null'
    WHEN tk <> 'VARCHAR' THEN '$.steps[' || idx || '].kind: must be a string'
    WHEN length(kind) < 1 THEN '$.steps[' || idx || '].kind: shorter than 1'
    WHEN length(kind) > 64 THEN '$.steps[' || idx || '].kind: longer than 64'
    WHEN tn <> 'VARCHAR' THEN '$.steps[' || idx || '].name: must be a string'
    WHEN length(nm) < 1 THEN '$.steps[' || idx || '].name: shorter than 1'
    WHEN length(nm) > 256 THEN '$.steps[' || idx || '].name: longer than 256'
    WHEN tsa IS NOT NULL AND tsa NOT IN {NUM} THEN '$.steps[' || idx || '].started_at: must be a number'
    WHEN tea IS NOT NULL AND tea NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL') THEN '$.steps[' || idx || '].ended_at: must be a number or null'
    WHEN tin IS NOT NULL AND tin <> 'OBJECT' THEN '$.steps[' || idx || '].inputs: must be an object'
    WHEN tout IS NOT NULL AND tout <> 'OBJECT' THEN '$.steps[' || idx || '].outputs: must be an object'
    WHEN tmd IS NOT NULL AND tmd <> 'OBJECT' THEN '$.steps[' || idx || '].metadata: must be an object'
    WHEN terr IS NOT NULL AND terr NOT IN ('VARCHAR', 'NULL') THEN '$.steps[' || idx || '].error: must be a string or null'
  END AS e FROM sx),
ve AS (SELECT he.doc_id, coalesce(he.e, s1.e) AS error FROM he
       LEFT JOIN (SELECT doc_id, arg_min(e, idx) AS e FROM se WHERE e IS NOT NULL GROUP BY doc_id) s1
       ON he.doc_id = s1.doc_id)"""


@register("validate_documents", ["trace_docs"], SCHEMA_ERRORS + """
SELECT doc_id, error IS NULL AS ok, error FROM ve""")
def q_validate_documents(fx):
    """Schema validation of trace documents (first error per document)."""
    return D.validate(fx.get("trace_docs"), mode="schema")


@register("validate_ingest", ["trace_docs"], INGEST_ERRORS + """
SELECT doc_id, error IS NULL AS ok, error FROM ve""")
def q_validate_ingest(fx):
    """Ingest-rule validation of trace documents."""
    return D.validate(fx.get("trace_docs"), mode="ingest")


INGEST_TRACES_SQL = INGEST_ERRORS + f"""
SELECT d.doc_id,
  CASE WHEN {_truthy('d.tt', 'd.tid')} THEN d.tid ELSE substr(sha256(d.doc), 1, 32) END AS trace_id,
  d.nm AS name, d.fw AS framework,
  CASE WHEN {_truthy('d.tsa', 'd.sa')} THEN CAST(d.sa AS DOUBLE) ELSE {AS_OF} END AS started_at,
  CASE WHEN d.tea IS NOT NULL AND d.tea <> 'NULL' THEN CAST(d.ea AS DOUBLE) ELSE {AS_OF} END AS ended_at
FROM d JOIN ve ON d.doc_id = ve.doc_id WHERE ve.error IS NULL"""


@register("ingest_documents", ["trace_docs"], INGEST_TRACES_SQL)
def q_ingest_documents(fx):
    """Accepted documents as trace headers with defaults filled."""
    t, _, _ = D.ingest(fx.get("trace_docs"), AS_OF)
    return t.select("doc_id", "trace_id", "name", "framework", "started_at", "ended_at")


@register("ingest_steps", ["trace_docs"], INGEST_ERRORS + f""",
tr AS (SELECT d.doc_id,
    CASE WHEN {_truthy('d.tt', 'd.tid')} THEN d.tid ELSE substr(sha256(d.doc), 1, 32) END AS trace_id,
    CASE WHEN {_truthy('d.tsa', 'd.sa')} THEN CAST(d.sa AS DOUBLE) ELSE {AS_OF} END AS ts
  FROM d JOIN ve ON d.doc_id = ve.doc_id WHERE ve.error IS NULL),
s2 AS (SELECT tr.trace_id, sx.*, CASE WHEN {_truthy('sx.tsa', 'sx.sa')} THEN CAST(sx.sa AS DOUBLE) ELSE tr.ts END AS st
       FROM sx JOIN tr ON sx.doc_id = tr.doc_id)
SELECT trace_id,
  CASE WHEN {_truthy('ti', 'sid')} THEN sid ELSE substr(sha256(doc || '#' || CAST(idx AS VARCHAR)), 1, 12) END AS step_id,
  CAST(idx AS BIGINT) AS step_index, kind, nm AS name, st AS started_at,
  CASE WHEN tea IS NOT NULL AND tea <> 'NULL' THEN CAST(ea AS DOUBLE) ELSE st END AS ended_at,
  json_extract_string(s, '$.error') AS error
FROM s2""")
def q_ingest_steps(fx):
    """Steps of accepted documents with defaults and stable generated ids."""
    _, s, _ = D.ingest(fx.get("trace_docs"), AS_OF)
    return s.select("trace_id", "step_id", F.col("step_index").cast("bigint").alias("step_index"),
                    "kind", "name", "started_at", "ended_at", "error")


@register("safe_id", ["ev_steps"], r"""
SELECT step_id, trace_id,
  (length(trace_id) BETWEEN 1 AND 128 AND NOT regexp_matches(trace_id, '[/\\\x00\n\r\t]')
   AND NOT starts_with(trace_id, '.')) AS trace_id_ok,
  (length(name) BETWEEN 1 AND 128 AND NOT regexp_matches(name, '[/\\\x00\n\r\t]')
   AND NOT starts_with(name, '.')) AS name_ok
FROM ev_steps""")
def q_safe_id(fx):
    """Whether ids (and, as a probe, step names) are safe file-name components."""
    s = fx.get("ev_steps")
    return s.select("step_id", "trace_id", D.safe_id(F.col("trace_id")).alias("trace_id_ok"),
                    D.safe_id(F.col("name")).alias("name_ok"))
