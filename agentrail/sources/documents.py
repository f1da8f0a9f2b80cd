"""Trace documents (a header object with a nested ``steps`` array):
validation in two modes and ingest into the trace / step tables.

Input: a DataFrame with ``doc_id`` and ``doc`` (JSON text, one document
per row).  Type tests use VARIANT type names, so ``5`` and ``"5"`` differ.
Every rule is a column expression on the document's own row, the steps'
rules too (over its step array), so a verdict belongs to its row even where
``doc_id`` repeats, and validation shuffles nothing.  A rule sees only the
members it tests, taken from the parsed document in one cast: a VARIANT taken
from a VARIANT is built anew, with all that lies below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published rules.
MAX_ID_LENGTH = 128
MAX_KIND_LENGTH = 64
MAX_NAME_LENGTH = 256
MAX_FRAMEWORK_LENGTH = 64
FORBIDDEN_ID_CHARS = r"[/\\\x00\n\r\t]"


_TYPE_NAMES = {"STRING": "string", "BIGINT": "number", "INT": "number", "SMALLINT": "number",
               "TINYINT": "number", "DOUBLE": "number", "FLOAT": "number", "DECIMAL": "number",
               "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}


def _t(v: Column) -> Column:
    """JSON type of a VARIANT: string / number / boolean / null / object /
    array; 'absent' when the key is missing (so every test is null-safe).
    One ``schema_of_variant`` call, mapped through a literal lookup."""
    base = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    names = F.create_map(*[F.lit(x) for kv in _TYPE_NAMES.items() for x in kv])
    return F.when(v.isNull(), F.lit("absent")).otherwise(F.coalesce(F.element_at(names, base), F.lit("other")))


# JSON text of null, false, zero and what is empty.
_FALSY = r'^(null|false|""|\[\]|\{\}|-?0(\.0*)?(E-?[0-9]+)?)$'


def _is_obj(v: Column) -> Column:
    """Object test by a cast that leaves the members where they are."""
    return F.try_variant_get(v, "$", "struct<x:boolean>").isNotNull()


def _members(*names: str) -> str:
    """Type of an object cast to some of its members, each a VARIANT."""
    return "struct<" + ",".join(f"{n}:variant" for n in names) + ">"


_HEAD = _members("trace_id", "name", "framework", "started_at", "ended_at", "metadata")
_STEP = _members("step_id", "parent_step_id", "kind", "name", "started_at", "ended_at",
                 "inputs", "outputs", "metadata", "error")
#: What the rules of a mode test of a step.
_JUDGED_STEP = {"schema": _STEP, "ingest": _members("step_id", "kind", "name")}


def _str(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _first_error(checks: list[tuple[Column, str]]) -> Column:
    """First message whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(msg) if isinstance(msg, str) else msg).otherwise(out)
    return out


def safe_id_error(value: Column, label) -> Column:
    """Error text for an id that cannot be a file name component, else null."""
    lab = F.lit(label) if isinstance(label, str) else label
    return (F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.concat(lab, F.lit(" must be non-empty")))
            .when(F.length(value) > MAX_ID_LENGTH, F.concat(lab, F.lit(f" exceeds {MAX_ID_LENGTH} chars")))
            .when(value.rlike(FORBIDDEN_ID_CHARS),
                  F.concat(lab, F.lit(" contains a forbidden character (path separator, null, control)")))
            .when(value.startswith("."),
                  F.concat(lab, F.lit(" cannot be '.', '..' or hidden-dotfile-style"))))


def safe_id(value: Column) -> Column:
    """True for an id usable as a file name component."""
    return safe_id_error(value, "id").isNull()


def _truthy_variant(v: Column) -> Column:
    """Python's truth of a value, from its JSON text: one short expression, so
    that a projection of many stays a method that the JVM compiles."""
    return F.coalesce(~F.to_json(v).rlike(_FALSY), F.lit(False))


def _head_rules(v: Column, h: Column, steps: Column, mode: str) -> list:
    """Rules of the header, in the order in which they are reported: ``v`` is
    the document, ``h`` its members (null if it is no object), ``steps`` its
    steps (null if they are no list)."""
    name, tid, fw = h["name"], h["trace_id"], h["framework"]
    st, en, md = h["started_at"], h["ended_at"], h["metadata"]
    if mode == "schema":
        failed, error = (F.variant_get(md, f"$.{k}", "variant") for k in ("failed", "error"))
        return [
            (h.isNull(), "$: must be an object"),
            (name.isNull(), "$: 'name' is a required property"),
            (steps.isNull() & F.variant_get(v, "$.steps", "variant").isNull(),
             "$: 'steps' is a required property"),
            (tid.isNotNull() & (_t(tid) != "string"), "$.trace_id: must be a string"),
            (F.length(_str(tid)) < 1, "$.trace_id: shorter than 1"),
            (F.length(_str(tid)) > MAX_ID_LENGTH, f"$.trace_id: longer than {MAX_ID_LENGTH}"),
            (_t(name) != "string", "$.name: must be a string"),
            (F.length(_str(name)) < 1, "$.name: shorter than 1"),
            (F.length(_str(name)) > MAX_NAME_LENGTH, f"$.name: longer than {MAX_NAME_LENGTH}"),
            (fw.isNotNull() & ~_t(fw).isin("string", "null"), "$.framework: must be a string or null"),
            (F.length(_str(fw)) > MAX_FRAMEWORK_LENGTH, f"$.framework: longer than {MAX_FRAMEWORK_LENGTH}"),
            (st.isNotNull() & (_t(st) != "number"), "$.started_at: must be a number"),
            (en.isNotNull() & ~_t(en).isin("number", "null"), "$.ended_at: must be a number or null"),
            (md.isNotNull() & ~_is_obj(md), "$.metadata: must be an object"),
            (failed.isNotNull() & (_t(failed) != "boolean"), "$.metadata.failed: must be a boolean"),
            (error.isNotNull() & (_t(error) != "string"), "$.metadata.error: must be a string"),
            (steps.isNull(), "$.steps: must be an array"),
        ]
    return [
        (h.isNull(), "trace payload must be a JSON object"),
        ((_t(name) != "string") | (F.length(_str(name)) == 0),
         "trace.name is required and must be a non-empty string"),
        (steps.isNull(), "trace.steps must be a list (may be empty)"),
        (_truthy_variant(tid), safe_id_error(F.coalesce(_str(tid), F.to_json(tid)), "trace_id")),
        (_truthy_variant(st) & ~_t(st).isin("number", "boolean")
         & _str(st).try_cast("double").isNull(), "trace.started_at must be a number"),
        (en.isNotNull() & (_t(en) != "null") & ~_t(en).isin("number", "boolean")
         & _str(en).try_cast("double").isNull(), "trace.ended_at must be a number"),
        (_truthy_variant(md) & ~_is_obj(md), "trace.metadata must be an object"),
    ]


def _step_rules(sv: Column, place: Column, mode: str) -> list:
    """Rules of one step at ``place``, in the order in which they are reported:
    ``sv`` is its members, null if it is no object."""
    idx = place.cast("string")
    loc = F.concat(F.lit("steps["), idx, F.lit("]"))
    kind, sname, sid = sv["kind"], sv["name"], sv["step_id"]
    if mode == "schema":
        p = F.concat(F.lit("$.steps["), idx, F.lit("]"))
        return [
            (sv.isNull(), F.concat(p, F.lit(": must be an object"))),
            (kind.isNull(), F.concat(p, F.lit(": 'kind' is a required property"))),
            (sname.isNull(), F.concat(p, F.lit(": 'name' is a required property"))),
            (sid.isNotNull() & (_t(sid) != "string"), F.concat(p, F.lit(".step_id: must be a string"))),
            (F.length(_str(sid)) < 1, F.concat(p, F.lit(".step_id: shorter than 1"))),
            (F.length(_str(sid)) > MAX_ID_LENGTH, F.concat(p, F.lit(f".step_id: longer than {MAX_ID_LENGTH}"))),
            (sv["parent_step_id"].isNotNull() & ~_t(sv["parent_step_id"]).isin("string", "null"),
             F.concat(p, F.lit(".parent_step_id: must be a string or null"))),
            (_t(kind) != "string", F.concat(p, F.lit(".kind: must be a string"))),
            (F.length(_str(kind)) < 1, F.concat(p, F.lit(".kind: shorter than 1"))),
            (F.length(_str(kind)) > MAX_KIND_LENGTH, F.concat(p, F.lit(f".kind: longer than {MAX_KIND_LENGTH}"))),
            (_t(sname) != "string", F.concat(p, F.lit(".name: must be a string"))),
            (F.length(_str(sname)) < 1, F.concat(p, F.lit(".name: shorter than 1"))),
            (F.length(_str(sname)) > MAX_NAME_LENGTH, F.concat(p, F.lit(f".name: longer than {MAX_NAME_LENGTH}"))),
            (sv["started_at"].isNotNull() & (_t(sv["started_at"]) != "number"),
             F.concat(p, F.lit(".started_at: must be a number"))),
            (sv["ended_at"].isNotNull() & ~_t(sv["ended_at"]).isin("number", "null"),
             F.concat(p, F.lit(".ended_at: must be a number or null"))),
        ] + [
            (sv[k].isNotNull() & ~_is_obj(sv[k]),
             F.concat(p, F.lit(f".{k}: must be an object"))) for k in ("inputs", "outputs", "metadata")
        ] + [
            (sv["error"].isNotNull() & ~_t(sv["error"]).isin("string", "null"),
             F.concat(p, F.lit(".error: must be a string or null"))),
        ]
    return [
        (sv.isNull(), F.concat(loc, F.lit(" must be an object"))),
        ((_t(kind) != "string") | (F.length(_str(kind)) == 0),
         F.concat(loc, F.lit(".kind must be a non-empty string"))),
        (F.length(_str(kind)) > MAX_KIND_LENGTH, F.concat(loc, F.lit(f".kind exceeds {MAX_KIND_LENGTH} chars"))),
        ((_t(sname) != "string") | (F.length(_str(sname)) == 0), F.concat(loc, F.lit(".name is required"))),
        (_truthy_variant(sid), safe_id_error(F.coalesce(_str(sid), F.to_json(sid)),
                                             F.concat(loc, F.lit(".step_id")))),
    ]


def _judged(docs: DataFrame, mode: str) -> DataFrame:
    """``docs`` (doc_id, doc) with ``_v``, the document parsed once, ``_h``, its
    header's members, and ``error``, the message of the first failing rule or
    null."""
    if mode not in ("schema", "ingest"):
        raise ValueError(f"unknown mode {mode!r}")
    v, h, s = F.col("_v"), F.col("_h"), F.col("_s")
    docs = (docs.select("doc_id", "doc", F.try_parse_json("doc").alias("_v"))
            .select("*", F.try_variant_get(v, "$", _HEAD).alias("_h"),
                    F.try_variant_get(v, "$.steps", f"array<{_JUDGED_STEP[mode]}>").alias("_s")))
    found = F.filter(F.transform(s, lambda x, i: _first_error(_step_rules(x, i, mode))), lambda e: e.isNotNull())
    return docs.select("doc_id", "doc", "_v", "_h", F.coalesce(_first_error(_head_rules(v, h, s, mode)),
                                                               F.get(found, F.lit(0))).alias("error"))


def validate(docs: DataFrame, mode: str = "schema") -> DataFrame:
    """(doc_id, ok, error) for every document; the first failing rule wins.

    ``mode='schema'``: the published JSON schema (name 1..256, framework
    <= 64, ids 1..128, kind 1..64, step name 1..256, numbers / objects
    typed).  ``mode='ingest'``: the looser ingest rules (no length limit
    on names, metadata must be an object only when truthy, ids must be
    safe file names, numeric times must parse).  Rows that repeat a
    ``doc_id`` are judged each on its own."""
    return _judged(docs, mode).select("doc_id", F.col("error").isNull().alias("ok"), "error")


def ingest(docs: DataFrame, as_of: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traces, steps, rejects) from trace documents.

    Defaults: trace_id = sha256 of the document (first 32 hex) when
    missing, so a retried batch produces the same ids; started_at (0 or
    missing) -> ``as_of``; ended_at null / missing -> ``as_of``; a step's
    start -> the trace start; its end -> its start; step_id -> sha256 of
    document and position (first 12 hex).  Payload objects are kept as
    their original JSON text (key order preserved), compacted."""
    judged = _judged(docs, mode="ingest")

    def held(*columns: str) -> DataFrame:
        # a generator holds the verdict, so that the filters stay above it and do
        # not repeat the parse inside every rule
        return judged.select(F.inline(F.array(F.struct(*columns, "error"))))

    accepted = F.col("error").isNull()
    rejects = held("doc_id").filter(~accepted).select("doc_id", "error")
    h = F.col("_h")

    def num(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$", "double"), _str(x).try_cast("double"))

    tid = F.coalesce(F.when(_truthy_variant(h["trace_id"]), F.coalesce(_str(h["trace_id"]),
                                                                       F.to_json(h["trace_id"]))),
                     F.substring(F.sha2(F.col("doc"), 256), 1, 32))
    start = F.when(_truthy_variant(h["started_at"]), num(h["started_at"])).otherwise(F.lit(float(as_of)))
    end = F.when(h["ended_at"].isNotNull() & (_t(h["ended_at"]) != "null"),
                 num(h["ended_at"])).otherwise(F.lit(float(as_of)))
    md = F.when(_truthy_variant(h["metadata"]),
                F.from_json("doc", "metadata string")["metadata"]).otherwise(F.lit("{}"))
    traces = held("doc_id", "doc", "_h").filter(accepted).select(
        "doc_id", tid.alias("trace_id"), _str(h["name"]).alias("name"), _str(h["framework"]).alias("framework"),
        start.alias("started_at"), end.alias("ended_at"), md.alias("metadata"))
    # one explode yields each step's members as VARIANT (for types) and as raw payload text
    raw_ddl = "steps array<struct<inputs:string, outputs:string, metadata:string>>"
    zipped = F.arrays_zip(F.try_variant_get("_v", "$.steps", f"array<{_STEP}>").alias("s"),
                          F.from_json("doc", raw_ddl)["steps"].alias("r"))
    s = (held("doc", "_v", "_h").filter(accepted)
         .select("doc", tid.alias("trace_id"), start.alias("_ts"), F.posexplode(zipped).alias("idx", "_z"))
         .select("doc", "trace_id", "_ts", "idx", F.col("_z.s").alias("s"), F.col("_z.r").alias("r")))
    sv = F.col("s")

    s_start = F.when(_truthy_variant(sv["started_at"]), num(sv["started_at"])).otherwise(F.col("_ts"))
    s = s.withColumn("_start", s_start)
    s_end = F.when(sv["ended_at"].isNotNull() & (_t(sv["ended_at"]) != "null"),
                   num(sv["ended_at"])).otherwise(F.col("_start"))
    sid = F.coalesce(F.when(_truthy_variant(sv["step_id"]), F.coalesce(_str(sv["step_id"]),
                                                                        F.to_json(sv["step_id"]))),
                     F.substring(F.sha2(F.concat(F.col("doc"), F.lit("#"), F.col("idx").cast("string")), 256),
                                 1, 12))

    def obj(key: str) -> Column:
        return F.when(_truthy_variant(sv[key]), F.col(f"r.{key}")).otherwise(F.lit("{}"))

    steps = s.select("trace_id", sid.alias("step_id"), F.col("idx").cast("int").alias("step_index"),
                     _str(sv["parent_step_id"]).alias("parent_step_id"), _str(sv["kind"]).alias("kind"),
                     _str(sv["name"]).alias("name"), F.col("_start").alias("started_at"),
                     s_end.alias("ended_at"), obj("inputs").alias("inputs"),
                     obj("outputs").alias("outputs"), obj("metadata").alias("metadata"),
                     _str(sv["error"]).alias("error"))
    return traces, steps, rejects
