"""Exports: flat analytics rows, OpenTelemetry spans, benchmark corpus
records, leaderboard, per-trace documents and markdown case files.

Per-trace outputs (resource spans, documents, case files) aggregate the
steps of one trace with ``collect_list`` + ``array_sort``; a trace is
bounded in size (KB), and traces spread over all tasks by ``trace_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import payload as P
from ..functions.jsontext import json_compact, json_number, json_string
from ..operators.stats import failed_flag

FLAT_SCHEMA = T.StructType([
    T.StructField("trace_id", T.StringType()), T.StructField("trace_name", T.StringType()),
    T.StructField("trace_framework", T.StringType()), T.StructField("trace_failed", T.BooleanType()),
    T.StructField("trace_started_at", T.DoubleType()), T.StructField("trace_ended_at", T.DoubleType()),
    T.StructField("step_id", T.StringType()), T.StructField("step_index", T.IntegerType()),
    T.StructField("step_kind", T.StringType()), T.StructField("step_name", T.StringType()),
    T.StructField("step_started_at", T.DoubleType()), T.StructField("step_ended_at", T.DoubleType()),
    T.StructField("duration_ms", T.DoubleType()), T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()), T.StructField("finish_reason", T.StringType()),
    T.StructField("http_status", T.LongType()), T.StructField("rate_limited", T.BooleanType()),
    T.StructField("error", T.StringType()), T.StructField("inputs_json", T.StringType()),
    T.StructField("outputs_json", T.StringType()),
])


def vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def safe_int_v(v: Column) -> Column:
    """Integer of a JSON value (VARIANT): booleans -> null, integers kept,
    floats truncated, integer text parsed, anything else null."""
    t = vtype(v)
    s = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull() | (t == "BOOLEAN") | (t == "VOID"), F.lit(None).cast("bigint"))
            .when(t == "STRING", F.when(s.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(s).try_cast("bigint")))
            .when(t == "BIGINT", F.try_variant_get(v, "$", "bigint"))
            .otherwise(F.try_variant_get(v, "$", "double").try_cast("bigint")))


def _truthy_v(v: Column) -> Column:
    t = vtype(v)
    return (F.when(v.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(t == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
            .when(t.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
            .when(t.startswith("OBJECT"), F.to_json(v) != "{}")
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True))))


def _with_payload_variants(steps: DataFrame) -> DataFrame:
    """Parse the three payloads once (``_vi``, ``_vo``, ``_vm``)."""
    return steps.select("*", F.try_parse_json("inputs").alias("_vi"), F.try_parse_json("outputs").alias("_vo"),
                        F.try_parse_json("metadata").alias("_vm"))


def _g(v: str, path: str) -> Column:
    return F.variant_get(F.col(v), path, "variant")


def _s(v: str, path: str) -> Column:
    """String value at path only when it is a JSON string."""
    x = _g(v, path)
    return F.when(vtype(x) == "STRING", F.try_variant_get(x, "$", "string"))


def flat_steps(traces: DataFrame, steps: DataFrame, prefix: str | None = None) -> DataFrame:
    """One row per step with the 23 typed columns of the analytics export.
    ``finish_reason`` = finish_reason or stop_reason; tokens / status via
    the safe integer rule; duration not clamped; payloads as compact JSON.
    ``prefix`` keeps traces whose id starts with it (pushed to the scan)."""
    if prefix:
        traces = traces.filter(F.col("trace_id").startswith(prefix))
        steps = steps.filter(F.col("trace_id").startswith(prefix))
    t = traces.select(F.col("trace_id"), F.col("name").alias("trace_name"),
                      F.col("framework").alias("trace_framework"), failed_flag().alias("trace_failed"),
                      F.col("started_at").alias("trace_started_at"), F.col("ended_at").alias("trace_ended_at"))
    s = _with_payload_variants(steps)
    fr = F.coalesce(F.when(_truthy_v(_g("_vo", "$.finish_reason")), F.try_variant_get(_g("_vo", "$.finish_reason"), "$", "string")),
                    F.try_variant_get(_g("_vo", "$.stop_reason"), "$", "string"))
    s = s.select(
        "trace_id", "step_id", F.col("step_index").cast("int").alias("step_index"),
        F.col("kind").alias("step_kind"), F.col("name").alias("step_name"),
        F.col("started_at").alias("step_started_at"), F.col("ended_at").alias("step_ended_at"),
        ((F.col("ended_at") - F.col("started_at")) * F.lit(1000.0)).alias("duration_ms"),
        F.try_variant_get(_g("_vi", "$.provider"), "$", "string").alias("provider"),
        F.try_variant_get(_g("_vi", "$.model"), "$", "string").alias("model"),
        safe_int_v(_g("_vo", "$.input_tokens")).alias("input_tokens"),
        safe_int_v(_g("_vo", "$.output_tokens")).alias("output_tokens"),
        fr.alias("finish_reason"), safe_int_v(_g("_vo", "$.status")).alias("http_status"),
        _truthy_v(_g("_vo", "$.rate_limited")).alias("rate_limited"), "error",
        json_compact("inputs").alias("inputs_json"), json_compact("outputs").alias("outputs_json"))
    out = s.join(t, "trace_id", "inner")
    return out.select(*[f.name for f in FLAT_SCHEMA.fields])


def save_flat_steps(flat: DataFrame, path: str, mode: str = "overwrite") -> None:
    """ZSTD Parquet, rows clustered by trace and step for min/max pruning.
    An empty input still writes a typed file."""
    (flat.sortWithinPartitions("trace_id", "step_index").write.mode(mode)
     .option("compression", "zstd").parquet(path))


def read_flat_steps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLAT_SCHEMA).parquet(path)


# -- OpenTelemetry --------------------------------------------------------

SPAN_KIND_INTERNAL, SPAN_KIND_CLIENT = 1, 3
STATUS_OK, STATUS_ERROR = 1, 2


def otlp_trace_id(col) -> Column:
    """Hex digits of the lower-cased id; first 32, or left-padded with 0."""
    c = F.regexp_replace(F.lower(F.col(col) if isinstance(col, str) else col), "[^0-9a-f]", "")
    return F.when(F.length(c) >= 32, F.substring(c, 1, 32)).otherwise(F.lpad(c, 32, "0"))


def otlp_span_id(col, fallback: Column | None = None) -> Column:
    """Hex digits of the lower-cased id; first 16, or right-padded with 0.
    A missing id takes ``fallback`` (a stable hash, not a random id)."""
    x = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(F.lower(x), "[^0-9a-f]", "")
    v = F.when(F.length(c) >= 16, F.substring(c, 1, 16)).otherwise(F.rpad(c, 16, "0"))
    if fallback is None:
        return v
    return F.when(x.isNull() | (x == ""), fallback).otherwise(v)


def unix_nanos(col) -> Column:
    """Text of int(seconds * 1e9); '0' for null."""
    x = F.col(col) if isinstance(col, str) else col
    return F.coalesce((x * F.lit(1e9)).cast("bigint").cast("string"), F.lit("0"))


def _attr(key: str, kind: str, val: Column) -> Column:
    if kind == "string":
        body = F.concat(F.lit('{"stringValue":'), json_string(val), F.lit("}"))
    elif kind == "int":
        body = F.concat(F.lit('{"intValue":"'), val.cast("string"), F.lit('"}'))
    else:
        body = F.lit('{"boolValue":true}')
    return F.concat(F.lit('{"key":"' + key + '","value":'), body, F.lit("}"))


def spans(steps: DataFrame) -> DataFrame:
    """Step -> OTLP span row: hex ids, nanos as text, kind (CLIENT for llm
    and tool calls), status (ERROR on error or status >= 500), and the
    attribute list as JSON (GenAI semantic conventions)."""
    s = _with_payload_variants(steps)
    kind = F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("custom"))
    llm = kind == "llm-call"

    def int_at(v: str, path: str) -> Column:
        x = _g(v, path)
        return F.when(vtype(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))

    prov, model = _s("_vi", "$.provider"), _s("_vi", "$.model")
    fin = F.coalesce(_s("_vo", "$.finish_reason"), _s("_vo", "$.stop_reason"))
    status = int_at("_vo", "$.status")
    frags = [
        _attr("agentrail.kind", "string", kind),
        F.when(llm & prov.isNotNull(), _attr("gen_ai.system", "string", prov)),
        F.when(llm & prov.isNotNull(), _attr("gen_ai.operation.name", "string", F.lit("chat"))),
        F.when(llm & model.isNotNull(), _attr("gen_ai.request.model", "string", model)),
        F.when(llm & model.isNotNull(), _attr("gen_ai.response.model", "string", model)),
        F.when(llm & int_at("_vi", "$.max_tokens").isNotNull(),
               _attr("gen_ai.request.max_tokens", "int", int_at("_vi", "$.max_tokens"))),
        F.when(llm & _truthy_v(_g("_vi", "$.stream")), _attr("gen_ai.request.streaming", "bool", F.lit(True))),
        F.when(llm & int_at("_vo", "$.input_tokens").isNotNull(),
               _attr("gen_ai.usage.input_tokens", "int", int_at("_vo", "$.input_tokens"))),
        F.when(llm & int_at("_vo", "$.output_tokens").isNotNull(),
               _attr("gen_ai.usage.output_tokens", "int", int_at("_vo", "$.output_tokens"))),
        F.when(llm & fin.isNotNull(), _attr("gen_ai.response.finish_reason", "string", fin)),
        F.when(llm & _truthy_v(_g("_vo", "$.rate_limited")),
               _attr("gen_ai.response.rate_limited", "bool", F.lit(True))),
        F.when(_s("_vm", "$.transport").isNotNull(), _attr("agentrail.transport", "string", _s("_vm", "$.transport"))),
        F.when(_s("_vm", "$.method").isNotNull(), _attr("http.request.method", "string", _s("_vm", "$.method"))),
        F.when(_s("_vm", "$.path").isNotNull(), _attr("url.path", "string", _s("_vm", "$.path"))),
        F.when(status.isNotNull(), _attr("http.response.status_code", "int", status)),
        F.when((kind == "tool-call") & F.col("name").isNotNull(), _attr("agentrail.tool.name", "string", F.col("name"))),
    ]
    has_err = F.col("error").isNotNull() & (F.col("error") != "")
    fallback = F.substring(F.sha2(F.concat_ws("#", "trace_id", F.col("step_index").cast("string")), 256), 1, 16)
    return s.select(
        "trace_id", "step_id", "step_index",
        otlp_trace_id("trace_id").alias("trace_id_hex"),
        otlp_span_id("step_id", fallback).alias("span_id_hex"),
        F.when(F.col("parent_step_id").isNotNull() & (F.col("parent_step_id") != ""),
               otlp_span_id("parent_step_id")).alias("parent_span_id_hex"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), kind).alias("name"),
        F.when(kind.isin("llm-call", "tool-call"), SPAN_KIND_CLIENT).otherwise(SPAN_KIND_INTERNAL).alias("kind"),
        unix_nanos("started_at").alias("start_unix_nano"),
        unix_nanos(F.coalesce(F.when(F.col("ended_at") != 0, F.col("ended_at")), F.col("started_at")))
        .alias("end_unix_nano"),
        F.concat(F.lit("["), F.concat_ws(",", *frags), F.lit("]")).alias("attributes_json"),
        F.when(has_err | (status >= 500), STATUS_ERROR).otherwise(STATUS_OK).alias("status_code"),
        F.when(has_err, F.col("error"))
        .when(status >= 500, F.concat(F.lit("upstream returned "), status.cast("string"))).alias("status_message"))


def resource_spans(traces: DataFrame, steps: DataFrame, service_name: str = "agentrail",
                   prefix: str | None = None) -> DataFrame:
    """One ``resourceSpans`` JSON document per trace, spans in step order."""
    if prefix:
        traces = traces.filter(F.col("trace_id").startswith(prefix))
        steps = steps.filter(F.col("trace_id").startswith(prefix))
    sp = spans(steps).select("trace_id", "step_index", F.concat(
        F.lit('{"traceId":"'), F.col("trace_id_hex"), F.lit('","spanId":"'), F.col("span_id_hex"),
        F.when(F.col("parent_span_id_hex").isNotNull(),
               F.concat(F.lit('","parentSpanId":"'), F.col("parent_span_id_hex"))).otherwise(F.lit("")),
        F.lit('","name":'), json_string("name"), F.lit(',"kind":'), F.col("kind").cast("string"),
        F.lit(',"startTimeUnixNano":"'), F.col("start_unix_nano"), F.lit('","endTimeUnixNano":"'),
        F.col("end_unix_nano"), F.lit('","attributes":'), F.col("attributes_json"),
        F.lit(',"status":{"code":'), F.col("status_code").cast("string"),
        F.when(F.col("status_message").isNotNull(),
               F.concat(F.lit(',"message":'), json_string("status_message"))).otherwise(F.lit("")),
        F.lit("}}")).alias("span"))
    per = (sp.groupBy("trace_id")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_index", "span"))),
                                         lambda x: x["span"]), ",").alias("_spans"),
                F.count(F.lit(1)).alias("span_count")))
    md = P.fields("metadata", "failed", "error")
    res = F.concat_ws(",",
                      _attr("service.name", "string", F.lit(service_name)),
                      _attr("service.namespace", "string", F.lit("agentrail")),
                      _attr("agentrail.trace.name", "string", F.coalesce("name", F.lit(""))),
                      _attr("agentrail.trace.id", "string", F.col("trace_id")),
                      F.when(F.col("framework").isNotNull(),
                             _attr("agentrail.trace.framework", "string", F.col("framework"))),
                      F.when(P.truthy(md["failed"]), _attr("agentrail.trace.failed", "bool", F.lit(True))),
                      F.when(md["error"].isNotNull(), _attr("agentrail.trace.error", "string", md["error"])))
    t = traces.select("trace_id", res.alias("_res"))
    return (t.join(per, "trace_id", "left").select(
        "trace_id", F.coalesce("span_count", F.lit(0)).alias("span_count"),
        F.concat(F.lit('{"resource":{"attributes":['), F.col("_res"),
                 F.lit(']},"scopeSpans":[{"scope":{"name":"agentrail"},"spans":['),
                 F.coalesce("_spans", F.lit("")), F.lit("]}]}")).alias("resource_spans")))


# -- benchmark corpus -----------------------------------------------------

def corpus_record_id(trace_id: Column, step_id: Column) -> Column:
    return F.concat(F.lit("lb-"), F.substring(trace_id, 1, 8), F.lit("-"), F.substring(step_id, 1, 6))


def annotation_json() -> Column:
    """An annotation as one JSON object."""
    return F.concat(
        F.lit('{"trace_id":'), json_string("trace_id"), F.lit(',"step_id":'), json_string("step_id"),
        F.lit(',"failure_category":'), json_string("failure_category"), F.lit(',"severity":'), json_string("severity"),
        F.lit(',"notes":'), json_string("notes"), F.lit(',"mitigation":'), json_string("mitigation"),
        F.lit(',"annotator":'), json_string("annotator"),
        F.lit(',"tags":'), F.coalesce(F.to_json("tags"), F.lit("[]")),
        F.lit(',"circuit_attribution":'), F.coalesce(json_compact("circuit_attribution", "null"), F.lit("null")),
        F.lit("}"))


def export_corpus(traces: DataFrame, steps: DataFrame, annotations: DataFrame,
                  license: str = "CC-BY-4.0") -> DataFrame:
    """One record per annotation whose step and trace exist (two inner joins):
    id, framework, trace, step, annotation, license (``record_json``)."""
    from ..operators.joins import join_annotated_steps
    j = (join_annotated_steps(steps, annotations)
         .join(traces.select("trace_id", F.col("name").alias("trace_name"), "framework",
                             F.col("started_at").alias("trace_started_at"),
                             F.col("ended_at").alias("trace_ended_at")), "trace_id", "inner"))
    rid = corpus_record_id(F.col("trace_id"), F.col("step_id"))
    step_json = F.concat(
        F.lit('{"step_id":'), json_string("step_id"), F.lit(',"parent_step_id":'), json_string("parent_step_id"),
        F.lit(',"kind":'), json_string("kind"), F.lit(',"name":'), json_string("name"),
        F.lit(',"started_at":'), json_number("started_at"), F.lit(',"ended_at":'), json_number("ended_at"),
        F.lit(',"inputs":'), json_compact("inputs"), F.lit(',"outputs":'), json_compact("outputs"),
        F.lit(',"metadata":'), json_compact("metadata"), F.lit(',"error":'), json_string("error"), F.lit("}"))
    rec = F.concat(
        F.lit('{"id":'), json_string(rid), F.lit(',"framework":'), json_string("framework"),
        F.lit(',"trace":{"trace_id":'), json_string("trace_id"), F.lit(',"name":'), json_string("trace_name"),
        F.lit(',"started_at":'), json_number("trace_started_at"), F.lit(',"ended_at":'), json_number("trace_ended_at"),
        F.lit('},"step":'), step_json, F.lit(',"annotation":'), annotation_json(),
        F.lit(',"license":'), json_string(F.lit(license)), F.lit("}"))
    return j.select(rid.alias("id"), "framework", "trace_id", "step_id", "failure_category", "severity",
                    F.lit(license).alias("license"), rec.alias("record_json"))


def validate_corpus(records: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Per corpus line (``record_json``): id pattern ``^lb-[a-z0-9-]+$``,
    required keys, category in the corpus vocabulary (others reported)."""
    from .. import dims
    cats = categories or dims.CORPUS_CATEGORIES
    v = F.try_parse_json("record_json")
    req = ["id", "framework", "trace", "step", "annotation", "license"]
    missing = F.filter(F.array(*[F.when(F.variant_get(v, f"$.{k}", "variant").isNull(), F.lit(k)) for k in req]),
                       lambda x: x.isNotNull())
    rid = F.try_variant_get(v, "$.id", "string")
    cat = F.try_variant_get(v, "$.annotation.failure_category", "string")
    return records.select(
        "record_json", rid.alias("id"),
        F.coalesce(rid.rlike("^lb-[a-z0-9-]+$"), F.lit(False)).alias("id_ok"),
        F.array_join(missing, ",").alias("missing_keys"),
        cat.alias("category"), F.coalesce(cat.isin(*cats), F.lit(False)).alias("category_ok"))


def leaderboard(results: DataFrame, record_categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, categories) of replay results: total, replayed, errors,
    fail_rate (0 when empty); per category (default 'unknown') replayed and
    errors.  Results are joined to the categories by record id."""
    r = (results.join(record_categories, "id", "left")
         .withColumn("category", F.coalesce("category", F.lit("unknown"))))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    totals = r.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(ok, 1)).alias("replayed"),
                   F.count(F.when(~ok, 1)).alias("errors"))
    totals = totals.withColumn(
        "fail_rate", F.when(F.col("total") > 0, F.col("errors") / F.col("total")).otherwise(F.lit(0.0)))
    cats = r.groupBy("category").agg(F.count(F.when(ok, 1)).alias("replayed"),
                                      F.count(F.when(~ok, 1)).alias("errors"))
    return totals, cats


def leaderboard_entry(results: DataFrame, record_categories: DataFrame, corpus: str, corpus_size: int,
                      provider: str, model: str, as_of: float, version: str = "1") -> DataFrame:
    """One row: what was replayed (corpus, its size, provider, model), totals,
    fail rate, ``categories`` as a map from category to counts, the time in ISO
    form and the version.  One pass groups the results by category (their
    vocabulary is small), and the totals are sums over the categories.  No
    results: totals 0, fail rate 0, an empty map.  The single results are lines
    of their own (``leaderboard_records``), never gathered into the row."""
    _, cats = leaderboard(results, record_categories)
    counts = F.struct("category", F.struct("replayed", "errors").alias("counts"))
    row = cats.agg(F.coalesce(F.sum("replayed"), F.lit(0)).alias("replayed"),
                   F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
                   F.map_from_entries(F.array_sort(F.collect_list(counts))).alias("categories"))
    total = F.col("replayed") + F.col("errors")
    return row.select(
        F.lit(corpus).alias("corpus"), F.lit(corpus_size).cast("bigint").alias("corpus_size"),
        F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        total.alias("total"), "replayed", "errors",
        F.when(total > 0, F.col("errors") / total).otherwise(F.lit(0.0)).alias("fail_rate"), "categories",
        F.date_format(F.timestamp_micros(F.lit(int(as_of * 1_000_000))), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        F.lit(version).alias("version"))


def leaderboard_records(results: DataFrame) -> DataFrame:
    """(id, line): each replay result as one JSON line with ``id``, ``ok`` (a
    null counts as failed) and ``error`` where there is one."""
    rec = F.struct("id", F.coalesce("ok", F.lit(False)).alias("ok"), "error")
    return results.select("id", F.to_json(rec).alias("line"))


def parse_gate(spec: str) -> tuple[str, float]:
    """'fail-rate=20%' or 'fail-rate=0.2' -> ('fail-rate', 0.2); other metric
    or a non-number raises."""
    if "=" not in spec:
        raise ValueError(f"gate spec must be metric=value: {spec!r}")
    metric, raw = (x.strip() for x in spec.split("=", 1))
    if metric != "fail-rate":
        raise ValueError(f"unknown gate metric {metric!r}")
    try:
        val = float(raw[:-1]) / 100.0 if raw.endswith("%") else float(raw)
    except ValueError as e:
        raise ValueError(f"gate threshold is not a number: {raw!r}") from e
    return metric, val


def gate(totals: DataFrame, spec: str) -> DataFrame:
    """Breach iff the actual fail rate is above the threshold."""
    metric, thr = parse_gate(spec)
    return totals.select(F.lit(metric).alias("metric"), F.col("fail_rate").alias("actual"),
                         F.lit(thr).alias("threshold"), (F.col("fail_rate") > F.lit(thr)).alias("breach"))


# -- per-trace documents and reports ---------------------------------------

def trace_documents(traces: DataFrame, steps: DataFrame, annotations: DataFrame) -> DataFrame:
    """Header + ``steps[]`` (in order) + ``annotations[]`` as one JSON per trace."""
    st = steps.select("trace_id", "step_index", F.concat(
        F.lit('{"step_id":'), json_string("step_id"), F.lit(',"kind":'), json_string("kind"),
        F.lit(',"name":'), json_string("name"), F.lit(',"started_at":'), json_number("started_at"),
        F.lit(',"ended_at":'), json_number("ended_at"), F.lit(',"inputs":'), json_compact("inputs"),
        F.lit(',"outputs":'), json_compact("outputs"), F.lit(',"error":'), json_string("error"),
        F.lit("}")).alias("j"))
    sa = st.groupBy("trace_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_index", "j"))), lambda x: x["j"]), ",")
        .alias("_s"), F.count(F.lit(1)).alias("step_count"))
    an = annotations.select("trace_id", "step_id", F.concat(
        F.lit('{"step_id":'), json_string("step_id"), F.lit(',"failure_category":'), json_string("failure_category"),
        F.lit(',"severity":'), json_string("severity"), F.lit(',"notes":'), json_string("notes"),
        F.lit("}")).alias("j"))
    aa = an.groupBy("trace_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "j"))), lambda x: x["j"]), ",")
        .alias("_a"), F.count(F.lit(1)).alias("annotation_count"))
    doc = F.concat(F.lit('{"trace_id":'), json_string("trace_id"), F.lit(',"name":'), json_string("name"),
                   F.lit(',"framework":'), json_string("framework"), F.lit(',"started_at":'), json_number("started_at"),
                   F.lit(',"ended_at":'), json_number("ended_at"), F.lit(',"metadata":'), json_compact("metadata"),
                   F.lit(',"steps":['), F.coalesce("_s", F.lit("")), F.lit('],"annotations":['),
                   F.coalesce("_a", F.lit("")), F.lit("]}"))
    return (traces.join(sa, "trace_id", "left").join(aa, "trace_id", "left")
            .select("trace_id", F.coalesce("step_count", F.lit(0)).alias("step_count"),
                    F.coalesce("annotation_count", F.lit(0)).alias("annotation_count"), doc.alias("document")))


def _fence(text: Column, language: str = "") -> Column:
    return F.concat(F.lit(f"```{language}\n"), text, F.lit("\n```"))


def _json_block(title: str, text: Column) -> Column:
    return F.concat(F.lit(f"\n**{title}**\n"), _fence(text, "json"))


def _given(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def case_files(traces: DataFrame, steps: DataFrame, annotations: DataFrame) -> DataFrame:
    """Markdown case file per trace: badge line, top-level error of a failed
    trace, annotations (category, severity, notes, mitigation, tags, annotator)
    in order of writing, a table of all steps (◉ = annotated) and the detail of
    every failing step with its inputs, outputs and annotation.

    ``annotations`` has one row a step (``windows.latest_annotations``).  Payloads
    are in the file as compact JSON, and only those of failing steps are
    shuffled."""
    ms = F.coalesce(F.greatest(F.lit(0.0), (F.col("ended_at") - F.col("started_at")) * 1000), F.lit(0.0))
    kind, name = F.coalesce("kind", F.lit("")), F.coalesce("name", F.lit(""))
    error = _given(F.col("error"))

    def payload(title: str, col: str) -> Column:
        text = json_compact(col)
        return F.when(~text.isin("{}", "[]", "null", '""'), _json_block(title, text))

    st = steps.select("trace_id", F.struct(
        "step_index", "step_id",
        F.concat(F.lit("| "), (F.col("step_index") + 1).cast("string"), F.lit(" | `"), kind, F.lit("` | "),
                 F.replace(name, F.lit("|"), F.lit("\\|"))).alias("head"),
        F.concat(F.lit(" | "), F.format_string("%.1f", ms), F.lit(" ms | "),
                 F.when(error.isNotNull(), "**failed**").otherwise("ok"), F.lit(" |")).alias("tail"),
        F.when(error.isNotNull(), F.concat_ws(
            "\n", F.lit(""), F.concat(F.lit("### Step `"), name, F.lit("` ("), kind, F.lit(")")), _fence(error),
            payload("Inputs", "inputs"), payload("Outputs", "outputs"))).alias("detail")).alias("s"))
    sa = st.groupBy("trace_id").agg(F.array_sort(F.collect_list("s")).alias("_steps"))
    line = lambda label, col, end="": F.when(_given(col).isNotNull(), F.concat(F.lit(f"\n{label}"), col, F.lit(end)))
    order = F.col("seq") if "seq" in annotations.columns else F.col("step_id")
    aa = annotations.select("trace_id", F.struct(
        order.alias("at"), "step_id", annotation_json().alias("json"),
        F.concat_ws("\n", F.concat(F.lit("\n### "), F.coalesce("failure_category", F.lit("")), F.lit(" · "),
                                   F.coalesce("severity", F.lit(""))),
                    line("", F.col("notes")), line("**Mitigation:** ", F.col("mitigation")),
                    line("**Tags:** ", F.array_join("tags", ", ")),
                    line("*— annotated by ", F.col("annotator"), "*")).alias("text")).alias("a")
    ).groupBy("trace_id").agg(F.array_sort(F.collect_list("a")).alias("_notes"))

    def note(s: Column) -> Column:
        return F.try_element_at(F.filter("_notes", lambda a: a["step_id"] == s["step_id"]), F.lit(1))["json"]

    rows = F.transform("_steps", lambda s: F.concat(s["head"], F.when(note(s).isNotNull(), " ◉").otherwise(""), s["tail"]))
    details = F.transform(F.filter("_steps", lambda s: s["detail"].isNotNull()),
                          lambda s: F.concat_ws("\n", s["detail"], _json_block("Annotation", note(s))))
    failed = failed_flag()
    top = F.when(failed, _given(P.fields("metadata", "error")["error"]))
    started = F.date_format(F.timestamp_micros((F.col("started_at") * 1000000).cast("long")), "yyyy-MM-dd HH:mm:ss")
    md = F.concat_ws(
        "\n", F.concat(F.lit("# Case File · "), F.coalesce("name", F.lit("(unnamed)")), F.lit("\n")),
        F.concat(F.lit("> `"), F.substring("trace_id", 1, 12), F.lit("` · "), F.coalesce(_given(F.col("framework")), F.lit("untagged")),
                 F.lit(" · "), F.coalesce(started, F.lit("—")), F.lit(" · "), F.format_string("%.0f", ms), F.lit(" ms · **"),
                 F.when(failed, "❗ failed").otherwise("✓ ok"), F.lit("**\n")),
        F.when(top.isNotNull(), F.concat(F.lit("## Top-level error\n"), _fence(top), F.lit("\n"))),
        F.when(F.col("_notes").isNotNull(), F.concat(
            F.lit("## Annotations\n"), F.array_join(F.transform("_notes", lambda a: a["text"]), "\n"), F.lit("\n"))),
        F.lit("## Steps\n\n| # | kind | name | duration | status |\n|---|------|------|---------:|--------|"),
        F.array_join(rows, "\n"),
        F.when(F.size(details) > 0, F.concat(F.lit("\n## Failure detail\n"), F.array_join(details, "\n"))))
    return (traces.join(sa, "trace_id", "left").join(aa, "trace_id", "left")
            .select("trace_id", md.alias("markdown")))
