"""Ordered / ranked operators: step positions, first failure, latest
annotation, replay inputs, last user turn, activation shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload as P
from ..session import materialize

_LOCAL_BITS = 33


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """1-based position of every row in a global order, without pulling the
    table into one task: range-partition + sort, per-partition row counts
    (one row per partition), running offsets, offset + local position.  The
    sorted rows are written once: counts and positions come from the same
    partitions.  Ties go by a hash of the row, which also splits a frequent
    value over partitions."""
    nparts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.xxhash64(*df.columns)]
    x = materialize(df.repartitionByRange(nparts, *order).sortWithinPartitions(*order)
                    .withColumn("_id", F.monotonically_increasing_id()), "rank")
    x = (x
         .withColumn("_pid", F.shiftright("_id", _LOCAL_BITS))
         .withColumn("_loc", F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    part = x.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_loc").alias("_first"))
    # one row per partition: a window without partitioning over it is cheap
    part = part.withColumn("_before", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (x.join(F.broadcast(part), "_pid")
            .withColumn(name, (F.col("_before") + F.col("_loc") - F.col("_first") + 1).cast("bigint"))
            .drop("_id", "_pid", "_loc", "_c", "_first", "_before"))


def with_step_index(steps: DataFrame, order_col: str = "pos") -> DataFrame:
    """0-based position of each step in its trace file (by line position)."""
    w = Window.partitionBy("trace_id").orderBy(order_col)
    return steps.withColumn("step_index", (F.row_number().over(w) - 1).cast("int"))


def first_failing(steps: DataFrame) -> DataFrame:
    """Per trace: index of the first step with an error, else 0."""
    has_err = F.col("error").isNotNull() & (F.col("error") != "")
    return steps.groupBy("trace_id").agg(
        F.coalesce(F.min(F.when(has_err, F.col("step_index"))), F.lit(0)).cast("bigint")
        .alias("first_failing_index"),
        F.count(F.when(has_err, 1)).alias("failing_steps"))


def latest_annotations(annotations: DataFrame, order_col: str = "seq") -> DataFrame:
    """Last write per (trace, step) wins: ``max_by`` over the write order is
    a plain hash aggregate (partial + final), no sort of the group."""
    cols = [c for c in annotations.columns if c not in ("trace_id", "step_id")]
    packed = F.struct(*[F.col(c) for c in cols])
    return (annotations.groupBy("trace_id", "step_id")
            .agg(F.max_by(packed, F.col(order_col)).alias("_a"))
            .select("trace_id", "step_id", *[F.col(f"_a.{c}").alias(c) for c in cols]))


def _vt(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def _vstr(v: Column) -> Column:
    return F.when(_vt(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _blocks_text(content: Column) -> Column:
    """Text blocks of a content list joined by newline ('' when none)."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    keep = F.filter(blocks, lambda b: (F.try_variant_get(b, "$.type", "string") == "text")
                    & (_vt(F.variant_get(b, "$.text", "variant")) == "STRING"))
    return F.array_join(F.transform(keep, lambda b: F.try_variant_get(b, "$.text", "string")), "\n")


def last_user_turn(steps: DataFrame) -> DataFrame:
    """Per step: the last user message's text (string content, or its text
    blocks joined by newline), else the last Gemini ``contents`` entry with
    role user or none (its string parts joined), else a string ``prompt``,
    else ''."""
    v = F.try_parse_json("inputs")
    s = steps.select("trace_id", "step_id", v.alias("_v"))
    msgs = F.try_variant_get(F.col("_v"), "$.messages", "array<variant>")

    def cand(m: Column) -> Column:
        c = F.variant_get(m, "$.content", "variant")
        return F.when(F.try_variant_get(m, "$.role", "string") == "user",
                      F.when(_vt(c) == "STRING", _vstr(c))
                      .when(_vt(c).startswith("ARRAY"), F.nullif(_blocks_text(c), F.lit(""))))

    from_msgs = F.try_element_at(F.filter(F.transform(msgs, cand), lambda x: x.isNotNull()), F.lit(-1))
    contents = F.try_variant_get(F.col("_v"), "$.contents", "array<variant>")

    def ccand(c: Column) -> Column:
        role = F.variant_get(c, "$.role", "variant")
        parts = F.try_variant_get(c, "$.parts", "array<variant>")
        texts = F.transform(F.filter(parts, lambda p: _vt(F.variant_get(p, "$.text", "variant")) == "STRING"),
                            lambda p: F.try_variant_get(p, "$.text", "string"))
        ok_role = role.isNull() | (_vt(role) == "VOID") | (F.try_variant_get(role, "$", "string") == "user")
        return F.when(_vt(c).startswith("OBJECT") & ok_role & (F.size(texts) > 0), F.array_join(texts, "\n"))

    from_contents = F.try_element_at(F.filter(F.transform(contents, ccand), lambda x: x.isNotNull()), F.lit(-1))
    prompt = _vstr(F.variant_get(F.col("_v"), "$.prompt", "variant"))
    return s.select("trace_id", "step_id",
                    F.coalesce(from_msgs, from_contents, prompt, F.lit("")).alias("last_user_text"))


def replay_inputs(steps: DataFrame) -> DataFrame:
    """Per trace: the prompt and model a replay would use, in file order.

    prompt = the first of: a ``plan`` step's non-blank string
    ``outputs.q``; an llm-call's string ``inputs.contents``; its string
    message contents joined by newline (an empty result leaves the prompt
    unfilled for later steps).  model = first non-empty string
    ``inputs.model`` of an llm-call, else the part of its name after ':'."""
    s = steps.select("trace_id", "step_index", "kind", "name",
                     F.try_parse_json("inputs").alias("_i"), F.try_parse_json("outputs").alias("_o"))
    q = _vstr(F.variant_get(F.col("_o"), "$.q", "variant"))
    plan_q = F.when((F.col("kind") == "plan") & (F.length(F.trim(q)) > 0), q)
    contents = _vstr(F.variant_get(F.col("_i"), "$.contents", "variant"))
    msgs = F.try_variant_get(F.col("_i"), "$.messages", "array<variant>")
    msg_text = F.array_join(F.filter(F.transform(msgs, lambda m: _vstr(F.variant_get(m, "$.content", "variant"))),
                                     lambda x: x.isNotNull()), "\n")
    is_llm = F.col("kind") == "llm-call"
    has_contents = _vt(F.variant_get(F.col("_i"), "$.contents", "variant")) == "STRING"
    llm_prompt = F.when(is_llm, F.when(has_contents, F.nullif(contents, F.lit("")))
                        .otherwise(F.nullif(msg_text, F.lit(""))))
    m = F.variant_get(F.col("_i"), "$.model", "variant")
    from_name = F.when(F.instr("name", ":") > 0, F.nullif(P.after_first_colon(F.col("name")), F.lit("")))
    # a string model (even '') is taken as is; only a non-string falls to the name
    model = F.when(is_llm, F.when(_vt(m) == "STRING", F.nullif(_vstr(m), F.lit(""))).otherwise(from_name))
    c = s.select("trace_id", "step_index", F.coalesce(plan_q, llm_prompt).alias("_p"), model.alias("_m"))
    return c.groupBy("trace_id").agg(
        F.coalesce(F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("step_index"))), F.lit("")).alias("prompt"),
        F.coalesce(F.min_by("_m", F.when(F.col("_m").isNotNull(), F.col("step_index"))), F.lit("")).alias("model"))


def conversation_bubbles(steps: DataFrame) -> DataFrame:
    """Chat view of llm-call steps: the request messages then the reply as
    (pos, role, text, is_reply); role 'model' shows as 'assistant'; list
    content shows its text blocks, other blocks as placeholders."""
    s = steps.filter(F.col("kind") == "llm-call").select(
        "trace_id", "step_id", F.try_parse_json("inputs").alias("_i"), F.try_parse_json("outputs").alias("_o"))
    msgs = F.coalesce(F.try_variant_get(F.col("_i"), "$.messages", "array<variant>"),
                      F.array().cast("array<variant>"))

    def text_of(m: Column) -> Column:
        c = F.variant_get(m, "$.content", "variant")
        blocks = F.try_variant_get(c, "$", "array<variant>")
        shown = F.transform(blocks, lambda b: F.coalesce(
            F.when(F.try_variant_get(b, "$.type", "string") == "text", F.try_variant_get(b, "$.text", "string")),
            F.concat(F.lit("["), F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit("block")), F.lit("]"))))
        return F.when(_vt(c) == "STRING", _vstr(c)).when(_vt(c).startswith("ARRAY"), F.array_join(shown, "\n"))

    items = F.transform(msgs, lambda m: F.struct(
        F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit("user")).alias("role"),
        text_of(m).alias("text"), F.lit(False).alias("is_reply")))
    reply = _vstr(F.variant_get(F.col("_o"), "$.text", "variant"))
    all_items = F.when(reply.isNotNull(), F.concat(items, F.array(F.struct(
        F.lit("assistant").alias("role"), reply.alias("text"), F.lit(True).alias("is_reply"))))).otherwise(items)
    out = s.select("trace_id", "step_id", F.posexplode(all_items).alias("pos", "b"))
    return out.select("trace_id", "step_id", F.col("pos").cast("bigint").alias("pos"),
                      F.when(F.col("b.role") == "model", F.lit("assistant")).otherwise(F.col("b.role")).alias("role"),
                      F.col("b.text").alias("text"), F.col("b.is_reply").alias("is_reply"))


def activation_share(features: DataFrame, key: Sequence[str] = ("annotation_id",)) -> DataFrame:
    """Activation as a percentage of the largest activation in its step."""
    w = Window.partitionBy(*key)
    return features.withColumn(
        "share_pct", F.round(F.col("activation") / F.max("activation").over(w) * 100, 4))


def topk_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                   name: str = "rank") -> DataFrame:
    """Top-k rows per group (``row_number`` over the group, unique tie-break
    expected in ``order``)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
