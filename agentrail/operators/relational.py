"""Listing, search, filters and id resolution over the trace tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P
from .stats import duration_ms, failed_flag


def _count_by_trace(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("trace_id").agg(F.count(F.lit(1)).alias(name))


def list_traces(traces: DataFrame, steps: DataFrame, annotations: DataFrame,
                limit: int | None = 100) -> DataFrame:
    """Newest traces first: id, name, framework, started_at, duration_ms
    (null while open), step_count, failed, annotation_count.

    With a ``limit`` the newest ids are chosen first from the trace table
    alone (top-N, ``trace_id`` breaking ties); steps and annotations are
    then counted only for those ids (a broadcast semi join of at most
    ``limit`` ids), so the step table is never aggregated in full."""
    t = traces.select("trace_id", "name", "framework", "started_at",
                      F.round(duration_ms(), 3).alias("duration_ms"), failed_flag().alias("failed"))
    order = [F.col("started_at").desc_nulls_last(), F.col("trace_id")]
    if limit:
        t = t.orderBy(*order).limit(limit)
        ids = F.broadcast(t.select("trace_id"))  # at most ``limit`` rows
        steps = steps.join(ids, "trace_id", "left_semi")
        annotations = annotations.join(ids, "trace_id", "left_semi")
    out = (t.join(_count_by_trace(steps, "step_count"), "trace_id", "left")
           .join(_count_by_trace(annotations, "annotation_count"), "trace_id", "left")
           .withColumn("step_count", F.coalesce("step_count", F.lit(0)).cast("bigint"))
           .withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0)).cast("bigint")))
    return out.orderBy(*order) if limit else out


def latest_n(traces: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest traces (top-N, unique tie-break)."""
    return traces.orderBy(F.col("started_at").desc_nulls_last(), F.col("trace_id")).limit(n)


def rank_newest(traces: DataFrame) -> DataFrame:
    """Rank of every trace by start, newest = 1.

    A global ordering is one sort; ``row_number`` over an un-partitioned
    window would pull every row into one task, so the rank is computed
    from a range-partitioned sort instead (see ``windows.global_rank``)."""
    from .windows import global_rank
    return global_rank(traces.select("trace_id", "started_at"),
                       [F.col("started_at").desc_nulls_last(), F.col("trace_id").asc()],
                       "rank")


def _hay(*cols: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def header_hay() -> Column:
    """What a search looks through in a trace header."""
    return _hay("name", "framework", "trace_id")


def step_hay() -> Column:
    """What a search looks through in a step."""
    return _hay("kind", "name", "error")


def search_text(q: str | None) -> str:
    """A query as it is looked for: trimmed, lower case."""
    return (q or "").strip().lower()


def search_traces(traces: DataFrame, steps: DataFrame, annotations: DataFrame,
                  q: str) -> DataFrame:
    """Case-insensitive substring search.  Header hay = name, framework and id
    joined by spaces; step hay = kind, name and error; ``match_steps`` is set
    only where the header missed.  Steps are read once: their number and the
    hit of a trace come out of one aggregate that is combined before the
    shuffle.  An empty query lists everything without match flags.  For a search
    that does not read every step see ``search_index.TraceIndex``."""
    query = search_text(q)
    base = traces.select("trace_id", "name", "framework", "started_at")
    per_trace = steps.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("step_count"),
        *([F.max(F.instr(step_hay(), F.lit(query)) > 0).alias("_hit")] if query else []))
    out = base.join(per_trace, "trace_id", "left")
    if query:
        out = (out.withColumn("match_header", F.instr(header_hay(), F.lit(query)) > 0)
               .withColumn("match_steps", ~F.col("match_header") & F.coalesce("_hit", F.lit(False)))
               .filter(F.col("match_header") | F.col("match_steps")))
    out = (out.join(_count_by_trace(annotations, "annotation_count"), "trace_id", "left")
           .withColumn("step_count", F.coalesce("step_count", F.lit(0)).cast("bigint"))
           .withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0)).cast("bigint")))
    flags = ["match_header", "match_steps"] if query else []
    return out.select(*base.columns, *flags, "step_count", "annotation_count")


def filter_status(listed: DataFrame, mode: str = "all", q: str = "") -> DataFrame:
    """all / failed / tagged (has annotations), plus a client text filter on
    id and name (case-insensitive)."""
    df = listed
    if mode == "failed":
        df = df.filter(F.col("failed"))
    elif mode == "tagged":
        df = df.filter(F.col("annotation_count") > 0)
    elif mode != "all":
        raise ValueError(f"unknown mode {mode!r}")
    query = (q or "").strip().lower()
    if query:
        hay = F.lower(F.concat_ws(" ", F.coalesce("trace_id", F.lit("")), F.coalesce("name", F.lit(""))))
        df = df.filter(F.instr(hay, F.lit(query)) > 0)
    return df


def valid_prefix(col: Column) -> Column:
    """A usable id prefix: 1..128 chars, no path / glob / control characters,
    no leading dot."""
    return (col.isNotNull() & (F.length(col) >= 1) & (F.length(col) <= 128)
            & ~col.rlike(r"[/\\*?\[\]\x00-\x1f]") & ~col.startswith("."))


def resolve_prefixes(traces: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Per requested ``prefix``: the matching trace (smallest id), the number
    of matches and ``ambiguous``; invalid prefixes resolve to nothing.

    A prefix match is an equi join with a prefix trie: the distinct prefix
    lengths (at most 128, by validation) arrive as a scalar-subquery array, each
    id is exploded over them, and the ids of a trie node (length, first
    characters) are aggregated map-side to the least id and their number.  One
    row a node crosses the join, so a short prefix over all ids is no hot key."""
    p = prefixes.select("prefix", valid_prefix(F.col("prefix")).alias("valid"))
    ok = p.filter("valid").select("prefix", F.length("prefix").alias("_len"))
    lens = ok.agg(F.collect_set("_len")).scalar()
    trie = (traces.select("trace_id", F.explode(lens).alias("_len"))
            .filter(F.col("_len") <= F.length("trace_id"))
            .groupBy(F.expr("substr(trace_id, 1, _len)").alias("prefix"))
            .agg(F.min("trace_id").alias("trace_id"), F.count(F.lit(1)).alias("matches")))
    m = ok.select("prefix").distinct().join(trie, "prefix")
    return (p.join(m, "prefix", "left")
            .select("prefix", "valid", "trace_id",
                    F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"),
                    (F.coalesce("matches", F.lit(0)) > 1).alias("ambiguous")))


def filter_steps(steps: DataFrame, kind: str | None = None, only_failing: bool = False,
                 limit: int | None = None) -> DataFrame:
    df = steps
    if kind:
        df = df.filter(F.col("kind") == kind)
    if only_failing:
        df = df.filter(F.col("error").isNotNull() & (F.col("error") != ""))
    if limit:
        df = df.orderBy("trace_id", "step_index").limit(limit)
    return df


def trace_cards(traces: DataFrame) -> DataFrame:
    """Live-view card per trace: provider and model from the header inputs,
    else metadata, else '—'; failed flag."""
    cols = traces.columns
    ins = P.fields("inputs", "provider", "model") if "inputs" in cols else None
    md = P.fields("metadata", "provider", "model", "failed")

    def pick(key: str) -> Column:
        opts = ([F.nullif(ins[key], F.lit(""))] if ins is not None else []) + \
               [F.nullif(md[key], F.lit("")), F.lit("—")]
        return F.coalesce(*opts)

    return traces.select("started_at", "trace_id", pick("provider").alias("provider"),
                         pick("model").alias("model"), P.truthy(md["failed"]).alias("failed"))


def attributable(steps: DataFrame) -> DataFrame:
    """llm-call steps with a non-empty prompt or response text."""
    from ..functions.text import prompt_text, response_text
    s = steps.filter(F.col("kind") == "llm-call")
    s = s.withColumn("prompt", prompt_text("inputs")).withColumn("response", response_text("outputs"))
    return s.filter((F.length(F.trim(F.coalesce("prompt", F.lit("")))) > 0)
                    | (F.length(F.trim(F.coalesce("response", F.lit("")))) > 0))


def purge_candidates(traces: DataFrame, annotations: DataFrame, max_age_s: float, as_of: float,
                     keep_tagged: bool = False, age_col: str = "ended_at") -> DataFrame:
    """Traces older than ``max_age_s`` at ``as_of`` (age from ``ended_at``,
    else ``started_at``); with ``keep_tagged`` annotated traces are spared
    (left anti join)."""
    ref = F.coalesce(F.col(age_col), F.col("started_at"))
    c = (traces.select("trace_id", (F.lit(as_of) - ref).alias("age_s"))
         .filter(F.col("age_s") >= max_age_s))
    if keep_tagged:
        c = c.join(annotations.select("trace_id"), "trace_id", "left_anti")
    return c.withColumn("age_s", F.round("age_s", 3))
