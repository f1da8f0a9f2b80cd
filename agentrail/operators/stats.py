"""Aggregations over traces, steps and annotations.

Exact percentiles never gather a group into one task: ``exact_percentiles``
range-partitions and sorts the values, derives each row's global rank from
per-partition counts (a table of at most partitions x groups rows), and
keeps only the rows at the ranks the percentiles need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload as P
from ..session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row-in-partition


def failed_flag(metadata: Column | str = "metadata") -> Column:
    """``metadata.failed`` truthiness of a trace header."""
    return P.truthy(P.fields(metadata, "failed")["failed"])


def duration_ms(start: Column | str = "started_at", end: Column | str = "ended_at") -> Column:
    """(end - start) * 1000; null while open; may be negative (not clamped)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return (e - s) * F.lit(1000.0)


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float],
                      by: Sequence[str] = (), partitions: int | None = None,
                      names: Sequence[str] | None = None) -> DataFrame:
    """Exact ``percentile_cont`` of ``value`` per ``by`` group, distributed.

    1. range-partition on (by, value) and sort within partitions; the row
       id then encodes (partition, position in partition);
    2. count rows per (partition, group) -> at most partitions x groups
       rows; a running sum over partitions gives each partition's offset
       inside its group, so global rank = offset + position - first position;
    3. keep the rows whose rank is floor/ceil of p * (n - 1) and
       interpolate.  Nulls are ignored.
    """
    by = list(by)
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    spark = df.sparkSession
    nparts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = (df.select(*by, F.col(value).cast("double").alias("_v"))
         .filter(F.col("_v").isNotNull())
         .withColumn("_tie", F.monotonically_increasing_id())  # splits a frequent value
         .repartitionByRange(nparts, *by, "_v", "_tie")
         .sortWithinPartitions(*by, "_v", "_tie").drop("_tie")
         .withColumn("_id", F.monotonically_increasing_id()))
    # written once: counts and positions must come from the same partitions
    x = (materialize(x, "percentiles")
         .withColumn("_pid", F.shiftright("_id", _LOCAL_BITS))
         .withColumn("_loc", F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    part = x.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_c"), F.min("_loc").alias("_first"))
    gw = Window.partitionBy(*by) if by else Window.partitionBy()
    part = (part.withColumn("_before", F.coalesce(F.sum("_c").over(
                gw.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_n", F.sum("_c").over(gw)))
    # at most one row per partition and group in it; no broadcast is asked for,
    # as groups may be many
    ranked = (x.join(part, ["_pid", *by])
              .withColumn("_rank", F.col("_before") + F.col("_loc") - F.col("_first")))
    conds, aggs = [], []
    for p, nm in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        conds.append((F.col("_rank") == lo) | (F.col("_rank") == hi))
        aggs += [F.max(F.when(F.col("_rank") == lo, F.col("_v"))).alias(f"_{nm}_lo"),
                 F.max(F.when(F.col("_rank") == hi, F.col("_v"))).alias(f"_{nm}_hi"),
                 F.max(pos - lo).alias(f"_{nm}_f")]
    keep = conds[0]
    for c in conds[1:]:
        keep = keep | c
    picked = ranked.filter(keep)
    g = picked.groupBy(*by).agg(*aggs) if by else picked.agg(*aggs)
    out = [F.col(b) for b in by]
    for nm in names:
        lo, hi, f = F.col(f"_{nm}_lo"), F.col(f"_{nm}_hi"), F.col(f"_{nm}_f")
        out.append((lo + f * (hi - lo)).alias(nm))
    return g.select(*out)


def trace_stats(traces: DataFrame, steps: DataFrame, annotations: DataFrame | None = None,
                partitions: int | None = None) -> DataFrame:
    """One row: trace_count, failed_count, step_count, annotation_count and the
    true median duration (ms) of closed traces."""
    per_trace = steps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_steps"))
    t = (traces.select("trace_id", failed_flag().alias("_failed"),
                       duration_ms().alias("duration_ms"))
         .join(per_trace, "trace_id", "left"))
    head = t.agg(F.count(F.lit(1)).alias("trace_count"),
                 F.sum(F.col("_failed").cast("int")).cast("bigint").alias("failed_count"),
                 F.coalesce(F.sum("_steps"), F.lit(0)).cast("bigint").alias("step_count"))
    # one-row results attached as scalar subqueries (no join)
    med = exact_percentiles(t, "duration_ms", [0.5], partitions=partitions, names=["m"]).agg(F.max("m"))
    cols = [F.col("trace_count"), F.col("failed_count"), F.col("step_count")]
    if annotations is not None:
        cols.append(annotations.agg(F.count(F.lit(1))).scalar().alias("annotation_count"))
    cols.append(med.scalar().alias("median_duration_ms"))
    return head.select(*cols)


def traces_by_framework(traces: DataFrame) -> DataFrame:
    """Trace count per framework, a missing framework labelled '—'."""
    return (traces.groupBy(F.coalesce(F.col("framework"), F.lit("—")).alias("framework"))
            .agg(F.count(F.lit(1)).alias("traces")))


def top_frameworks(traces: DataFrame) -> DataFrame:
    """Frameworks by trace count, most used first (name breaks ties)."""
    return traces_by_framework(traces).orderBy(F.col("traces").desc(), F.col("framework"))


def failure_categories(annotations: DataFrame) -> DataFrame:
    return (annotations.groupBy("failure_category")
            .agg(F.count(F.lit(1)).alias("annotations")))


def annotation_coverage(annotations: DataFrame) -> DataFrame:
    """Annotations and distinct annotated traces."""
    return annotations.agg(F.count(F.lit(1)).alias("annotations"),
                           F.countDistinct("trace_id").alias("annotated_traces"))


def trace_rollup(steps: DataFrame, priced: DataFrame | None = None) -> DataFrame:
    """Per trace: steps, failing steps, summed step time (s), llm calls,
    tokens (canonical) and, given priced steps, cost."""
    tin, tout = P.canonical_tokens("inputs", "outputs")
    s = steps.select("trace_id", "kind", "error",
                     (F.col("ended_at") - F.col("started_at")).alias("_d"),
                     tin.alias("_in"), tout.alias("_out"))
    agg = s.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count("error").alias("failing_steps"),
        F.round(F.coalesce(F.sum("_d"), F.lit(0.0)), 6).alias("step_seconds"),
        F.count(F.when(F.col("kind") == "llm-call", 1)).alias("llm_calls"),
        F.coalesce(F.sum("_in"), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum("_out"), F.lit(0)).cast("bigint").alias("output_tokens"))
    if priced is not None:
        from .costs import usd
        c = priced.groupBy("trace_id").agg(F.sum("cost_pico").alias("_pico"))
        agg = (agg.join(c, "trace_id", "left")
               .withColumn("cost_usd", F.coalesce(usd(F.col("_pico")), F.lit(0.0))).drop("_pico"))
    return agg


def table_info(**tables: DataFrame) -> DataFrame:
    """Row count per named table (one small aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latency_percentiles(steps: DataFrame, probs: Sequence[float] = (0.5, 0.95),
                        approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """p50 / p95 step duration (ms) per kind over closed steps.  Exact by
    default (distributed rank selection); ``approx=True`` uses
    ``percentile_approx`` (one sketch per group, fixed memory)."""
    s = steps.select("kind", duration_ms().alias("duration_ms")).filter(
        F.col("duration_ms").isNotNull())
    names = [f"p{int(round(p * 100))}_ms" for p in probs]
    if approx:
        pa = F.percentile_approx("duration_ms", list(probs), accuracy)
        g = s.groupBy("kind").agg(pa.alias("_q"), F.count(F.lit(1)).alias("steps"))
        return g.select("kind", "steps", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    q = exact_percentiles(s, "duration_ms", probs, by=["kind"], names=names)
    n = s.groupBy("kind").agg(F.count(F.lit(1)).alias("steps"))
    return n.join(q, "kind")


def daily_counts(traces: DataFrame) -> DataFrame:
    from .costs import day_of
    return (traces.filter(F.col("started_at").isNotNull())
            .groupBy(day_of(F.col("started_at")).alias("day"))
            .agg(F.count(F.lit(1)).alias("traces"),
                 F.sum(failed_flag().cast("int")).alias("failed")))


def rolling_failure_rate(traces: DataFrame, days: int = 7) -> DataFrame:
    """Failed / all traces over the trailing ``days`` days, per day with data.

    Daily counts are pre-aggregated (one row per day), so the ordered
    window runs over a table of days, not of traces."""
    d = daily_counts(traces).withColumn("_dn", F.datediff("day", F.lit("1970-01-01")))
    w = Window.orderBy("_dn").rangeBetween(-(days - 1), 0)
    return d.select(F.col("day").cast("string").alias("day"),
                    F.sum("traces").over(w).cast("bigint").alias("traces_window"),
                    F.sum("failed").over(w).cast("bigint").alias("failed_window"),
                    F.round(F.sum("failed").over(w) / F.sum("traces").over(w), 6)
                    .alias("failure_rate"))


def daily_series(df: DataFrame, ts: str, val: str, days: int, as_of: float) -> DataFrame:
    """(ts seconds, value) -> ``days`` day cells ending on the UTC day of
    ``as_of``, oldest first, zero-filled; rows outside the window or with
    an unparsable time are dropped; ``days <= 0`` gives no rows."""
    from .costs import day_of
    spark = df.sparkSession
    if days <= 0:
        return spark.createDataFrame([], "day string, idx int, value double")
    end = F.to_date(F.timestamp_micros(F.lit(int(as_of * 1_000_000))))
    spine = spark.range(1).select(
        F.posexplode(F.sequence(F.date_sub(end, days - 1), end)).alias("idx", "day"))
    hi = (as_of // 86400 + 1) * 86400.0 + 1     # a second more on both sides; the spine has the exact days
    lo = hi - days * 86400.0 - 2
    v = (df.select(F.col(ts).try_cast("double").alias("_t"), F.col(val).try_cast("double").alias("_v"))
         .filter(F.col("_t").between(lo, hi))
         .groupBy(day_of(F.col("_t")).alias("day")).agg(F.sum("_v").alias("_s")))
    return (spine.join(v, "day", "left")
            .select(F.col("day").cast("string").alias("day"), F.col("idx").cast("int").alias("idx"),
                    F.round(F.coalesce(F.col("_s"), F.lit(0.0)), 6).alias("value")))
