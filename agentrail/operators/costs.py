"""LLM spend: pricing of llm-call steps and the rollups built on it.

Two pricing modes exist and give different totals on purpose:

* ``rollup`` (the ``cost`` report): tokens are the first non-null of three
  payload locations, the model falls back to the part of the step name
  after its first colon, and an unknown model is priced at its provider's
  default row.
* ``strict`` (the daily chart and the 24 h activity): tokens must be JSON
  integers in ``outputs``, the model must be a string, and there is no
  provider fallback.

The price tables are tiny literal dimensions; they are joined by broadcast
hash joins (size checked in ``dims.bounded``), so pricing never shuffles
the step table.  Aggregations are partial + final (map-side combine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import payload as P


def estimate_cost(in_tok: Column, out_tok: Column, in_per_m: Column, out_per_m: Column) -> Column:
    """Exact cost of one call in pico-USD (DECIMAL(38,0)); null if a count or
    a price is missing; negative counts count as zero.

    ``tokens * USD-per-million`` is an integer number of pico-dollars once
    the price is expressed in micro-dollars, so sums are exact and do not
    depend on the order rows meet in partial aggregates.
    """
    def pico(tok: Column, per_m: Column) -> Column:
        micro = F.round(per_m * F.lit(1000000.0)).cast("bigint")
        return F.greatest(F.lit(0), tok).cast("decimal(38,0)") * micro.cast("decimal(38,0)")

    return F.when(in_tok.isNotNull() & out_tok.isNotNull() & in_per_m.isNotNull()
                  & out_per_m.isNotNull(),
                  (pico(in_tok, in_per_m) + pico(out_tok, out_per_m)).cast("decimal(38,0)"))


def usd(pico_sum: Column) -> Column:
    """Pico-USD -> USD rounded half-up to 6 decimals (exact decimal math)."""
    micro = F.floor((pico_sum + F.lit(500000)) / F.lit(1000000))
    return micro.cast("double") / F.lit(1000000.0)


def sum_usd(pico_col: str = "cost_pico") -> Column:
    return usd(F.sum(pico_col))


def _price_lookup(spark, prices: DataFrame | None, defaults: DataFrame | None):
    """(model -> price row, lower(provider) -> default price row) lookups.

    With the built-in tables both are literal relations (no join at all);
    user tables are joined with a size-checked broadcast."""
    price_ddl = "_key string, _price struct<model:string, in_per_m:double, out_per_m:double, provider:string>"
    if prices is None and defaults is None:
        rows = {m: (m, i, o, p) for m, i, o, p in dims.PRICES}
        by_model = spark.createDataFrame([(m, r) for m, r in rows.items()], price_ddl)
        by_provider = spark.createDataFrame([(prov.lower(), rows[m]) for prov, m in dims.PRICE_DEFAULTS], price_ddl)
        return F.broadcast(by_model), F.broadcast(by_provider)
    prices = prices if prices is not None else dims.prices_df(spark)
    defaults = defaults if defaults is not None else dims.price_defaults_df(spark)
    prices = dims.bounded(prices)
    row = F.struct(F.col("model").alias("model"), F.col("in_per_m"), F.col("out_per_m"),
                   F.col("provider").alias("provider"))
    by_model = prices.select(F.col("model").alias("_key"), row.alias("_price"))
    by_provider = (dims.bounded(defaults).alias("d").join(prices.alias("p"), F.col("d.model") == F.col("p.model"))
                   .select(F.lower(F.col("d.provider")).alias("_key"),
                           F.struct(F.col("p.model").alias("model"), F.col("p.in_per_m"),
                                    F.col("p.out_per_m"), F.col("p.provider").alias("provider"))
                           .alias("_price")))
    return dims.bounded(by_model), dims.bounded(by_provider)


def _attach(df: DataFrame, lookup: DataFrame, key: Column, name: str) -> DataFrame:
    lk = lookup.select(F.col("_key").alias(f"_k_{name}"), F.col("_price").alias(f"_p_{name}"))
    return df.join(lk, key == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")


def price_steps(steps: DataFrame, prices: DataFrame | None = None,
                defaults: DataFrame | None = None, mode: str = "rollup",
                model_from_name: bool = True, include_openai_names: bool = False) -> DataFrame:
    """llm-call steps with ``model_id, provider_hint, input_tokens,
    output_tokens, price_model, price_provider, cost_usd`` added.

    ``mode='rollup'``: exact model -> model after the first ``:`` ->
    provider default (provider lower-cased) -> unpriced.
    ``mode='strict'``: exact -> after ``:``; tokens must be JSON integers
    in ``outputs``; ``model_from_name=False`` additionally drops the
    step-name fallback for the model (the 24 h activity rule).
    ``include_openai_names`` (rollup): counts that one adapter records as
    ``prompt_tokens`` / ``completion_tokens`` are priced too.
    """
    spark = steps.sparkSession
    by_model, by_provider = _price_lookup(spark, prices, defaults)
    ins = P.fields("inputs", "model", "provider", "input_tokens", "output_tokens")
    s = steps.filter(F.col("kind") == "llm-call").withColumn("_in", ins)
    if mode == "rollup":
        tin, tout = P.canonical_tokens("inputs", "outputs", include_openai_names)
        s = s.withColumn("input_tokens", tin).withColumn("output_tokens", tout)
    elif mode == "strict":
        o = P.fields("outputs", "input_tokens", "output_tokens",
                     types={"input_tokens": "bigint", "output_tokens": "bigint"})
        s = (s.withColumn("_o", o).withColumn("input_tokens", F.col("_o.input_tokens"))
             .withColumn("output_tokens", F.col("_o.output_tokens")).drop("_o"))
    else:
        raise ValueError(f"unknown pricing mode {mode!r}")
    if model_from_name:
        mid = P.model_id(F.col("_in.model"), F.col("name"))
    else:
        mid = F.nullif(F.col("_in.model"), F.lit(""))
    s = (s.withColumn("model_id", mid)
         .withColumn("provider_hint", F.nullif(F.col("_in.provider"), F.lit("")))
         .withColumn("_stripped", F.when(F.instr("model_id", ":") > 0,
                                         P.after_first_colon(F.col("model_id")))))
    s = _attach(s, by_model, F.nullif(F.col("model_id"), F.lit("")), "exact")
    s = _attach(s, by_model, F.col("_stripped"), "strip")
    if mode == "rollup":
        s = _attach(s, by_provider, F.lower(F.col("provider_hint")), "prov")
        price = F.coalesce(F.col("_p_exact"), F.col("_p_strip"), F.col("_p_prov"))
    else:
        price = F.coalesce(F.col("_p_exact"), F.col("_p_strip"))
    s = s.withColumn("_price", price)
    s = s.withColumn("cost_pico", estimate_cost(F.col("input_tokens"), F.col("output_tokens"),
                                                F.col("_price.in_per_m"), F.col("_price.out_per_m")))
    s = s.withColumn("cost_usd", F.col("cost_pico").cast("double") / F.lit(1e12))
    s = (s.withColumn("price_model", F.when(F.col("cost_usd").isNotNull(), F.col("_price.model")))
         .withColumn("price_provider", F.when(F.col("cost_usd").isNotNull(), F.col("_price.provider"))))
    return s.drop("_in", "_stripped", "_price", "_p_exact", "_p_strip", "_p_prov")


def cost_rollup(priced: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """One row: llm_calls, priced_steps, unpriced_steps, total_usd (round 6)
    and, given the traces, trace_count.

    Steps are pre-aggregated per trace (map-side partial aggregation), then
    outer-joined to the trace ids so a trace without llm-calls still counts.
    """
    per_trace = priced.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("_calls"), F.count("cost_usd").alias("_priced"),
        F.sum("cost_pico").alias("_usd"))
    if traces is not None:
        per_trace = per_trace.join(traces.select("trace_id", F.lit(1).alias("_t")), "trace_id", "full")
    aggs = [F.coalesce(F.sum("_calls"), F.lit(0)).cast("bigint").alias("llm_calls"),
            F.coalesce(F.sum("_priced"), F.lit(0)).cast("bigint").alias("priced_steps"),
            F.coalesce(F.sum(F.col("_calls") - F.col("_priced")), F.lit(0)).cast("bigint")
             .alias("unpriced_steps"),
            F.coalesce(sum_usd("_usd"), F.lit(0.0)).alias("total_usd")]
    if traces is not None:
        aggs.append(F.count("_t").alias("trace_count"))
    return per_trace.agg(*aggs)


def cost_by_dimension(priced: DataFrame) -> DataFrame:
    """Spend by provider, by model (labels of the price row used) and total,
    in one pass: ``GROUPING SETS ((provider), (model), ())``."""
    p = priced.filter(F.col("cost_usd").isNotNull())
    g = p.groupingSets([["price_provider"], ["price_model"], []], "price_provider", "price_model").agg(
        sum_usd().alias("usd"),
        F.count(F.lit(1)).alias("calls"),
        F.grouping_id().alias("_gid"))
    return g.select(
        F.when(F.col("_gid") == 1, "provider").when(F.col("_gid") == 2, "model")
         .otherwise("total").alias("dimension"),
        F.coalesce(F.col("price_provider"), F.col("price_model"), F.lit("total")).alias("label"),
        "usd", "calls")


def cost_desc(by_dim: DataFrame) -> DataFrame:
    """Breakdown ordered by spend, label as tie-break."""
    return by_dim.orderBy(F.col("dimension"), F.col("usd").desc(), F.col("label"))


def cost_per_trace(priced: DataFrame, traces: DataFrame) -> DataFrame:
    """Subtotal per trace, kept only when > 0 and the trace start is known."""
    sub = (priced.filter(F.col("cost_usd").isNotNull()).groupBy("trace_id")
           .agg(F.sum("cost_pico").alias("_usd")))
    return (sub.join(traces.select("trace_id", "started_at"), "trace_id")
            .filter((F.col("_usd") > 0) & F.col("started_at").isNotNull())
            .select("trace_id", "started_at", usd(F.col("_usd")).alias("usd")))


def day_of(epoch_col: Column) -> Column:
    """UTC calendar day of Unix seconds."""
    return F.to_date(F.timestamp_micros((epoch_col * F.lit(1000000)).cast("long")))


#: Partition column of traces and steps laid out by day (``sinks.by_day``).
START_DAY = "start_day"


def started_between(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """The rows of traces started from ``lo`` to ``hi`` (Unix seconds), and some
    more: of tables laid out by day only the days' folders are read, and of
    traces the times go to the scan.  Exact bounds follow where they matter."""
    if START_DAY in df.columns:
        day = [F.to_date(F.timestamp_micros(F.lit(int(x * 1_000_000)))) for x in (lo - 1, hi + 1)]
        df = df.where(F.col(START_DAY).between(*day))
    return df


def cost_timeseries(steps: DataFrame, traces: DataFrame, as_of: float, days: int = 14,
                    prices: DataFrame | None = None) -> DataFrame:
    """Per UTC day of trace start over the last ``days`` days
    ending on the day of ``as_of``: usd (strict pricing), llm calls and rate
    limited calls (``outputs.rate_limited`` truthy or status 429).  Missing
    days are zero-filled from a date spine.  Only steps of traces of these days
    are priced; with tables laid out by day only those days are read."""
    n = int(days)
    if n < 1:
        raise ValueError("days must be 1 or more")
    spark = steps.sparkSession
    end = F.to_date(F.timestamp_micros(F.lit(int(as_of * 1_000_000))))
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, n - 1), end)).alias("date"))
    hi = (as_of // 86400 + 1) * 86400.0
    lo = hi - n * 86400.0
    t = (started_between(traces, lo, hi).filter(F.col("started_at").between(lo - 1, hi + 1))
         .select("trace_id", day_of(F.col("started_at")).alias("date"))
         .filter(F.col("date").between(F.date_sub(end, n - 1), end)))
    recent = started_between(steps, lo, hi).join(t.select("trace_id"), "trace_id", "left_semi")
    priced = price_steps(recent, prices=prices, mode="strict")
    o = P.fields("outputs", "rate_limited", "status")
    priced = priced.withColumn(
        "_rl", (P.truthy(o["rate_limited"]) | (o["status"].try_cast("double") == 429)).cast("int"))
    per_trace = priced.groupBy("trace_id").agg(F.sum("cost_pico").alias("cost_pico"), F.count(F.lit(1)).alias("_n"),
                                               F.sum("_rl").alias("_rl"))
    per_day = (per_trace.join(t, "trace_id").groupBy("date")
               .agg(F.sum("cost_pico").alias("_usd"), F.sum("_n").alias("calls"),
                    F.sum("_rl").cast("bigint").alias("rate_limited")))
    return (spine.join(per_day, "date", "left")
            .select(F.col("date").cast("string").alias("date"),
                    F.coalesce(usd(F.col("_usd")), F.lit(0.0)).alias("usd"),
                    F.coalesce(F.col("calls"), F.lit(0)).cast("bigint").alias("calls"),
                    F.coalesce(F.col("rate_limited"), F.lit(0)).cast("bigint").alias("rate_limited")))


def activity_24h(traces: DataFrame, steps: DataFrame, as_of: float,
                 prices: DataFrame | None = None) -> DataFrame:
    """One row: traces, last_capture_at, and for traces started in the 24 h
    before ``as_of``: llm calls, strict-priced cost (model from
    ``inputs.model`` only), failed traces.  Only steps of these traces are priced."""
    lo = as_of - 24 * 3600
    ids = started_between(traces, lo, as_of).filter(F.col("started_at").between(lo, as_of)).select("trace_id")
    steps = started_between(steps, lo, as_of).join(ids, "trace_id", "left_semi")
    priced = price_steps(steps, prices=prices, mode="strict", model_from_name=False)
    per_trace = priced.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_calls"),
                                               F.sum("cost_pico").alias("_usd"))
    recent = (F.col("started_at") >= lo) & (F.col("started_at") <= as_of)
    failed = P.truthy(P.fields("metadata", "failed")["failed"])
    t = traces.select("trace_id", "started_at", "ended_at", recent.alias("_recent"),
                      failed.alias("_failed")).join(per_trace, "trace_id", "left")
    return t.agg(
        F.count(F.lit(1)).alias("traces"),
        F.max(F.coalesce("ended_at", "started_at")).alias("last_capture_at"),
        F.coalesce(F.sum(F.when(F.col("_recent"), F.col("_calls"))), F.lit(0)).cast("bigint")
         .alias("calls_24h"),
        F.coalesce(usd(F.sum(F.when(F.col("_recent"), F.col("_usd")))), F.lit(0.0))
         .alias("cost_24h"),
        F.sum(F.when(F.col("_recent") & F.col("_failed"), 1).otherwise(0)).cast("bigint")
         .alias("failures_24h"))


def cost_by_day(priced: DataFrame, traces: DataFrame) -> DataFrame:
    """Spend by UTC day of the step start x provider x model (price row labels)."""
    p = priced.filter(F.col("cost_usd").isNotNull())
    return (p.groupBy(day_of(F.col("started_at")).cast("string").alias("day"),
                      "price_provider", "price_model")
            .agg(sum_usd().alias("usd"), F.count(F.lit(1)).alias("calls")))
