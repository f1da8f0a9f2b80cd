"""Cost queries: pricing (two modes), rollups, breakdowns, time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import costs
from ..functions import payload as P
from . import sqlvals
from .catalog import register
from .fixtures import AS_OF


def priced_sql(src: str, name: str = "priced") -> str:
    """Oracle CTE items: llm-call steps of ``src`` priced in rollup mode."""
    return f""",
{sqlvals.PRICES}, {sqlvals.PRICE_DEFAULTS},
{name}_a AS (
  SELECT trace_id, step_id, name, started_at,
    json_extract_string(inputs, '$.model') AS im,
    nullif(json_extract_string(inputs, '$.provider'), '') AS ip,
    CAST(trunc(TRY_CAST(coalesce(json_extract_string(outputs, '$.input_tokens'),
         json_extract_string(outputs, '$.input'), json_extract_string(inputs, '$.input_tokens'))
         AS DOUBLE)) AS BIGINT) AS input_tokens,
    CAST(trunc(TRY_CAST(coalesce(json_extract_string(outputs, '$.output_tokens'),
         json_extract_string(outputs, '$.output'), json_extract_string(inputs, '$.output_tokens'))
         AS DOUBLE)) AS BIGINT) AS output_tokens
  FROM {src} WHERE kind = 'llm-call'),
{name}_b AS (
  SELECT *, coalesce(nullif(im, ''), CASE WHEN strpos(coalesce(name, ''), ':') > 0
      THEN substr(name, strpos(name, ':') + 1) ELSE coalesce(name, '') END) AS model_id
  FROM {name}_a),
{name}_c AS (
  SELECT b.*,
    CASE WHEN p1.model IS NOT NULL THEN p1.model WHEN p2.model IS NOT NULL THEN p2.model ELSE p3.model END AS pm,
    CASE WHEN p1.model IS NOT NULL THEN p1.provider WHEN p2.model IS NOT NULL THEN p2.provider ELSE p3.provider END AS pp,
    CASE WHEN p1.model IS NOT NULL THEN p1.in_per_m WHEN p2.model IS NOT NULL THEN p2.in_per_m ELSE p3.in_per_m END AS pin,
    CASE WHEN p1.model IS NOT NULL THEN p1.out_per_m WHEN p2.model IS NOT NULL THEN p2.out_per_m ELSE p3.out_per_m END AS pout
  FROM {name}_b b
  LEFT JOIN prices p1 ON p1.model = nullif(b.model_id, '')
  LEFT JOIN prices p2 ON p2.model = CASE WHEN strpos(b.model_id, ':') > 0
                                        THEN substr(b.model_id, strpos(b.model_id, ':') + 1) END
  LEFT JOIN price_defaults d ON d.provider = lower(b.ip)
  LEFT JOIN prices p3 ON p3.model = d.model),
{name} AS (
  SELECT trace_id, step_id, started_at, model_id, input_tokens, output_tokens,
    CASE WHEN input_tokens IS NOT NULL AND output_tokens IS NOT NULL AND pm IS NOT NULL
      THEN CAST(greatest(0, input_tokens) AS HUGEINT) * CAST(round(pin * 1000000) AS HUGEINT)
         + CAST(greatest(0, output_tokens) AS HUGEINT) * CAST(round(pout * 1000000) AS HUGEINT)
    END AS cost_pico,
    pm, pp
  FROM {name}_c),
{name}_x AS (
  SELECT trace_id, step_id, started_at, model_id, input_tokens, output_tokens, cost_pico,
    CAST(cost_pico AS DOUBLE) / 1e12 AS cost_usd,
    CASE WHEN cost_pico IS NOT NULL THEN pm END AS price_model,
    CASE WHEN cost_pico IS NOT NULL THEN pp END AS price_provider
  FROM {name})
"""


def strict_sql(src: str, model_from_name: bool = True) -> str:
    """Oracle CTE items: strict pricing (JSON integer tokens from outputs,
    no provider fallback)."""
    model = ("coalesce(nullif(json_extract_string(inputs, '$.model'), ''), "
             "CASE WHEN strpos(coalesce(name, ''), ':') > 0 THEN substr(name, strpos(name, ':') + 1) "
             "ELSE coalesce(name, '') END)") if model_from_name else \
        "nullif(json_extract_string(inputs, '$.model'), '')"
    return f""",
{sqlvals.PRICES},
st_a AS (
  SELECT trace_id, step_id, {model} AS model_id,
    CASE WHEN json_type(outputs, '$.input_tokens') IN ('BIGINT', 'UBIGINT')
         THEN CAST(json_extract_string(outputs, '$.input_tokens') AS BIGINT) END AS input_tokens,
    CASE WHEN json_type(outputs, '$.output_tokens') IN ('BIGINT', 'UBIGINT')
         THEN CAST(json_extract_string(outputs, '$.output_tokens') AS BIGINT) END AS output_tokens,
    json_extract_string(outputs, '$.rate_limited') AS rl, json_extract_string(outputs, '$.status') AS status
  FROM {src} WHERE kind = 'llm-call'),
strict AS (
  SELECT a.*,
    CASE WHEN input_tokens IS NOT NULL AND output_tokens IS NOT NULL
          AND coalesce(p1.model, p2.model) IS NOT NULL
      THEN CAST(greatest(0, input_tokens) AS HUGEINT) * CAST(round(coalesce(p1.in_per_m, p2.in_per_m) * 1000000) AS HUGEINT)
         + CAST(greatest(0, output_tokens) AS HUGEINT) * CAST(round(coalesce(p1.out_per_m, p2.out_per_m) * 1000000) AS HUGEINT)
    END AS cost_pico,
    CASE WHEN (rl IS NOT NULL AND rl NOT IN ('false', '', '0', '[]', '{{}}')
               AND coalesce(TRY_CAST(rl AS DOUBLE), 1) <> 0)
           OR TRY_CAST(status AS DOUBLE) = 429 THEN 1 ELSE 0 END AS rl_flag
  FROM st_a a
  LEFT JOIN prices p1 ON p1.model = a.model_id
  LEFT JOIN prices p2 ON p2.model = CASE WHEN strpos(a.model_id, ':') > 0
                                        THEN substr(a.model_id, strpos(a.model_id, ':') + 1) END)
"""


@register("price_steps", ["ev_steps"], priced_sql("ev_steps") + """
SELECT trace_id, step_id, model_id, input_tokens, output_tokens, price_model, price_provider,
  round(cost_usd, 9) AS cost_usd FROM priced_x""")
def q_price_steps(fx):
    """Every llm-call step priced by the 3-step fallback (exact model, model
    after the first colon, provider default)."""
    p = costs.price_steps(fx.get("ev_steps"))
    return p.select("trace_id", "step_id", "model_id", "input_tokens", "output_tokens",
                    "price_model", "price_provider", F.round("cost_usd", 9).alias("cost_usd"))


@register("canonical_tokens", ["ev_steps"], """
SELECT step_id,
  CAST(trunc(TRY_CAST(coalesce(json_extract_string(outputs, '$.input_tokens'),
       json_extract_string(outputs, '$.input'), json_extract_string(inputs, '$.input_tokens'))
       AS DOUBLE)) AS BIGINT) AS input_tokens,
  CAST(trunc(TRY_CAST(coalesce(json_extract_string(outputs, '$.output_tokens'),
       json_extract_string(outputs, '$.output'), json_extract_string(inputs, '$.output_tokens'))
       AS DOUBLE)) AS BIGINT) AS output_tokens
FROM ev_steps""")
def q_canonical_tokens(fx):
    """Token counts of every step from the first non-null payload location."""
    s = fx.get("ev_steps")
    tin, tout = P.canonical_tokens("inputs", "outputs")
    return s.select("step_id", tin.alias("input_tokens"), tout.alias("output_tokens"))


@register("model_id", ["ev_steps"], """
SELECT step_id, coalesce(nullif(json_extract_string(inputs, '$.model'), ''),
  CASE WHEN strpos(coalesce(name, ''), ':') > 0 THEN substr(name, strpos(name, ':') + 1)
       ELSE coalesce(name, '') END) AS model_id
FROM ev_steps""")
def q_model_id(fx):
    """Model used for pricing: inputs.model, else the name after its first colon."""
    s = fx.get("ev_steps")
    ins = P.fields("inputs", "model")
    return s.select("step_id", P.model_id(ins["model"], F.col("name")).alias("model_id"))


@register("cost_rollup", ["ev_steps", "ev_traces"], priced_sql("ev_steps") + """
SELECT CAST(count(*) AS BIGINT) AS llm_calls, CAST(count(cost_usd) AS BIGINT) AS priced_steps,
  CAST(count(*) - count(cost_usd) AS BIGINT) AS unpriced_steps,
  coalesce(USD(sum(cost_pico)), 0) AS total_usd,
  (SELECT CAST(count(*) AS BIGINT) FROM ev_traces) AS trace_count
FROM priced_x""")
def q_cost_rollup(fx):
    """Total spend, priced and unpriced llm calls, traces scanned."""
    return costs.cost_rollup(costs.price_steps(fx.get("ev_steps")), fx.get("ev_traces"))


@register("cost_by_dimension", ["ev_steps"], priced_sql("ev_steps") + """
SELECT CASE WHEN grouping(price_provider, price_model) = 1 THEN 'provider'
            WHEN grouping(price_provider, price_model) = 2 THEN 'model' ELSE 'total' END AS dimension,
  coalesce(price_provider, price_model, 'total') AS label,
  USD(sum(cost_pico)) AS usd, CAST(count(*) AS BIGINT) AS calls
FROM priced_x WHERE cost_usd IS NOT NULL
GROUP BY GROUPING SETS ((price_provider), (price_model), ())""")
def q_cost_by_dimension(fx):
    """Spend by provider, by model (price-row labels) and in total."""
    return costs.cost_by_dimension(costs.price_steps(fx.get("ev_steps")))


@register("cost_desc", ["ev_steps"], priced_sql("ev_steps") + """
SELECT 'provider' AS dimension, price_provider AS label, USD(sum(cost_pico)) AS usd,
  CAST(count(*) AS BIGINT) AS calls
FROM priced_x WHERE cost_usd IS NOT NULL GROUP BY price_provider
UNION ALL
SELECT 'model', price_model, USD(sum(cost_pico)), CAST(count(*) AS BIGINT)
FROM priced_x WHERE cost_usd IS NOT NULL GROUP BY price_model
UNION ALL
SELECT 'total', 'total', USD(sum(cost_pico)), CAST(count(*) AS BIGINT)
FROM priced_x WHERE cost_usd IS NOT NULL
ORDER BY dimension, usd DESC, label""")
def q_cost_desc(fx):
    """Spend breakdown ordered by cost, highest first."""
    return costs.cost_desc(costs.cost_by_dimension(costs.price_steps(fx.get("ev_steps"))))


@register("cost_per_trace", ["ev_steps", "ev_traces"], priced_sql("ev_steps") + """
SELECT p.trace_id, t.started_at, USD(sum(p.cost_pico)) AS usd
FROM priced_x p JOIN ev_traces t ON p.trace_id = t.trace_id
WHERE p.cost_usd IS NOT NULL AND t.started_at IS NOT NULL
GROUP BY p.trace_id, t.started_at HAVING sum(p.cost_pico) > 0""")
def q_cost_per_trace(fx):
    """Spend subtotal per trace (positive subtotals of traces with a start)."""
    return costs.cost_per_trace(costs.price_steps(fx.get("ev_steps")), fx.get("ev_traces"))


@register("cost_timeseries", ["ev_steps", "ev_traces"], strict_sql("ev_steps") + f"""
, spine AS (
  SELECT CAST(d AS DATE) AS date FROM range(
    CAST(make_timestamp(CAST({AS_OF} * 1000000 AS BIGINT)) AS DATE) - INTERVAL 13 DAY,
    CAST(make_timestamp(CAST({AS_OF} * 1000000 AS BIGINT)) AS DATE) + INTERVAL 1 DAY,
    INTERVAL 1 DAY) r(d)),
per_day AS (
  SELECT CAST(make_timestamp(CAST(t.started_at * 1000000 AS BIGINT)) AS DATE) AS date,
    sum(s.cost_pico) AS usd, count(*) AS calls, sum(s.rl_flag) AS rl
  FROM strict s JOIN ev_traces t ON s.trace_id = t.trace_id
  WHERE t.started_at IS NOT NULL GROUP BY 1)
SELECT CAST(spine.date AS VARCHAR) AS date, coalesce(USD(usd), 0) AS usd,
  CAST(coalesce(calls, 0) AS BIGINT) AS calls, CAST(coalesce(rl, 0) AS BIGINT) AS rate_limited
FROM spine LEFT JOIN per_day ON spine.date = per_day.date""")
def q_cost_timeseries(fx):
    """14-day zero-filled daily spend (strict pricing), calls, rate limits."""
    return costs.cost_timeseries(fx.get("ev_steps"), fx.get("ev_traces"), AS_OF, days=14)


@register("activity_24h", ["ev_steps", "ev_traces"], strict_sql("ev_steps", model_from_name=False) + f"""
, pt AS (SELECT trace_id, count(*) AS calls, sum(cost_pico) AS usd FROM strict GROUP BY trace_id),
tt AS (
  SELECT t.*, (t.started_at >= {AS_OF} - 86400 AND t.started_at <= {AS_OF}) AS recent,
    coalesce(json_extract_string(t.metadata, '$.failed') = 'true', false) AS failed,
    pt.calls, pt.usd
  FROM ev_traces t LEFT JOIN pt ON t.trace_id = pt.trace_id)
SELECT CAST(count(*) AS BIGINT) AS traces, max(coalesce(ended_at, started_at)) AS last_capture_at,
  CAST(coalesce(sum(CASE WHEN recent THEN calls END), 0) AS BIGINT) AS calls_24h,
  coalesce(USD(sum(CASE WHEN recent THEN usd END)), 0) AS cost_24h,
  CAST(sum(CASE WHEN recent AND failed THEN 1 ELSE 0 END) AS BIGINT) AS failures_24h
FROM tt""")
def q_activity_24h(fx):
    """Traces, last capture, and calls / cost / failures of the last 24 h."""
    return costs.activity_24h(fx.get("ev_traces"), fx.get("ev_steps"), AS_OF)


@register("cost_by_day", ["ev_steps"], priced_sql("ev_steps") + """
SELECT CAST(CAST(make_timestamp(CAST(started_at * 1000000 AS BIGINT)) AS DATE) AS VARCHAR) AS day,
  price_provider, price_model, USD(sum(cost_pico)) AS usd, CAST(count(*) AS BIGINT) AS calls
FROM priced_x WHERE cost_usd IS NOT NULL GROUP BY 1, 2, 3""")
def q_cost_by_day(fx):
    """Spend by day x provider x model."""
    return costs.cost_by_day(costs.price_steps(fx.get("ev_steps")), fx.get("ev_traces"))
