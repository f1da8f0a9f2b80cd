"""Pricing rules restated as expected-row tests."""

import pytest
from pyspark.sql import functions as F

from agentrail.operators import costs

COLS = "trace_id string, step_id string, kind string, name string, inputs string, outputs string, started_at double"


def _price(spark, rows, mode="rollup", **kw):
    df = spark.createDataFrame(rows, COLS)
    return {r.step_id: r for r in costs.price_steps(df, mode=mode, **kw).collect()}


def _step(sid, name="x", model=None, provider=None, tin=None, tout=None, outputs=None):
    import json
    ins = {}
    if model is not None:
        ins["model"] = model
    if provider is not None:
        ins["provider"] = provider
    outs = outputs if outputs is not None else json.dumps({"input_tokens": tin, "output_tokens": tout})
    return ("t", sid, "llm-call", name, json.dumps(ins), outs, 1.0)


def test_price_fallbacks(spark):
    got = _price(spark, [
        _step("exact", model="gemini-2.5-flash", tin=10, tout=10),
        _step("prefixed", model="anthropic:claude-haiku-4-5", tin=10, tout=10),
        _step("from_name", name="openai:gpt-4o", tin=10, tout=10),
        _step("provider_default", model="brand-new-experimental-claude", provider="Anthropic", tin=10, tout=10),
        _step("unknown", model="unknown-model", provider="unknown-provider", tin=10, tout=10),
        _step("no_tokens", model="gpt-4o-mini", tin=None, tout=100),
    ])
    assert got["exact"].price_provider == "gemini"
    assert got["prefixed"].price_model == "claude-haiku-4-5"
    assert got["from_name"].price_model == "gpt-4o"
    assert got["provider_default"].price_model == "claude-haiku-4-5"
    assert got["unknown"].cost_usd is None
    assert got["no_tokens"].cost_usd is None


def test_cost_math_and_negative_clamp(spark):
    got = _price(spark, [
        _step("m", model="gpt-4o-mini", tin=1_000_000, tout=1_000_000),
        _step("neg", model="gpt-4o-mini", tin=-100, tout=500),
    ])
    assert got["m"].cost_usd == pytest.approx(0.75)
    assert got["neg"].cost_usd == pytest.approx(500 / 1_000_000 * 0.60)


def test_zero_tokens_are_kept_and_other_locations_read(spark):
    got = _price(spark, [
        _step("zero", model="gpt-4o", outputs='{"input_tokens":0,"output_tokens":0,"input":99}'),
        _step("alt", model="gpt-4o", outputs='{"input":100,"output":50}'),
    ])
    assert got["zero"].input_tokens == 0 and got["zero"].cost_usd == 0.0
    assert (got["alt"].input_tokens, got["alt"].output_tokens) == (100, 50)


def test_strict_mode_needs_integer_tokens_and_no_provider_fallback(spark):
    got = _price(spark, [
        _step("float_tok", model="gpt-4o", outputs='{"input_tokens":10.5,"output_tokens":3}'),
        _step("text_tok", model="gpt-4o", outputs='{"input_tokens":"10","output_tokens":3}'),
        _step("ok", model="gpt-4o", outputs='{"input_tokens":10,"output_tokens":3}'),
        _step("prov_only", model="mystery", provider="openai", tin=10, tout=3),
    ], mode="strict")
    assert got["float_tok"].cost_usd is None
    assert got["text_tok"].cost_usd is None
    assert got["ok"].cost_usd is not None
    assert got["prov_only"].cost_usd is None


def test_usd_rounding_is_half_up_on_exact_decimals(spark):
    # 625 pico-dollar steps: 0.0000005 rounds half up to 0.000001
    df = spark.createDataFrame([(500000,), (250000,), (250000,)], "p long")
    v = df.agg(costs.usd(F.sum(F.col("p").cast("decimal(38,0)"))).alias("u")).collect()[0].u
    assert v == 0.000001


def test_format_usd(spark):
    from agentrail.functions.text import format_usd
    df = spark.createDataFrame([(None,), (0.0,), (0.00005,), (0.0023,), (1234.5,)], "c double")
    got = [r.f for r in df.select(format_usd("c").alias("f")).collect()]
    assert got == ["—", "$0.00", "<$0.0001", "$0.0023", "$1,234.50"]
