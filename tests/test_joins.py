"""Lookups with repeated keys multiply no rows; whole texts and integers."""

import json

from pyspark.sql import functions as F

from agentrail import dims
from agentrail.functions import text as TX
from agentrail.operators import joins as J
from agentrail.operators import relational as R
from agentrail.sinks import exports as X


def test_repeated_explanations_give_one_row(spark):
    feats = spark.createDataFrame([("m", "blocks.3.hook_resid_pre", 1)], "model string, layer string, feature_id int")
    expl = spark.createDataFrame([("m", "3-res-jb", 1, "b"), ("m", "3-res-jb", 1, "a")],
                                 "model string, layer string, feature_id int, text string")
    assert [r.description for r in J.join_feature_explanations(feats, expl).collect()] == ["a"]


def test_parent_delivered_twice_gives_one_row_a_step(spark):
    rows = [("t", "p", 0, None, "plan", "first", "{}"), ("t", "p", 1, None, "plan", "second", "{}"),
            ("t", "c", 2, "p", "io", "child", "{}")]
    steps = spark.createDataFrame(rows, "trace_id string, step_id string, step_index int, parent_step_id string, "
                                        "kind string, name string, metadata string")
    out = J.link_parents(steps).collect()
    assert len(out) == 3
    assert [r.parent_name for r in out if r.step_id == "c"] == ["first"]


def test_integers_above_two_to_the_53_keep_every_digit(spark):
    got = spark.createDataFrame([("9007199254740993",), ('"9007199254740993"',), ("7.9",), ("true",)], "j string").select(
        X.safe_int_v(F.try_parse_json("j")).alias("n")).collect()
    assert [r.n for r in got] == [9007199254740993, 9007199254740993, 7, None]


def test_prompts_and_replies_stay_whole(spark):
    long = "x" * 20_000
    r = spark.createDataFrame([(json.dumps({"prompt": long}), json.dumps({"text": long}))], "i string, o string").select(
        TX.prompt_text("i").alias("p"), TX.response_text("o").alias("r"), TX.prompt_text("i", 10).alias("cut")).first()
    assert (r.p, r.r, r.cut) == (long, long, long[:10])


def _outcomes(spark, n, **limit):
    ids = [f"u{i:05d}" for i in range(n)]
    traces = spark.createDataFrame([(i,) for i in ids], "trace_id string")
    req = spark.createDataFrame([(1, p, i) for p, i in enumerate(ids)] + [(2, 0, ids[0]), (2, 1, "nope")],
                                "batch_id int, req_pos bigint, id string")
    return sorted((r.batch_id, r.req_pos, r.outcome, r.trace_id) for r in
                  J.bulk_delete_split(traces, req, **limit).collect())


def test_delete_batches_of_any_size_are_resolved(spark):
    assert _outcomes(spark, 501) == [(1, p, "deleted", f"u{p:05d}") for p in range(501)] + [
        (2, 0, "deleted", "u00000"), (2, 1, "not_found", None)]


def test_delete_batch_over_an_explicit_limit_is_rejected(spark):
    assert _outcomes(spark, 4, max_ids=3) == [(1, p, "rejected", None) for p in range(4)] + [
        (2, 0, "deleted", "u00000"), (2, 1, "not_found", None)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


HOSTS = ["api.openai.com", "eu.api.openai.com", "notapi.openai.com.evil", "xapi.openai.com", "", None, "API.Groq.com",
         "bedrock-runtime.eu.amazonaws.com", "x.openai.azure.com", "localhost", "nowhere.example"]


def _brute(host, rules):
    h = (host or "").lower()
    for label, pattern, strategy in rules:
        if h and (pattern in h if strategy == "contains" else h == pattern or h.endswith("." + pattern)):
            return label
    return None


def test_provider_lookup_is_one_expression(spark):
    calls = spark.createDataFrame([(h, "/v1/messages") for h in HOSTS], "host string, path string")
    rules = [(p[0], p[1], p[4]) for p in dims.PROVIDERS]
    out = J.detect_provider(calls)
    assert {(r.host, r.provider) for r in out.collect()} == {(h, _brute(h, rules)) for h in HOSTS}
    surrogates = J.match_surrogate(calls.withColumn("model", F.lit("claude-opus-4")))
    for df in (out, J.detect_provider_path(calls), surrogates):
        assert "Join" not in _plan(df) and "Exchange" not in _plan(df)
    assert {r.surrogate for r in surrogates.collect()} == {"gpt2-small"}


def test_providers_of_a_user_list_short_or_long(spark, monkeypatch):
    rows = [(3, "late", "openai.com", "suffix"), (1, "part", "groq", "contains"), (2, "early", "api.openai.com", "suffix")]
    mine = spark.createDataFrame(rows, "priority int, label string, host_pattern string, strategy string")
    calls = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    want = {(h, _brute(h, [r[1:] for r in sorted(rows)])) for h in HOSTS}
    assert {tuple(r) for r in J.detect_provider(calls, "host", mine).collect()} == want
    monkeypatch.setattr(J, "MOST_LITERALS", 2)
    assert {tuple(r) for r in J.detect_provider(calls, "host", mine).collect()} == want


def test_prefixes_cross_the_join_as_trie_nodes(spark):
    traces = spark.createDataFrame([(f"a{i:03d}",) for i in range(200)] + [("b1",)], "trace_id string")
    asked = spark.createDataFrame([("a",), ("a",), ("a01",), ("b1",), ("b1x",), ("",), ("a/",), (None,)], "prefix string")
    got = sorted(((r.prefix, r.valid, r.trace_id, r.matches, r.ambiguous) for r in R.resolve_prefixes(traces, asked).collect()), key=str)
    assert got == sorted([("a", True, "a000", 200, True)] * 2 + [
        ("a01", True, "a010", 10, True), ("b1", True, "b1", 1, False), ("b1x", True, None, 0, False), ("", False, None, 0, False),
        ("a/", False, None, 0, False), (None, False, None, 0, False)], key=str)
