"""Case files, step callbacks and token names."""

import json

from pyspark.sql import functions as F

from agentrail.functions import payload as P
from agentrail.operators import costs
from agentrail.sinks import exports as X
from agentrail.sources import http as H
from agentrail.streaming import jobs as S

STEP = ("trace_id string, step_id string, step_index int, kind string, name string, started_at double, ended_at double, "
        "inputs string, outputs string, error string")


def _files(spark, traces, steps, notes):
    t = spark.createDataFrame(traces, "trace_id string, name string, framework string, started_at double, ended_at double, metadata string")
    s = spark.createDataFrame(steps, STEP)
    a = spark.createDataFrame(notes, "trace_id string, step_id string, failure_category string, severity string, notes string, "
                                     "mitigation string, annotator string, tags array<string>, circuit_attribution string, seq int")
    return {r.trace_id: r.markdown for r in X.case_files(t, s, a).collect()}


def test_case_file_has_every_failing_step_with_payloads_and_annotation(spark):
    got = _files(spark, [("t" * 14, "job", None, 0.0, 1.5, '{"failed": true, "error": "boom"}')],
                 [("t" * 14, "b", 1, "io", "a|b", 1.0, None, "{}", "null", "second"),
                  ("t" * 14, "a", 0, "tool", "fetch", 0.0, 0.25, '{"z": 1, "a": [2]}', '{"k":"v"}', "first"),
                  ("t" * 14, "c", 2, "io", None, None, None, None, None, "")],
                 [("t" * 14, "a", "loop", "low", "why", None, "me", ["x", "y"], None, 2),
                  ("t" * 14, "gone", "other", "high", None, "retry", None, None, None, 1)])["t" * 14]
    head, _, detail = got.partition("## Failure detail")
    assert head.startswith("# Case File · job\n\n> `tttttttttttt` · untagged · 1970-01-01 00:00:00 · 1500 ms · **❗ failed**\n")
    assert "## Top-level error\n```\nboom\n```" in head
    assert head.index("### other · high") < head.index("### loop · low")
    for line in ("**Mitigation:** retry", "**Tags:** x, y", "*— annotated by me*",
                 "| 1 | `tool` | fetch ◉ | 250.0 ms | **failed** |", "| 2 | `io` | a\\|b | 0.0 ms | **failed** |",
                 "| 3 | `io` |  | 0.0 ms | ok |"):
        assert line in head, line
    first, second = detail.split("### Step ")[1:]
    assert first.startswith("`fetch` (tool)\n```\nfirst\n```")
    assert '**Inputs**\n```json\n{"z":1,"a":[2]}\n```' in first and '**Outputs**\n```json\n{"k":"v"}\n```' in first
    assert json.loads(first.partition("**Annotation**\n```json\n")[2].partition("\n```")[0])["notes"] == "why"
    assert second.strip() == "`a|b` (io)\n```\nsecond\n```"


def test_case_file_of_a_trace_without_steps_or_fields(spark):
    got = _files(spark, [("x", None, None, None, None, None)], [("y", "s", 0, "io", "n", None, None, None, None, "e")],
                 [("y", None, None, None, None, None, None, None, None, None)])
    assert got["x"].startswith("# Case File · (unnamed)\n\n> `x` · untagged · — · 0 ms · **✓ ok**\n")
    assert "Failure" not in got["x"] and "Annotations" not in got["x"]


def test_callbacks_are_counted_in_the_shared_folder(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("step_index"), F.when(F.col("id") % 4 > 0, 1.0).alias("ended_at"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = S.parquet_stream(spark, str(tmp_path / "in"), rows.schema, max_files=1)

    def call(row):
        if row["step_index"] % 10 == 1:
            raise ValueError

    S.tail(stream, call, str(tmp_path / "c"), report=str(tmp_path / "r")).awaitTermination()
    report = S.tail_report(spark, str(tmp_path / "r")).collect()
    assert len(report) == 4 and sum(r.calls for r in report) == 30
    assert sum(r.failures for r in report) == 4


def test_openai_token_names_are_read_when_asked_for(spark):
    out = '{"prompt_tokens": 1000000, "completion_tokens": 0}'
    s = spark.createDataFrame([("t", "s", 0, "llm-call", "x", 0.0, 1.0, '{"model": "gpt-4o"}', out, None)], STEP)
    assert [s.select(*P.canonical_tokens("inputs", "outputs", more)).first()[0] for more in (False, True)] == [None, 1000000]
    assert costs.price_steps(s).first().cost_usd is None
    assert costs.price_steps(s, include_openai_names=True).first().cost_usd > 0


def test_error_texts_are_whole_unless_a_limit_is_given(spark):
    long = "x" * 5_000
    r = spark.createDataFrame([(500, long), (200, long)], "status int, body string").select(
        *[H.error_message(F.col("status"), F.col("body"), F.try_parse_json("body"), n).alias(f"e{n}") for n in (None, 20)]).collect()
    assert [tuple(x) for x in r] == [("HTTP 500: " + long, "HTTP 500: " + "x" * 10), (None, None)]


def test_leaderboard_entry_and_records(spark):
    from agentrail.sinks.exports import leaderboard_entry, leaderboard_records
    ddl = "id string, ok boolean, error string"
    cats = spark.createDataFrame([("a", "loop"), ("b", "loop"), ("c", "off")], "id string, category string")
    res = spark.createDataFrame([("a", True, None), ("b", False, "x"), ("c", None, 'q"'), ("d", True, None)], ddl)
    e = leaderboard_entry(res, cats, "c.jsonl", 4, "p", "m", 1706659200.0, "2").first()
    assert (e.corpus, e.corpus_size, e.provider, e.model, e.version) == ("c.jsonl", 4, "p", "m", "2")
    assert (e.total, e.replayed, e.errors, e.fail_rate) == (4, 2, 2, 0.5)
    assert {k: tuple(v) for k, v in e.categories.items()} == {"loop": (1, 1), "off": (0, 1), "unknown": (1, 0)}
    assert e.timestamp == "2024-01-31T00:00:00+00:00"
    lines = {r.id: r.line for r in leaderboard_records(res).collect()}
    assert lines == {"a": '{"id":"a","ok":true}', "b": '{"id":"b","ok":false,"error":"x"}',
                     "c": '{"id":"c","ok":false,"error":"q\\""}', "d": '{"id":"d","ok":true}'}
    none = leaderboard_entry(res.limit(0), cats, "c", 0, "p", "m", 0.0).first()
    assert (none.total, none.fail_rate, none.categories) == (0, 0.0, {})
