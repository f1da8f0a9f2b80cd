"""OTLP ids, times, kinds and status."""

from pyspark.sql import functions as F

from agentrail.sinks import exports as X

STEP_COLS = ("trace_id string, step_id string, step_index int, parent_step_id string, kind string, "
             "name string, started_at double, ended_at double, inputs string, outputs string, "
             "metadata string, error string")


def test_ids_are_normalised(spark):
    df = spark.createDataFrame([("ABC-123", "S0001", "xyz"), ("a" * 40, "b" * 20, None)], "t string, s string, p string")
    got = df.select(X.otlp_trace_id("t").alias("t"), X.otlp_span_id("s").alias("s")).collect()
    assert got[0].t == "0" * 26 + "abc123" and got[0].s == "0001" + "0" * 12
    assert got[1].t == "a" * 32 and got[1].s == "b" * 16


def test_span_kind_status_and_nanos(spark):
    rows = [
        ("t1", "s1", 0, None, "llm-call", "anthropic:claude", 1.5, 2.0,
         '{"provider":"anthropic","model":"claude-haiku-4-5","max_tokens":64,"stream":true}',
         '{"status":200,"input_tokens":5,"output_tokens":2,"stop_reason":"end_turn"}', '{"transport":"proxy"}', None),
        ("t1", "s2", 1, "s1", "tool-call", "search", 2.0, None, "{}", '{"status":503}', "{}", None),
        ("t1", None, 2, None, "thought", "", 2.5, 2.6, "{}", "{}", "{}", "boom"),
    ]
    sp = {r.step_index: r for r in X.spans(spark.createDataFrame(rows, STEP_COLS)).collect()}
    assert sp[0].kind == 3 and sp[0].status_code == 1 and sp[0].start_unix_nano == "1500000000"
    assert '"gen_ai.request.streaming","value":{"boolValue":true}' in sp[0].attributes_json
    assert '"gen_ai.response.finish_reason","value":{"stringValue":"end_turn"}' in sp[0].attributes_json
    assert sp[1].kind == 3 and sp[1].status_code == 2 and sp[1].status_message == "upstream returned 503"
    assert sp[1].end_unix_nano == sp[1].start_unix_nano          # open step ends at its start
    assert sp[1].parent_span_id_hex == "1" + "0" * 15
    assert sp[2].kind == 1 and sp[2].status_message == "boom" and sp[2].name == "thought"
    assert len(sp[2].span_id_hex) == 16                          # stable id for a missing step id
