"""Trigram index, key filter, tables by day, annotation listing and removal."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agentrail.operators import annotations as A
from agentrail.operators import costs
from agentrail.operators import joins as J
from agentrail.operators import relational as R
from agentrail.operators import search_index as SI
from agentrail.sinks import by_day
from agentrail.sinks.buckets import BucketTable

TRACE = "trace_id string, name string, framework string, started_at double, ended_at double, metadata string"
STEP = ("trace_id string, step_id string, step_index int, kind string, name string, started_at double, ended_at double, "
        "inputs string, outputs string, error string")
NOTE = "trace_id string, step_id string, failure_category string, severity string, notes string"

HEADS = [("t1", "Plan a Trip", "crewai"), ("t2", None, None), ("t3", "ÄRGER 𝒳 mail", "dspy"), ("t4", "", "crewai"), ("t5", "plan", "x")]
WORK = [("t1", "tool", "fetch", None), ("t2", "llm-call", "openai:gpt", "HTTP 429: slow\ndown"), ("t2", "io", None, None),
        ("t4", "io", "x" * 200_000 + "plan a" + "y" * 200_000, None), ("t5", "io", "a trip", ""), ("gone", "io", "plan a", None)]


def _tables(spark, heads=HEADS, work=WORK):
    traces = spark.createDataFrame([(i, n, f, 1.0, 2.0, "{}") for i, n, f in heads], TRACE)
    steps = spark.createDataFrame([(t, f"s{i}", i, k, n, 1.0, 2.0, "{}", "{}", e) for i, (t, k, n, e) in enumerate(work)], STEP)
    return traces, steps, spark.createDataFrame([("t1", "s0", "loop", "low", None), ("t9", "s", "loop", "low", "n")], NOTE)


def _set(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("q", ["plan a", "PLAN A ", "429: slow\nd", "ärger 𝒳", "no such thing", "", "pl", "crewai t4", "x" * 90])
def test_indexed_search_gives_the_rows_of_the_scan(spark, tmp_path, q):
    traces, steps, notes = _tables(spark)
    index = SI.TraceIndex(spark, str(tmp_path / "i"), 4)
    assert index.candidates("plan a") is None
    index.add(traces, steps)
    assert _set(index.search(traces, steps, notes, q)) == _set(R.search_traces(traces, steps, notes, q))


def test_index_follows_changed_traces_and_replays_nothing(spark, tmp_path):
    traces, steps, notes = _tables(spark)
    index = SI.TraceIndex(spark, str(tmp_path / "i"), 4)
    tables = [BucketTable(spark, str(tmp_path / n), buckets=4) for n in ("t", "s")]
    for t, df in zip(tables, (traces, steps)):
        t.upsert(df)
    index.add(traces, steps, ("s", 0))
    new, work, _ = _tables(spark, [("t1", "sold out", "crewai"), ("t7", "plan a", "x")], [("t7", "io", "zebra", None)])
    for _ in range(2):
        version = index.add(new, work, ("s", 1))
    assert version == 2
    tables[0].upsert(new)
    tables[1].upsert(work)

    def both(q):
        got = index.search(*tables, notes, q)
        assert _set(got) == _set(R.search_traces(tables[0].read(), tables[1].read(), notes, q))
        return {r.trace_id for r in got.collect()}

    assert both("plan a") == {"t4", "t7"}           # t1 has another name now
    assert both("sold out") == {"t1"}
    assert both("zebra") == {"t7"}
    before = index.table.read().count()
    index.tidy()
    assert index.table.read().count() < before
    assert both("plan a") == {"t4", "t7"}


def test_a_query_opens_the_buckets_of_its_trigrams_only(spark, tmp_path):
    traces, steps, _ = _tables(spark)
    index = SI.TraceIndex(spark, str(tmp_path / "i"), 64)
    index.add(traces, steps)
    files = index.table.lookup(spark.createDataFrame([("pla",)], "gram string")).inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1


def test_append_keeps_old_rows_through_merge_compaction_and_expiry(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "b"), "k", 4)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    t.append(rows(("a", 1), ("b", 1)))
    t.append(rows(("a", 2), ("a", 1)))
    assert Counter(tuple(r) for r in t.read().collect()) == {("a", 1): 2, ("a", 2): 1, ("b", 1): 1}
    assert Counter(tuple(r) for r in t.read(1).collect()) == {("a", 1): 1, ("b", 1): 1}
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1, "a")], "v int, k string"))
    t.compact(distinct=True)
    t.upsert(rows(("b", 5)))
    t.expire(keep=1)
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", 1), ("a", 2), ("b", 5)]
    t.append(rows().limit(0))
    assert t.read().count() == 3


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=40))
def test_every_trigram_of_a_text_is_posted(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(SI.grams(F.col("x")).alias("g")).first().g
    assert set(SI.query_grams(text)) <= set(got) and len(got) == len(set(got))


def test_key_filter_loses_no_key_and_drops_most_others(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("trace_id"), F.lit("s").alias("step_id"),
                                      F.lit(1).alias("_word"), F.lit("x").alias("_bits"))
    keys = rows.where("id % 100 = 0") if "id" in rows.columns else rows.where("cast(trace_id as int) % 100 = 0")
    on = ["trace_id", "step_id"]
    for words in (1 << 20, 1):            # a filter that is too small passes everything
        out = J.may_match(rows, keys, on, words)
        assert out.columns == rows.columns
        assert out.join(keys.select(*on), on, "left_semi").count() == 200
    assert J.may_match(rows, keys, on).count() < 220
    assert J.may_match(rows, keys.limit(0), on).count() == 0


def test_annotated_steps_drops_other_steps_before_the_shuffle(spark):
    steps = _tables(spark)[1]
    notes = spark.createDataFrame([("t2", "s1", "loop", "low", None), ("t2", "none", "loop", "low", None)], NOTE)
    out = J.join_annotated_steps(steps, notes.withColumnRenamed("notes", "n"))
    assert [(r.trace_id, r.step_id, r.error) for r in out.collect()] == [("t2", "s1", "HTTP 429: slow\ndown")]


DAY = 86400.0


def _dated(spark):
    call = '{"model":"gpt-4o"}', '{"input_tokens":1000000,"output_tokens":0}'
    traces = [("old", 5.5 * DAY), ("edge", 10 * DAY), ("in", 12.9 * DAY), ("next", 13 * DAY), ("open", None)]
    steps = [("old", 5.5), ("edge", 3.0), ("in", 40.0), ("next", 12.5), ("open", 12.5), ("lost", 12.5), ("in", 12.9)]
    t = spark.createDataFrame([(i, "n", "f", s, None, '{"failed":true}') for i, s in traces], TRACE)
    s = spark.createDataFrame([(i, f"s{n}", n, "llm-call", "openai:gpt-4o", d * DAY, None, *call, None)
                               for n, (i, d) in enumerate(steps)], STEP)
    return t, s


def test_back_dated_steps_count_on_the_day_of_their_trace(spark, tmp_path):
    t, s = _dated(spark)
    by_day.write_by_day(t, s, str(tmp_path / "d"))
    t2, s2 = by_day.read_by_day(spark, str(tmp_path / "d"))
    assert (t2.count(), s2.count()) == (5, 7)
    want = [("1970-01-11", 1), ("1970-01-12", 0), ("1970-01-13", 2)]
    for steps, traces in ((s, t), (s2, t2)):
        got = costs.cost_timeseries(steps, traces, 12.2 * DAY, days=3)
        assert sorted((r.date, r.calls) for r in got.collect()) == want
        r = costs.activity_24h(traces, steps, 13 * DAY).first()
        assert (r.traces, r.calls_24h, r.failures_24h) == (5, 3, 2)
    plan = costs.cost_timeseries(s2, t2, 12.2 * DAY, days=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(start_day") >= 2
    with pytest.raises(ValueError):
        by_day.write_by_day(t2, s, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        costs.cost_timeseries(s, t, 0.0, days=0)


def test_removal_of_annotations(spark):
    steps = spark.createDataFrame([("t", "ab1", 1), ("t", "ab2", 0), ("t", "c", 2), ("u", "ab1", 0), ("t", None, 3)],
                                  "trace_id string, step_id string, step_index int")
    notes = spark.createDataFrame([("t", "ab1", "loop", "low", "x"), ("t", "ab2", "loop", "low", ""), ("u", "ab1", "loop", "low", None),
                                   ("t", "zz", "loop", "low", None)], NOTE)
    asked = [("t", "ab"), ("t", "ab"), ("t", "zz"), ("t", "c"), ("u", "*"), (None, "ab"), ("t", None), ("v", "ab")]
    left, outcome = A.remove_annotations(notes, steps, spark.createDataFrame(asked, "trace_id string, step_ref string"))
    assert sorted((r.trace_id, r.step_id) for r in left.collect()) == [("t", "ab1"), ("u", "ab1")]
    assert sorted(tuple(r) for r in outcome.collect()) == [
        ("t", "ab", "ab2", True), ("t", "c", "c", False), ("t", "zz", "zz", True), ("u", "*", "*", False), ("v", "ab", "ab", False)]
    left, outcome = A.clear_annotations(notes, spark.createDataFrame([("t",), ("t",), ("q",), (None,)], "trace_id string"))
    assert [tuple(r)[:2] for r in left.collect()] == [("u", "ab1")]
    assert sorted(tuple(r) for r in outcome.collect()) == [("q", False), ("t", True)]


def test_listing_of_annotations(spark):
    notes = spark.createDataFrame([("t" * 20, "s" * 20, "loop", "low", ""), ("gone", "s", "loop", "low", "n")], NOTE)
    traces = spark.createDataFrame([("t" * 20,), ("u",)], "trace_id string")
    r, = A.list_annotations(notes, traces).collect()
    assert (r.trace, r.step, r.notes, r.trace_id) == ("t" * 12, "s" * 12, "—", "t" * 20)
    assert A.list_annotations(notes, traces, "u").count() == 0
