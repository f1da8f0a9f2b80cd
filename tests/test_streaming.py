"""Stream = batch on the same input."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from agentrail.operators import costs
from agentrail.plans.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_daily_cost_stream_equals_batch(spark):
    streamed = {r.date: (r.usd, r.calls, r.rate_limited)
                for r in E.queries()["stream_daily_cost"](spark, SF).collect()}
    fx = Fixtures(spark, SF)
    o = F.from_json("outputs", "rate_limited string, status string")
    p = costs.price_steps(fx.get("ev_steps"), mode="strict").withColumn(
        "_rl", ((F.coalesce(o["rate_limited"], F.lit("")) == "true") | (o["status"] == "429")).cast("int"))
    batch = {r.date: (r.usd, r.calls, r.rate_limited) for r in p.groupBy(
        costs.day_of(F.col("started_at")).cast("string").alias("date")).agg(
        F.coalesce(costs.sum_usd(), F.lit(0.0)).alias("usd"), F.count(F.lit(1)).alias("calls"),
        F.sum("_rl").cast("bigint").alias("rate_limited")).collect()}
    assert streamed == batch


def test_stream_dedupe_drops_redelivered_steps(spark):
    got = E.queries()["stream_dedupe"](spark, SF)
    assert got.count() == got.select("trace_id", "step_id").distinct().count()
    assert got.count() == Fixtures(spark, SF).get("ev_steps").count()


def test_stream_upsert_matches_batch_split(spark):
    streamed = E.queries()["stream_upsert_tables"](spark, SF).select("trace_id", "name").collect()
    from agentrail.sources import wire as WR
    t, _ = WR.split_traces(WR.trace_lines(Fixtures(spark, SF).get("wire_files")))
    assert sorted(streamed) == sorted(t.select("trace_id", "name").collect())


def test_events_feed_reports_every_write_once(spark, tmp_path):
    from agentrail.streaming import jobs as S
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    writes = spark.createDataFrame([("t", "s", 1, 10.0), ("t", "s", 2, 10.0), ("t", "other", 3, 20.0)],
                                   "trace_id string, step_id string, seq long, started_at double")
    writes.coalesce(1).write.parquet(src)
    writes.filter("seq < 3").coalesce(1).write.mode("append").parquet(src)  # delivered again
    traces = spark.createDataFrame([("t", 10.0)], "trace_id string, started_at double")
    traces.coalesce(1).write.parquet(src + "-traces")
    ann = S.parquet_stream(spark, src, writes.schema, max_files=1).withColumn("ts", S.event_time("started_at"))
    S.run_available_now(S.events_feed(S.parquet_stream(spark, src + "-traces", traces.schema), ann), out,
                        str(tmp_path / "ckpt"))
    got = spark.read.parquet(out).select("event", "trace_id", "step_id", "seq").collect()
    assert sorted(got, key=str) == sorted([("new_trace", "t", None, None), ("annotation_changed", "t", "s", 1),
                                           ("annotation_changed", "t", "s", 2), ("annotation_changed", "t", "other", 3)],
                                          key=str)


def test_latest_annotation_table_keeps_every_column(spark, tmp_path):
    from agentrail.operators import windows as W
    from agentrail.sinks.buckets import BucketTable
    ann = Fixtures(spark, SF).get("ev_annotations")
    t = BucketTable(spark, str(tmp_path / "t"), ["trace_id", "step_id"], 4)
    for part in range(3):
        t.merge(ann.filter(f"seq % 3 = {part}"), lambda old, new: W.latest_annotations(old.unionByName(new)))
    want = W.latest_annotations(ann)
    assert "tags" in t.read().columns and set(t.read().columns) == set(want.columns)
    rows = want.collect()
    assert rows and sorted(map(str, t.read().select(*want.columns).collect())) == sorted(map(str, rows))


def _land(spark, path, schema, *files):
    from agentrail.streaming import jobs as S
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return S.parquet_stream(spark, path, spark.createDataFrame([], schema).schema, max_files=1)


def test_every_start_comes_out_once(spark, tmp_path):
    from agentrail.streaming import jobs as S
    from agentrail.streaming import stateful as ST
    start = "run_id string, trace_id string, kind string, name string, started_at double"
    first = [(f"r{i}", "t", "llm", "n", 1000.0 + i) for i in range(6)]
    starts = _land(spark, str(tmp_path / "s"), start, first, first[:2],                      # delivered again
                   [(None, None, None, None, 50_000.0)], [(None, None, None, None, 50_001.0)],  # heartbeats
                   [("late", "t", "llm", "n", 1000.0)])                                      # later than the watermark
    ends = _land(spark, str(tmp_path / "e"), "run_id string, ended_at double, error string",
                 [("r0", 1003.0, "later"), ("r0", 1001.0, None), ("r1", 1002.0, "bad"), ("r2", 9000.0, "too late"), ("r3", 1000.0, "before"),
                  ("orphan", 1001.0, None)], [("r1", 1005.0, "second")], [("r4", 1004.5, None)])
    with ST.state_store(spark):
        S.run_available_now(ST.pair_runs(starts, ends, watermark="3 hours"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = sorted((r.run_id, r.ended_at, r.error) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [("r0", 1001.0, None), ("r1", 1002.0, "bad"), ("r2", None, None), ("r3", None, None), ("r4", 1004.5, None), ("r5", None, None)]


def test_every_reply_comes_out_once(spark, tmp_path):
    from agentrail.streaming import jobs as S
    from agentrail.streaming import stateful as ST

    def line(word):
        return 'data: {"choices":[{"delta":{"content":"%s"}}]}' % word

    chunks = _land(spark, str(tmp_path / "i"), "call_id string, seq long, line string, received_at double",
                   [("a", 1, line("two"), 10.2), ("b", 0, line("open "), 10.0)],
                   [("a", 0, line("one "), 10.1), ("a", 1, line("two"), 10.2), ("a", 2, "data: [DONE]", 10.3)],
                   [("a", 3, line("after the end"), 10.4), ("b", 1, line("still"), 30.0)],
                   [(None, None, None, 5_000.0)], [(None, None, None, 5_001.0)], [("b", 2, line("too late"), 40.0)],
                   [(None, None, None, 50_000.0)])
    with ST.state_store(spark):
        S.run_available_now(ST.assemble(chunks, gap="1 minute", watermark="1 minute"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect()))
    assert got == [("a", "one two", True), ("b", "open still", False)]


def test_lengths_of_time():
    import pytest

    from agentrail.streaming import stateful as ST
    assert (ST.millis("90 minutes"), ST.millis("1 hour"), ST.millis("2 days")) == (5_400_000, 3_600_000, 172_800_000)
    with pytest.raises(ValueError):
        ST.millis("soon")
