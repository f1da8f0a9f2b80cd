"""Work that grows with the input is dealt over tasks, and done once."""

import pandas as pd

from agentrail.operators import search_index as SI
from agentrail.plans import q_streaming as QS
from agentrail.sinks.buckets import BucketTable
from agentrail.sources import wire as WR
from agentrail.streaming import stateful as ST


class _Store:
    """A state store that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _events(*rows):
    return iter([pd.DataFrame(rows, columns=["run_id", "role", "trace_id", "kind", "name", "at", "error"])])


def test_calls_to_the_state_store_go_with_slots_not_with_runs():
    store, runs = _Store(), 500
    pairs = ST.PairRuns(3_600_000)
    pairs.init(store)
    starts = [(f"r{i}", "start", "t", "k", "n", 1000.0 + i, None) for i in range(runs)]
    assert list(pairs.handleInputRows((0,), _events(*starts, (None, "start", None, None, None, 9.0, None)), _At(0))) == []
    ends = [(f"r{i}", "end", None, None, None, 1001.0 + i, "bad" if i % 2 else None) for i in range(0, runs - 100)]
    out = pd.concat(pairs.handleInputRows((0,), _events(*ends, ("later", "end", None, None, None, 1500.0, "x")), _At(0)))
    assert sorted(out["run_id"]) == sorted(f"r{i}" for i in range(runs - 100)) and store.calls < 20
    assert list(pairs.handleInputRows((0,), _events(*ends[:5], *starts[:5]), _At(0))) == []     # delivered again
    found = pd.concat(pairs.handleInputRows((0,), _events(("later", "start", "t", "k", "n", 1400.0, None)), _At(0)))
    assert found[["run_id", "ended_at", "error"]].values.tolist() == [["later", 1500.0, "x"]]
    assert store.timers == {1_000_000 + 3_600_000}
    left = pd.concat(pairs.handleExpiredTimer((0,), _At(1_000_000 + 3_600_000 + 450_000), _At(4_600_000)))
    assert sorted(left["run_id"]) == sorted(f"r{i}" for i in range(400, 450)) and left["ended_at"].isna().all()
    assert min(store.timers - {4_600_000}) == 1_450_000 + 3_600_000 and store.calls < 30


def test_landed_files_are_written_by_as_many_tasks_as_a_shuffle_has(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id % 5000 as k", "cast(id as double) as at")
    for name, time_col in (("plain", None), ("timed", "at")):
        path = str(tmp_path / name)
        stream = QS._land(rows, path, "k", batches=2, time_col=time_col)
        files = spark.read.parquet(path).inputFiles()
        assert len(files) == 8                     # the test session's shuffle partitions
        seen = []
        q = (stream.writeStream.foreachBatch(lambda b, i: seen.append(b.selectExpr("count(*)", "min(at)", "max(at)").first()[:]))
             .option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start())
        q.awaitTermination()
        assert len(seen) == 2 and sum(s[0] for s in seen) == 20_000
        if time_col:
            assert [s[1:] for s in seen] == [(0.0, 9999.0), (10_000.0, 19_999.0)]
    keyed = spark.read.parquet(str(tmp_path / "plain")).selectExpr("k", "_metadata.file_name f").distinct()
    assert keyed.count() == 5000                   # a key's rows lie in one file


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = BucketTable(spark, str(tmp_path / "t"), "k", 2)
        table.upsert(spark.range(1000).selectExpr("id % 500 as k", "id as v"))
        table.upsert(spark.range(400).selectExpr("id as k", "-id as v"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    per = table.read().selectExpr("k", "_metadata.file_path f")
    assert per.count() == 600 and per.select("f").distinct().count() > 2
    assert per.distinct().count() == 500           # a key's rows lie in one file


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_meet_their_header_without_a_second_read(spark):
    text = "\n".join(['{"_type":"step","step_id":"s0"}', '{"_type":"trace","trace_id":"first"}', "{'a':1}", "[1]", '{"_type":"step","step_id":"s1"}',
                      '{"a":"tab\there"}', '{"_type":"trace","trace_id":"last"} x', '{"_type":"trace","trace_id":"last"}'])
    files = spark.createDataFrame([("x/a.jsonl", text), ("x/b.jsonl", '{"_type":"step","step_id":"s2"}'),
                                   (None, text)], "file string, text string")
    lines = WR.trace_lines(files)
    _, steps = WR.split_traces(lines)
    assert "Join" not in _plan(steps) and _plan(steps).count("Exchange hash") == 1
    got = sorted(map(tuple, steps.select("file", "trace_id", "step_id", "step_index").collect()), key=str)
    assert got == [("x/a.jsonl", "last", "s0", 0), ("x/a.jsonl", "last", "s1", 1), ("x/b.jsonl", "b", "s2", 0),
                   (None, None, "s0", 0), (None, None, "s1", 1)]
    good = [r.good for r in lines.where("file = 'x/a.jsonl'").orderBy("pos").collect()]
    assert good == [r.good for r in lines.where("file = 'x/a.jsonl'").orderBy("pos").select(WR.is_json_object("line").alias("good")).collect()]


def test_postings_are_not_shuffled_to_drop_repeated_ones(spark):
    traces = spark.createDataFrame([("t", "abcd", "f", "{}"), (None, "abcd", "f", "{}")], "trace_id string, name string, framework string, metadata string")
    steps = spark.createDataFrame([("t", "xyzxyz", "k", "{}", "{}", None), ("t", "xyz", "k", "{}", "{}", None)],
                                  "trace_id string, name string, kind string, inputs string, outputs string, error string")
    found = SI.postings(traces, steps)
    assert "hashpartitioning(gram" not in _plan(found)
    rows = list(map(tuple, found.collect()))
    assert len(rows) == len(set(rows)) and ("xyz", "t", "steps") in rows and ("abc", "t", "header") in rows


def test_toxicity_training_counts_n_grams_in_bounded_memory():
    import tracemalloc

    import numpy as np

    from agentrail.llm.toxicity import train
    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(97, 123, 12))) for _ in range(8000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 8000, 2500)) for _ in range(120)]
    tracemalloc.start()
    model = train(texts, [i % 2 for i in range(120)], epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(model.logit).all() and peak < 200 << 20
