"""Table upkeep: typed empty export, versioned snapshots, strict corpus."""

import os

import pytest

from agentrail.sinks import exports as X
from agentrail.sinks.buckets import BucketTable, ConcurrentWrite
from agentrail.sinks.tables import SnapshotTable, remove, upsert
from agentrail.sources import sidecars as SC

TRACE_COLS = "trace_id string, name string, framework string, started_at double, ended_at double, metadata string"
STEP_COLS = ("trace_id string, step_id string, step_index int, parent_step_id string, kind string, "
             "name string, started_at double, ended_at double, inputs string, outputs string, "
             "metadata string, error string")


def test_empty_flat_export_still_writes_a_typed_file(spark, tmpdir_fresh):
    t = spark.createDataFrame([], TRACE_COLS)
    s = spark.createDataFrame([], STEP_COLS)
    path = os.path.join(tmpdir_fresh, "flat")
    X.save_flat_steps(X.flat_steps(t, s), path)
    back = spark.read.parquet(path)
    assert back.columns == [f.name for f in X.FLAT_SCHEMA.fields]
    assert back.count() == 0


def test_upsert_and_remove_are_keyed_and_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "trace_id string, v int")
    batch = spark.createDataFrame([("b", 2), ("c", 2)], "trace_id string, v int")
    once = upsert(old, batch)
    twice = upsert(once, batch)
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 1), ("b", 2), ("c", 2)]
    ids = spark.createDataFrame([("a",)], "trace_id string")
    assert sorted(remove(once, ids).collect()) == [("b", 2), ("c", 2)]


def test_snapshot_versions_never_overwrite_the_read_version(spark, tmpdir_fresh):
    base = os.path.join(tmpdir_fresh, "snap")
    t = SnapshotTable(spark, base)
    b1 = spark.createDataFrame([("a", 1)], "trace_id string, v int")
    b2 = spark.createDataFrame([("a", 2), ("b", 2)], "trace_id string, v int")
    t.upsert(b1, 1)
    t.upsert(b1, 1)                      # replayed batch: no-op
    t.upsert(b2, 2)
    t.upsert(b1, 1)                      # an old batch after a newer commit: ignored
    assert t.current() == 2
    assert sorted(t.read().collect()) == [("a", 2), ("b", 2)]
    assert sorted(os.listdir(base)) == ["v00000001", "v00000002"]


def test_strict_corpus_reader_names_the_bad_line(spark, tmpdir_fresh):
    good = '{"id":"lb-a","framework":"x","step":{}}'
    path = os.path.join(tmpdir_fresh, "corpus")
    os.makedirs(path)
    with open(os.path.join(path, "c.jsonl"), "w") as f:
        f.write(good + "\n\n" + '{"id":"lb-b"}' + "\n")
    with pytest.raises(ValueError, match=r"line 3: missing step"):
        SC.read_corpus(spark, path)
    with open(os.path.join(path, "c.jsonl"), "w") as f:
        f.write(good + "\n")
    assert [r.id for r in SC.read_corpus(spark, path).collect()] == ["lb-a"]


def test_new_checkpoint_into_an_old_table_loses_nothing(spark, tmp_path):
    from agentrail.streaming.jobs import keyed_upsert_sink
    src, base = str(tmp_path / "in"), str(tmp_path / "table")

    def stream(ids, checkpoint):
        spark.createDataFrame([(i,) for i in ids], "trace_id string").write.mode("append").parquet(src)
        (spark.readStream.schema("trace_id string").parquet(src).writeStream
         .foreachBatch(keyed_upsert_sink(base, ["trace_id"]))
         .option("checkpointLocation", str(tmp_path / checkpoint))
         .trigger(availableNow=True).start().awaitTermination())

    stream(["a"], "c1")
    stream(["b"], "c1")                  # the same stream goes on
    stream(["c"], "c2")                  # a new checkpoint counts from 0
    t = BucketTable(spark, base)
    assert t.current() == 3
    assert sorted(r.trace_id for r in t.read().collect()) == ["a", "b", "c"]


def _table(spark, base, **kw):
    return BucketTable(spark, base, "trace_id", **kw)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, v int")


def test_upsert_rewrites_the_touched_buckets_only(spark, tmp_path):
    t = _table(spark, str(tmp_path / "t"), buckets=16)
    t.upsert(_frame(spark, [(f"id{i}", 0) for i in range(1000)]))
    first = t.manifest()["where"]
    assert len(first) == 16 and len(set(first.values())) == 1
    t.upsert(_frame(spark, [("id1", 1), ("id2", 1), ("new", 1)]))
    second = t.manifest()["where"]
    moved = [b for b in second if second[b] != first[b]]
    assert 1 <= len(moved) <= 3
    got = {r.trace_id: r.v for r in t.read().collect()}
    assert len(got) == 1001 and {k for k, v in got.items() if v} == {"id1", "id2", "new"}
    assert t.read(version=1).count() == 1000 and t.versions() == [1, 2]
    assert {r.trace_id for r in t.lookup(_frame(spark, [("id2", 0), ("none", 0)])).collect()} == {"id2"}


def test_remove_compact_and_expire(spark, tmp_path):
    t = _table(spark, str(tmp_path / "t"), buckets=4)
    for k in range(4):
        t.upsert(_frame(spark, [(f"id{i}", k) for i in range(k, 40)]))
    t.remove(_frame(spark, [(f"id{i}", 0) for i in range(30)]))
    want = sorted((f"id{i}", 3) for i in range(30, 40))
    assert sorted(map(tuple, t.read().collect())) == want
    t.compact(buckets=8)
    assert t.manifest()["buckets"] == 8 and len(set(t.manifest()["where"].values())) == 1
    versions, gone = t.expire(keep=1)
    assert versions == 5 and gone > 0 and t.versions() == [6]
    assert sorted(map(tuple, t.read().collect())) == want
    data = os.path.join(tmp_path, "t", "data")
    assert os.listdir(data) == list(set(t.manifest()["where"].values()))
    t.remove(_frame(spark, want))
    assert t.read().count() == 0 and t.read().columns == ["trace_id", "v"]
    with pytest.raises(ValueError):
        t.expire(keep=0)


def test_replayed_stream_batches_are_left_out(spark, tmp_path):
    t = _table(spark, str(tmp_path / "t"), buckets=2)
    t.upsert(_frame(spark, [("a", 1)]), stream=("q", 0))
    t.upsert(_frame(spark, [("a", 9)]), stream=("q", 0))
    t.upsert(_frame(spark, [("a", 2)]), stream=("q", 1))
    t.upsert(_frame(spark, [("a", 1)]), stream=("q", 0))
    t.upsert(_frame(spark, [("b", 3)]), stream=("other", 0))     # a stream of its own counts from 0
    assert t.current() == 3 and sorted(map(tuple, t.read().collect())) == [("a", 2), ("b", 3)]
    with pytest.raises(RuntimeError):
        t.upsert_batch(_frame(spark, [("c", 1)]), 0)


def test_a_version_is_committed_once(spark, tmp_path):
    t = _table(spark, str(tmp_path / "t"), buckets=2)
    t.upsert(_frame(spark, [("a", 1)]))

    def meanwhile(old, new):
        _table(spark, str(tmp_path / "t")).upsert(_frame(spark, [("b", 1)]))
        return upsert(old, new)

    with pytest.raises(ConcurrentWrite):
        t.merge(_frame(spark, [("c", 1)]), meanwhile)
    assert sorted(r.trace_id for r in t.read().collect()) == ["a", "b"]
    # a writer that died while it wrote its manifest blocks its number only
    (tmp_path / "t" / "manifests" / "v00000003.json").write_text('{"version": 3, "wh')
    t.upsert(_frame(spark, [("c", 1)]))
    assert t.current() == 4 and t.versions() == [1, 2, 4] and t.read().count() == 3
