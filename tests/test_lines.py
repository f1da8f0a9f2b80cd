"""Line numbers over splits: the same as counting through each file."""

import os
import random

import pytest
from pyspark.sql import functions as F

from agentrail.sources import lines as L
from agentrail.sources import sidecars as SC
from agentrail.sources import wire as WR

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    spark.conf.set(SPLIT, "64")
    yield spark
    spark.conf.unset(SPLIT)


def _folder(tmp_path, texts: dict[str, str]) -> str:
    for name, text in texts.items():
        with open(os.path.join(tmp_path, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return str(tmp_path)


def _by_hand(texts: dict[str, str], blank: bool) -> set:
    out = set()
    for name, text in texts.items():
        rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        rows = rows[:-1] if rows[-1] == "" else rows
        out |= {(name, i, x) for i, x in enumerate(rows, 1) if blank or x.strip()}
    return out


def _texts() -> dict[str, str]:
    r = random.Random(7)
    words = ["", " ", "a", "éß", "漢字", "x" * 63, "y" * 64, "z" * 300, '{"id":"k"}']
    made = {f"f{k}.jsonl": "".join(r.choice(words) + r.choice(["\n", "\r\n", "\r"]) for _ in range(60 * k)) for k in range(1, 5)}
    return made | {"one.jsonl": "no end", "empty.jsonl": "", "blank.jsonl": "\n\n\r\n", "long.jsonl": "q" * 1000 + "\nlast"}


@pytest.mark.parametrize("limit", [L.MAX_BROADCAST_BYTES, -1])
def test_numbers_equal_a_count_through_the_file(small_splits, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(L, "MAX_BROADCAST_BYTES", limit)
    texts = _texts()
    path = _folder(tmp_path, texts)
    assert small_splits.read.text(path).rdd.getNumPartitions() > 8
    for blank in (True, False):
        got = L.numbered_lines(small_splits, path, blank).collect()
        assert len(got) == len(set(got))
        assert {(os.path.basename(g.file), g.line_no, g.line) for g in got} == _by_hand(texts, blank)


def test_one_file_is_read_by_many_tasks_and_lines_are_not_shuffled(small_splits, tmp_path):
    path = _folder(tmp_path, {"big.txt": "".join(f"line {i}\n" for i in range(1, 501))})
    out = L.numbered_lines(small_splits, path)
    assert out.groupBy(F.spark_partition_id()).count().count() > 20
    assert out.where("line <> concat('line ', line_no)").count() == 0 and out.count() == 500
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_bound_of_the_table_of_splits(small_splits, tmp_path):
    path = _folder(tmp_path, {"a.txt": "x\n" * 500, "b.txt": "y"})
    splits = small_splits.read.text(path).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert L.split_table_bytes(small_splits, path) >= splits * L.ROW_BYTES
    assert [L._bytes(x) for x in ("128MB", "64k", "4194304b", "10")] == [128 << 20, 64 << 10, 4 << 20, 10]


def test_first_bad_corpus_line_over_splits(small_splits, tmp_path):
    good = ['{"id":"lb-%d","framework":"x","step":{}}' % i for i in range(300)]
    path = _folder(tmp_path, {"c.jsonl": "\n".join(good[:211] + [""] + ["[]"] + good[211:] + ["{"])})
    with pytest.raises(ValueError, match=r"c.jsonl: line 213: not a JSON object"):
        SC.read_corpus(small_splits, path)
    os.makedirs(tmp_path / "ok")
    path = _folder(tmp_path / "ok", {"c.jsonl": "\n".join(good)})
    assert sorted(r.id for r in SC.read_corpus(small_splits, path).collect()) == sorted(f"lb-{i}" for i in range(300))
    os.makedirs(tmp_path / "none")
    path = _folder(tmp_path / "none", {"c.jsonl": "\n \n"})
    with pytest.raises(ValueError, match="corpus is empty"):
        SC.read_corpus(small_splits, path)


def test_trace_lines_by_split_equal_whole_files(small_splits, tmp_path):
    head = '{"_type":"trace","trace_id":"t","name":"n"}\n'
    text = head + "".join('{"_type":"step","step_id":"s%d"}\n%s' % (i, "oops\r\n" if i % 7 == 0 else "") for i in range(80))
    path = _folder(tmp_path, {"t.jsonl": text})
    by_split = WR.read_trace_lines(small_splits, path)
    whole = WR.trace_lines(WR.read_trace_files(small_splits, path))
    order = ["file", "pos"]
    assert by_split.orderBy(order).collect() == whole.orderBy(order).collect()
    _, steps = WR.split_traces(by_split)
    assert [r.step_id for r in steps.orderBy("step_index").collect()] == [f"s{i}" for i in range(80)]
