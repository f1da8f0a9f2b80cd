"""Registered queries against their SQL, and the pipeline's stages against
brute force, on the smallest tables."""

import itertools
import os
import re
import sys
from collections import Counter

import duckdb
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from agentrail import llm
from agentrail.llm import mixing, tokens

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_operators import brute_lines  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(llm.ORACLES[name]).df()
    got = llm.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    by = list(want.columns)
    got, want = (x.sort_values(by).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in by:
        if got[c].dtype.kind == "f":
            assert (got[c] - want[c]).abs().max() < 1e-6
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.QUERIES) == list(range(1, 14))


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _words(t):
    return WORDS.findall(t or "")


def _kept_by_quality(rows):
    con = duckdb.connect()
    docs = pd.DataFrame([r.asDict() for r in rows])  # noqa: F841 - read by the SQL
    con.execute("CREATE VIEW documents AS SELECT * FROM docs")
    verdicts = con.execute(f"SELECT doc_id, kept FROM ({llm.ORACLES['op2_quality_rules']})").fetchall()
    return {i for i, kept in verdicts if kept}


def _one_of_each(rows, words=5, percent=80):
    """Least doc_id of each group of linked documents; texts without words are
    groups of their own."""
    sets = {}
    for r in rows:
        w = _words((r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


def test_pipeline_stages(spark):
    """Each stage on what the one before kept: rules against their SQL, lines
    and near copies by brute force, the mix against its query's takes, packed
    pieces against the library's ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        return rows, spark.createDataFrame(rows, docs.schema)

    rows = docs.collect()
    good, docs = run("quality rules", docs)
    texts = {r.doc_id: r for r in rows}
    assert {r.doc_id for r in good} == _kept_by_quality(rows) and all(r == texts[r.doc_id] for r in good)

    lean, docs = run("line dedup", docs)
    want = brute_lines([(r.doc_id, r.text) for r in good])
    want = {i: t for (i, old), t in want.items() if t == old or _words(t)}
    want |= {r.doc_id: None for r in good if r.text is None}
    assert {r.doc_id: r.text for r in lean} == want
    assert all(r.n_chars == len(r.text) for r in lean if r.text is not None)

    single, docs = run("n-gram Jaccard join", docs)
    assert {r.doc_id for r in single} == _one_of_each(lean)

    takes = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    mixed, docs = run("mixing sources to target weights", docs)
    got = Counter()
    for r in mixed:
        got[r.doc_id] += len(_words(r.text))
    assert got == Counter({i: n for i, n in takes.items() if n})

    packed = stages["best-fit packing"](spark, docs, SF).collect()
    enc = Tokenizer.from_file(tokens.vocabulary())
    ids = Counter()
    for r in mixed:
        ids[r.doc_id] += len(enc.encode(r.text or "", add_special_tokens=False).ids) + 1
    sizes, laid = Counter(), Counter()
    for p in packed:
        sizes[p.doc_id] += p.length
        laid[p.sequence_id] += p.length
    assert sizes == ids and max(laid.values()) <= 2048
    assert len(laid) <= -(-sum(ids.values()) // 2048) + 1  # pieces are not cut to fill up


def test_pipeline_runs_on_odd_and_empty_tables(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(70))
    plain = " ".join(f"the {k} of and w{k}" for k in range(40))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, plain, "en", None, 1), (4, plain, None, "b", 1),
            (5, plain + "\n" + passage, "en", "a", 1), (6, "x y z", "en", "a", 5), (None, plain + " more", "en", "é", None)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    for name, table in (("odd", rows), ("none", [])):
        spark.createDataFrame(table, ddl).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.length <= 2048 for r in got) and (bool(got) or name == "none")
