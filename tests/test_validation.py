"""Both validators agree on the same valid and invalid documents."""

import json

import pytest

from agentrail.sources import documents as D

VALID = [
    {"name": "minimal", "steps": []},
    {"trace_id": "abc123", "name": "full", "framework": "langgraph", "started_at": 1.5, "ended_at": 2.5,
     "metadata": {"failed": False}, "steps": [
         {"step_id": "s1", "parent_step_id": None, "kind": "llm-call", "name": "call", "started_at": 1.6,
          "ended_at": 1.7, "inputs": {"model": "gpt-4o"}, "outputs": {"text": "hi"}, "metadata": {}, "error": None}]},
    *[{"name": f"kind-{k}", "steps": [{"kind": k, "name": "x"}]}
      for k in ["llm-call", "tool-call", "io", "thought", "error", "custom", "plan", "retrieve", "final", "step.42"]],
]
INVALID = [
    {"steps": []},                                          # no name
    {"name": 123, "steps": []},                             # name not a string
    {"name": "", "steps": []},                              # empty name
    {"name": "x", "steps": "nope"},                         # steps not a list
    {"name": "x", "steps": [{"name": "s"}]},                # step without kind
    {"name": "x", "steps": [{"kind": "io"}]},               # step without name
    {"name": "x", "steps": [{"kind": "", "name": "s"}]},    # empty kind
    {"name": "x", "steps": [{"kind": "k" * 65, "name": "s"}]},  # kind of 65 chars
    {"name": "x", "steps": [{"kind": "io", "name": ""}]},   # empty step name
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(i, json.dumps(d)) for i, d in enumerate(VALID + INVALID)]
    docs = spark.createDataFrame(rows, "doc_id long, doc string")
    out = {}
    for mode in ("schema", "ingest"):
        out[mode] = {r.doc_id: (r.ok, r.error) for r in D.validate(docs, mode).collect()}
    return out


@pytest.mark.parametrize("mode", ["schema", "ingest"])
def test_valid_documents_pass(verdicts, mode):
    for i in range(len(VALID)):
        assert verdicts[mode][i] == (True, None), (mode, VALID[i])


@pytest.mark.parametrize("mode", ["schema", "ingest"])
def test_invalid_documents_fail(verdicts, mode):
    for j, d in enumerate(INVALID):
        ok, err = verdicts[mode][len(VALID) + j]
        assert not ok and err, (mode, d)


def test_ingest_messages(verdicts):
    base = len(VALID)
    msgs = [verdicts["ingest"][base + j][1] for j in range(len(INVALID))]
    assert msgs[0] == "trace.name is required and must be a non-empty string"
    assert msgs[3] == "trace.steps must be a list (may be empty)"
    assert msgs[4] == "steps[0].kind must be a non-empty string"
    assert msgs[5] == "steps[0].name is required"
    assert msgs[7] == "steps[0].kind exceeds 64 chars"


def test_ingest_judges_each_row_of_a_repeated_id(spark):
    good, bad = json.dumps({"name": "x", "steps": [{"kind": "io", "name": "s"}]}), json.dumps({"steps": []})
    docs = spark.createDataFrame([("d1", good), ("d1", bad), ("d2", None)], "doc_id string, doc string")
    traces, steps, rejects = D.ingest(docs, as_of=10.0)
    assert [(r.doc_id, r.name) for r in traces.collect()] == [("d1", "x")]
    assert steps.count() == 1
    assert sorted(r.doc_id for r in rejects.collect()) == ["d1", "d2"]


def test_validation_shuffles_nothing(spark):
    docs = spark.createDataFrame([("d1", "{}")], "doc_id string, doc string")
    for df in (D.validate(docs), *D.ingest(docs, as_of=1.0)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_rule_copies_the_document_or_its_steps(spark):
    """A VARIANT taken from a VARIANT is built anew with all below it: only the members
    under test are taken, never the document's or the steps' whole values."""
    docs = spark.createDataFrame([("d1", "{}")], "doc_id string, doc string")
    for df in (D.validate(docs), D.validate(docs, "ingest"), *D.ingest(docs, as_of=1.0)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "variant_get" in plan
        assert "ArrayType(VariantType" not in plan and "MapType(StringType,VariantType" not in plan


FALSY = ["null", "false", "0", "-0", "0.0", "-0.000", "0e5", "0E-7", "1e-400", '""', "[]", "{}"]
TRUTHY = ["true", "1", "-0.5", "0.001", "1e-30", '"0"', '"null"', '" "', "[null]", "[0]", '{"a":null}']


def test_defaults_fill_what_python_holds_for_false(spark):
    """A falsy trace_id, start, step_id or payload gets its default, whatever its type; any
    other keeps its text."""
    values = FALSY + TRUTHY
    docs = spark.createDataFrame(
        [(i, '{"name":"n","trace_id":%s,"metadata":{},"started_at":%s,"steps":[{"kind":"k","name":"s",'
             '"step_id":%s,"inputs":%s}]}' % (x, x if x in FALSY else 3, x, x)) for i, x in enumerate(values)],
        "doc_id long, doc string")
    traces, steps, rejects = D.ingest(docs, as_of=9.0)
    assert rejects.count() == 0
    heads = {r.doc_id: r for r in traces.collect()}
    by_trace = {r.trace_id: r for r in steps.collect()}
    for i, x in enumerate(values):
        head = heads[i]
        step = by_trace[head.trace_id]
        assert (len(head.trace_id) == 32) == (x in FALSY), x
        assert (len(step.step_id) == 12) == (x in FALSY), x
        assert head.started_at == step.started_at == (9.0 if x in FALSY else 3.0), x
        assert (step.inputs == "{}") == (x in FALSY), x


@pytest.mark.parametrize("steps, error", [
    ("null", "trace.steps must be a list (may be empty)"), ("{}", "trace.steps must be a list (may be empty)"),
    ("[]", None), ('[{"kind":"k","name":"n"},null]', "steps[1] must be an object"),
    ('[{"kind":"k","name":"n"},[{}]]', "steps[1] must be an object"), ('[7]', "steps[0] must be an object"),
    ('[{"kind":7,"name":"n"}]', "steps[0].kind must be a non-empty string"),
    ('[{"kind":"k","name":"n","step_id":"a/b"},{}]',
     "steps[0].step_id contains a forbidden character (path separator, null, control)")])
def test_steps_of_any_type_are_judged(spark, steps, error):
    docs = spark.createDataFrame([(1, '{"name":"n","steps":%s}' % steps)], "doc_id long, doc string")
    assert [tuple(r) for r in D.validate(docs, "ingest").collect()] == [(1, error is None, error)]
