"""Search index, tables laid out by day, annotation listing and removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import costs
from ..operators import windows as W
from ..operators.search_index import TraceIndex
from ..session import materialize, scratch_path
from ..sinks import by_day
from ..sinks.buckets import BucketTable
from .catalog import ORACLES, register
from .fixtures import AS_OF
from . import q_core, q_costs  # noqa: F401  (their oracles are used here)


@register("search_traces_indexed")
def q_search_traces_indexed(fx):
    """Traces whose header or steps contain 'HTTP 429', by the trigram index:
    built in two batches, of which the second is replayed; traces and steps are
    read from tables bucketed by trace."""
    traces, steps = materialize(fx.get("ev_traces"), "traces"), materialize(fx.get("ev_steps"), "steps")
    base = scratch_path(fx.spark, "search-index")
    tables = {"traces": BucketTable(fx.spark, f"{base}/traces", buckets=DEMO_BUCKETS), "steps": BucketTable(fx.spark, f"{base}/steps", buckets=DEMO_BUCKETS)}
    tables["traces"].append(traces)
    tables["steps"].append(steps)
    index = TraceIndex(fx.spark, f"{base}/index", DEMO_BUCKETS)
    late = F.pmod(F.xxhash64("trace_id"), F.lit(4)) == 0
    index.add(traces.where(~late), steps.where(~late), ("demo", 0))
    for _ in range(2):
        index.add(traces.where(late), steps.where(late), ("demo", 1))
    return index.search(tables["traces"], tables["steps"], W.latest_annotations(fx.get("ev_annotations")), "  HTTP 429 ")


@register("cost_timeseries_by_day")
def q_cost_timeseries_by_day(fx):
    """14 days of spend from traces and steps laid out by start day: the
    other days' folders are not read."""
    base = scratch_path(fx.spark, "by-day")
    by_day.write_by_day(fx.get("ev_traces"), fx.get("ev_steps"), base)
    traces, steps = by_day.read_by_day(fx.spark, base)
    return costs.cost_timeseries(steps, traces, AS_OF, days=14)


ORACLES["search_traces_indexed"] = ORACLES["search_traces"]
ORACLES["cost_timeseries_by_day"] = ORACLES["cost_timeseries"]


DEMO_BUCKETS = 16

LATEST = """
, la AS (SELECT trace_id, step_id, arg_max(failure_category, seq) AS failure_category,
  arg_max(severity, seq) AS severity, arg_max(notes, seq) AS notes FROM ev_annotations GROUP BY trace_id, step_id)"""


@register("list_annotations", ["ev_traces", "ev_annotations"], LATEST + """
SELECT trace_id, step_id, substr(trace_id, 1, 12) AS trace, substr(step_id, 1, 12) AS step, failure_category, severity,
  coalesce(nullif(notes, ''), '—') AS notes
FROM la WHERE trace_id IN (SELECT trace_id FROM ev_traces)""")
def q_list_annotations(fx):
    """Annotations of every captured trace; those of lost traces are left out."""
    return A.list_annotations(W.latest_annotations(fx.get("ev_annotations")), fx.get("ev_traces"))


REQUESTS = """
, rq AS (SELECT DISTINCT trace_id, CASE step_index % 3 WHEN 0 THEN step_id WHEN 1 THEN substr(step_id, 1, 11)
    ELSE 'zz' || step_id END AS step_ref FROM ev_steps WHERE kind = 'llm-call'),
fd AS (SELECT r.trace_id, r.step_ref, arg_min(s.step_id, s.step_index) AS found FROM rq r
  JOIN ev_steps s ON s.trace_id = r.trace_id AND starts_with(s.step_id, r.step_ref) GROUP BY 1, 2),
rs AS (SELECT rq.trace_id, rq.step_ref, coalesce(fd.found, rq.step_ref) AS step_id
  FROM rq LEFT JOIN fd ON rq.trace_id = fd.trace_id AND rq.step_ref = fd.step_ref)"""


def _removed(fx):
    """Removal of the tags of every llm-call step, named by its id, by the
    beginning of it (other steps may have the same) or by an unknown id."""
    steps = fx.get("ev_steps")
    ref = (F.when(F.col("step_index") % 3 == 0, F.col("step_id"))
           .when(F.col("step_index") % 3 == 1, F.substring("step_id", 1, 11))
           .otherwise(F.concat(F.lit("zz"), F.col("step_id"))))
    requests = steps.where("kind = 'llm-call'").select("trace_id", ref.alias("step_ref"))
    return A.remove_annotations(W.latest_annotations(fx.get("ev_annotations")), steps, requests)


@register("remove_annotations", ["ev_steps", "ev_annotations"], LATEST + REQUESTS + """
SELECT trace_id, step_id, failure_category, severity, notes FROM la
WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.trace_id = la.trace_id AND rs.step_id = la.step_id)""")
def q_remove_annotations(fx):
    """Annotations left after a batch of removals."""
    return _removed(fx)[0].select("trace_id", "step_id", "failure_category", "severity", "notes")


@register("remove_annotations_outcome", ["ev_steps", "ev_annotations"], LATEST + REQUESTS + """
SELECT rs.trace_id, rs.step_ref, rs.step_id, la.step_id IS NOT NULL AS removed
FROM rs LEFT JOIN la ON rs.trace_id = la.trace_id AND rs.step_id = la.step_id""")
def q_remove_annotations_outcome(fx):
    """What became of every removal asked for."""
    return _removed(fx)[1]


@register("clear_annotations", ["ev_traces", "ev_annotations"], LATEST + """
SELECT trace_id, step_id, failure_category, severity, notes FROM la
WHERE trace_id NOT IN (SELECT trace_id FROM ev_traces WHERE framework = 'crewai')""")
def q_clear_annotations(fx):
    """Annotations left after those of all traces of one framework went."""
    ids = fx.get("ev_traces").where("framework = 'crewai'")
    return A.clear_annotations(W.latest_annotations(fx.get("ev_annotations")), ids)[0].select(
        "trace_id", "step_id", "failure_category", "severity", "notes")
