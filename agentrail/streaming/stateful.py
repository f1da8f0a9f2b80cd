"""Per-key state with event-time timers (``transformWithState``): run events
paired, streamed replies assembled.

Every key's state leaves at a bound: a timer in event time fires once the
watermark has passed it, so what stays open comes out as such.  The watermark
only moves with rows; a source that falls silent sends heartbeats, rows with a
time and no key, which move the watermark and make no output.
The state store has to be RocksDB: see ``state_store``.
"""

from __future__ import annotations

import contextlib
import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# The processors run in Python workers: ship this module by value so executors
# need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The state store that timers need, for queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def millis(length: str) -> int:
    """``'90 minutes'`` -> milliseconds."""
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", length)
    if not m:
        raise ValueError(f"not a length of time: {length!r}")
    return int(m[1]) * _UNITS[m[2]]


class _Remembered(StatefulProcessor):
    """One value and one timer a key: a batch costs a key one read, one write
    and, when its bound moves, a timer, as every call goes to the state store."""

    fields = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)

    def _keep(self, timer: int, before: int | None, *values) -> None:
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        self.state.update((timer, *values))

    def close(self) -> None:
        pass


class PairRuns(_Remembered):
    """A run's start and the earliest end at most ``bound`` ms after it.  A
    match comes out at once, an open start when its bound has passed; until
    then the run is remembered, so that a re-delivered event makes nothing
    new.  An end whose start never comes leaves the state silently.

    A key is a slot of many runs (``pair_runs``): its runs are one Arrow table in
    the state, paired by whole columns, and its timer is the earliest of theirs,
    so calls to the state store go with slots and batches, not with runs."""

    fields = "timer long, runs binary"
    types = {"run_id": "object", "timer": "int64", "done": "bool", "started_at": "float64", "trace_id": "object",
             "kind": "object", "name": "object", "ended_at": "float64", "error": "object"}
    out = ["run_id", "trace_id", "kind", "name", "started_at", "ended_at", "error"]

    def __init__(self, bound: int):
        self.bound = bound

    def _load(self, old) -> pd.DataFrame:
        import pyarrow as pa
        runs = pa.ipc.open_stream(bytes(old[1])).read_all().to_pandas() if old else pd.DataFrame(columns=list(self.types))
        return runs.astype(self.types)

    def _store(self, runs: pd.DataFrame, before: int | None) -> None:
        import pyarrow as pa
        kinds = {"object": pa.string(), "int64": pa.int64(), "bool": pa.bool_(), "float64": pa.float64()}
        table = pa.Table.from_pandas(runs, pa.schema([(c, kinds[t]) for c, t in self.types.items()]), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self._keep(int(runs["timer"].min()), before, sink.getvalue().to_pybytes())

    def _timers(self, at: pd.Series) -> pd.Series:
        return (at * 1000).astype("int64") + self.bound

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        new = new[new["run_id"].notna() & new["at"].notna()]
        if not len(new):
            return
        old = self.state.get()
        known = self._load(old)
        new = new[~new["run_id"].isin(known.loc[known["done"], "run_id"])]
        if not len(new):
            return
        touched = known["run_id"].isin(new["run_id"])
        mine = known[touched]
        first = new[new["role"] == "start"].sort_values("at", kind="stable").rename(columns={"at": "started_at"})
        starts = pd.concat([mine[mine["started_at"].notna()], first], ignore_index=True)[["run_id", "started_at", "trace_id", "kind", "name"]]
        starts = starts.drop_duplicates("run_id")
        ends = pd.concat([new[new["role"] == "end"].rename(columns={"at": "ended_at"}), mine[mine["ended_at"].notna()]],
                         ignore_index=True)[["run_id", "ended_at", "error"]]
        ends = ends.sort_values("ended_at", kind="stable")
        fits = ends.merge(starts[["run_id", "started_at"]], on="run_id")
        after = fits["ended_at"] - fits["started_at"]
        fits = fits[(after >= 0) & (after <= self.bound / 1000)].drop_duplicates("run_id")[["run_id", "ended_at", "error"]]
        waiting = ends[~ends["run_id"].isin(starts["run_id"])].drop_duplicates("run_id")
        starts = starts.assign(timer=self._timers(starts["started_at"]), done=starts["run_id"].isin(fits["run_id"]))
        waiting = waiting.assign(timer=self._timers(waiting["ended_at"]), done=False)
        kept = [t.reindex(columns=list(self.types)).astype(self.types) for t in (known[~touched], starts, waiting)]
        self._store(pd.concat(kept, ignore_index=True), old and old[0])
        if len(fits):
            yield starts.merge(fits, on="run_id")[self.out]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.state.get()
        if not old:
            return
        known = self._load(old)
        due = (known["timer"] <= expiredTimerInfo.getExpiryTimeInMs()) | (known["timer"] < timerValues.getCurrentWatermarkInMs())
        if due.all():
            self.state.clear()
        else:
            self._store(known[~due], None)
        left = known[due & known["started_at"].notna() & ~known["done"]]
        if len(left):
            yield left.assign(ended_at=float("nan"), error=None)[self.out]


#: Slots that runs are dealt to by a hash of their id.
SLOTS = 256


def pair_runs(starts: DataFrame, ends: DataFrame, bound: str = "1 hour", watermark: str = "10 minutes", slots: int = SLOTS) -> DataFrame:
    """Streams of run starts (run_id, trace_id, kind, name, started_at) and
    ends (run_id, ended_at, error) -> one row a start: with its end if one
    comes within ``bound``, open otherwise.  Rows later than the watermark are
    dropped, as state for them is gone.  Runs share state by slot; a stream
    keeps the number of ``slots`` it began with."""
    none = F.lit(None).cast("string")
    run = F.col("run_id").cast("string").alias("run_id")
    s = starts.select(run, F.lit("start").alias("role"), "trace_id", "kind", "name",
                      F.col("started_at").alias("at"), none.alias("error"))
    e = ends.select(run, F.lit("end").alias("role"), none.alias("trace_id"), none.alias("kind"), none.alias("name"),
                    F.col("ended_at").alias("at"), "error")
    both = s.unionByName(e).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    both = both.withWatermark("ts", watermark).withColumn("_slot", F.pmod(F.xxhash64("run_id"), F.lit(slots)).cast("int"))
    return both.groupBy("_slot").transformWithStateInPandas(
        PairRuns(millis(bound)), "run_id string, trace_id string, kind string, name string, started_at double, ended_at double, error string",
        "append", "EventTime")


class Assemble(_Remembered):
    """Pieces of a reply by their number.  A reply comes out when its end mark
    has come, or incomplete ``gap`` ms after its last piece; the key is then
    remembered for another ``gap``, so that late pieces make no second row."""

    fields = "timer long, done boolean, pieces string"

    def __init__(self, gap: int):
        self.gap = gap

    @staticmethod
    def _row(key, pieces: dict, complete: bool) -> pd.DataFrame:
        text = "".join(pieces[k] for k in sorted(pieces, key=int))
        return pd.DataFrame({"call_id": [key[0]], "text": [text], "complete": [complete]})

    def handleInputRows(self, key, rows, timerValues):
        found, ended, last = {}, False, 0.0
        for df in rows:
            for seq, piece, done, at in zip(df["seq"], df["piece"], df["done"], df["at"]):
                if key[0] is not None:
                    found[str(int(seq))] = piece or ""
                    ended, last = ended or bool(done), max(last, float(at))
        old = None if key[0] is None else self.state.get()
        if key[0] is None or (old and old[1]):
            return
        pieces = {**(json.loads(old[2]) if old else {}), **{k: v for k, v in found.items() if v}}
        timer = max(int(last * 1000) + self.gap, old[0] if old else 0)
        self._keep(timer, old and old[0], ended, "" if ended else json.dumps(pieces))
        if ended:
            yield self._row(key, pieces, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.state.get()
        if old is None or old[1]:
            self.state.clear()
        else:
            self._keep(expiredTimerInfo.getExpiryTimeInMs() + self.gap, None, True, "")
            yield self._row(key, json.loads(old[2]), False)


def assemble(chunks: DataFrame, gap: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Chunk lines (call_id, seq, line, received_at) -> one row a call:
    call_id, text, complete (the ``[DONE]`` line came)."""
    from ..functions.text import sse_piece
    c = chunks.select(F.col("call_id").cast("string").alias("call_id"), "seq", sse_piece("line").alias("piece"),
                      (F.trim(F.regexp_replace("line", r"^\s*data:", "")) == "[DONE]").alias("done"), F.col("received_at").alias("at"),
                      F.timestamp_micros((F.col("received_at") * 1_000_000).cast("long")).alias("ts"))
    return c.withWatermark("ts", watermark).groupBy("call_id").transformWithStateInPandas(
        Assemble(millis(gap)), "call_id string, text string, complete boolean", "append", "EventTime")
