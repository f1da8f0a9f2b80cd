"""Structured Streaming jobs over trace files and step tables.

Sources are file streams (new trace files, new Parquet batches); every job
checkpoints in a caller-given folder on shared storage, so a restarted
job resumes from its last committed micro-batch.  Event time is the step
/ trace start (Unix seconds -> TIMESTAMP, UTC).

Late data rule: rows later than the watermark reach no aggregate, but
they still reach the derived tables, which are keyed upserts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import costs
from ..operators.stats import failed_flag
from ..sinks.buckets import BUCKETS, BucketTable
from ..sources import wire as WR

# ``tail`` runs callbacks in Python workers: ship this module by value so
# executors need no installed copy of the package.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])


def event_time(col: str = "started_at"):
    return F.timestamp_micros((F.col(col) * F.lit(1_000_000)).cast("long"))


def trace_file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New trace files under ``path`` -> parsed lines (one file per row)."""
    r = spark.readStream.format("text").option("wholetext", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    files = r.load(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return WR.trace_lines(files)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def start_upsert(lines: DataFrame, target_base: str, checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS):
    """Incremental derived tables: each micro-batch of new files is split
    into traces and steps and upserted by trace id into bucketed tables
    (``<base>/traces``, ``<base>/steps``), each batch of a stream once.  Files
    are read and parsed once a batch."""
    spark = lines.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            traces, steps = WR.split_traces(batch)
            BucketTable(spark, f"{target_base}/traces", "trace_id", buckets).upsert_batch(traces.drop("file"), batch_id)
            BucketTable(spark, f"{target_base}/steps", "trace_id", buckets).upsert_batch(steps.drop("file"), batch_id)
        finally:
            batch.unpersist()

    w = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def events_feed(traces: DataFrame, annotations: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Dashboard feed: ``new_trace`` per trace and ``annotation_changed`` per
    annotation write, de-duplicated within the watermark.  ``seq`` is the
    version of a write: a re-delivered trace or write emits nothing new, the
    next write of the same step does."""
    t = traces.select(F.lit("new_trace").alias("event"), "trace_id", F.lit(None).cast("string").alias("step_id"),
                      F.lit(None).cast("bigint").alias("seq"), event_time("started_at").alias("ts"))
    a = annotations.select(F.lit("annotation_changed").alias("event"), "trace_id", "step_id",
                           F.col("seq").cast("bigint").alias("seq"), F.col("ts"))
    u = t.unionByName(a)
    return u.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event", "trace_id", "step_id", "seq"])


def dedupe_stream(steps: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop re-delivered (trace, step) rows within the watermark."""
    return (steps.withColumn("ts", event_time("started_at")).withWatermark("ts", watermark)
            .dropDuplicatesWithinWatermark(["trace_id", "step_id"]))


def daily_cost_stream(steps: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Tumbling UTC day of each priced llm call's start: usd (strict pricing),
    calls and rate-limited calls.  Partial aggregates live in state until
    the watermark passes the day."""
    from ..functions import payload as P
    priced = costs.price_steps(steps, mode="strict")
    o = P.fields("outputs", "rate_limited", "status")
    rl = (P.truthy(o["rate_limited"]) | (o["status"].try_cast("double") == 429)).cast("int")
    p = priced.select(event_time("started_at").alias("ts"), "cost_pico", rl.alias("_rl"))
    return (p.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"))
            .agg(F.sum("cost_pico").alias("_pico"), F.count(F.lit(1)).alias("calls"),
                 F.sum("_rl").cast("bigint").alias("rate_limited"))
            .select(F.col("window.start").cast("date").cast("string").alias("date"),
                    F.coalesce(costs.usd(F.col("_pico")), F.lit(0.0)).alias("usd"), "calls", "rate_limited"))


def failure_rate_stream(traces: DataFrame, length: str = "7 days", slide: str = "1 day",
                        watermark: str = "1 day") -> DataFrame:
    """Sliding-window failure rate of traces by start time."""
    t = traces.select(event_time("started_at").alias("ts"), failed_flag().cast("int").alias("_f"))
    return (t.withWatermark("ts", watermark).groupBy(F.window("ts", length, slide))
            .agg(F.count(F.lit(1)).alias("traces"), F.sum("_f").cast("bigint").alias("failed"))
            .select(F.col("window.start").cast("string").alias("window_start"),
                    F.col("window.end").cast("string").alias("window_end"), "traces", "failed",
                    F.round(F.col("failed") / F.col("traces"), 6).alias("failure_rate")))


def keyed_upsert_sink(base: str, key: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function writing update-mode output into a bucketed
    table keyed by ``key``, each batch of a stream once."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        BucketTable(batch.sparkSession, base, key, buckets).upsert_batch(batch, batch_id)
    return apply


def tail(stream: DataFrame, fn: Callable[[object], None], checkpoint: str, trigger: dict | None = None,
         report: str | None = None):
    """Call ``fn(row)`` for every finished step of each micro-batch, on the
    executors; errors in ``fn`` are swallowed, a callback must never stop capture.

    With ``report``, a folder shared by all executors, every partition writes how
    many calls it made and how many failed (``tail_report``): committed once a
    batch, so a repeated task or a replayed batch counts once there, though its
    rows may reach ``fn`` again."""
    def per_partition(rows):
        calls = failures = 0
        for row in rows:
            calls += 1
            try:
                fn(row)
            except Exception:  # noqa: BLE001 - user callback errors are swallowed
                failures += 1
        if calls:
            yield calls, failures

    def apply(batch: DataFrame, batch_id: int) -> None:
        done = batch.filter(F.col("ended_at").isNotNull())
        if report is None:
            done.foreachPartition(lambda rows: list(per_partition(rows)))
            return
        counts = batch.sparkSession.createDataFrame(done.rdd.mapPartitions(per_partition), TAIL_SCHEMA)
        counts.write.mode("overwrite").parquet(f"{report}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


TAIL_SCHEMA = "calls bigint, failures bigint"


def tail_report(spark: SparkSession, report: str) -> DataFrame:
    """Calls and failed calls of a ``tail`` by micro-batch."""
    rows = spark.read.schema(TAIL_SCHEMA + ", batch_id bigint").parquet(report)
    return rows.groupBy("batch_id").agg(F.sum("calls").alias("calls"), F.sum("failures").alias("failures"))


def live_view(table: DataFrame, n: int = 50, failed_only: bool = False) -> DataFrame:
    """Newest ``n`` trace cards of the derived table (optionally failed only)."""
    from ..operators.relational import latest_n, trace_cards
    cards = trace_cards(table)
    if failed_only:
        cards = cards.filter("failed")
    return latest_n(cards, n)


def assemble_stream(chunks: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Chunk lines of streamed replies -> one row per call: a session window
    per call id on the arrival time closes ``gap`` after the last chunk
    (the timeout) and is emitted in append mode once the watermark passes
    it; the state per call holds its pieces (bounded by one reply).
    ``complete`` tells whether the ``[DONE]`` line arrived."""
    from ..functions.text import sse_piece
    c = chunks.select("call_id", "seq", sse_piece("line").alias("piece"),
                      (F.trim(F.regexp_replace("line", r"^\s*data:", "")) == "[DONE]").alias("done"),
                      event_time("received_at").alias("ts"))
    g = (c.withWatermark("ts", gap).groupBy("call_id", F.session_window("ts", gap))
         .agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("_p"), F.max("done").alias("complete")))
    return g.select("call_id", F.array_join(F.transform("_p", lambda x: x["piece"]), "").alias("text"), "complete")


def run_batchwise(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str) -> None:
    """Apply a batch operator to each micro-batch (e.g. per-file or
    per-document aggregates, which are complete inside one batch) and
    write its output under ``batch=<id>``; a replayed batch overwrites its
    own folder, so the result is exactly-once."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def run_available_now(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append",
                      key: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Run a streaming DataFrame over everything available, then stop.
    Append output goes to Parquet; update output to a keyed, bucketed table."""
    if mode == "append":
        q = (df.writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    else:
        q = (df.writeStream.foreachBatch(keyed_upsert_sink(out_path, key or [], buckets))
             .option("checkpointLocation", checkpoint).outputMode("update")
             .trigger(availableNow=True).start())
    q.awaitTermination()
