"""Traces and steps laid out by the UTC day on which their trace started.

A step lies in the folder of its trace's day, whatever its own times say, so a
window over trace starts finds every step of its traces, late and back-dated ones
too, and reads the folders of its days alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.costs import START_DAY, day_of

TABLES = ("traces", "steps")


def write_by_day(traces: DataFrame, steps: DataFrame, base: str, spread: int = 8, mode: str = "append") -> None:
    """Write both tables below ``base``; a day's rows are dealt to ``spread``
    tasks, so a day with very many is not one task's.  Traces without a start and
    steps without a trace lie in a folder of their own (null day)."""
    for df in (traces, steps):
        if START_DAY in df.columns:
            raise ValueError(f"a column is called {START_DAY}")
    day = day_of(F.col("started_at")).alias(START_DAY)
    days = traces.select("trace_id", day).groupBy("trace_id").agg(F.min(START_DAY).alias(START_DAY))
    frames = traces.select("*", day), steps.join(days, "trace_id", "left").select(*steps.columns, START_DAY)
    for name, df in zip(TABLES, frames):
        (df.repartition(F.col(START_DAY), F.pmod(F.xxhash64("trace_id"), F.lit(spread)))
         .write.mode(mode).partitionBy(START_DAY).option("compression", "zstd").parquet(f"{base}/{name}"))


def read_by_day(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(traces, steps) with their ``start_day``."""
    return tuple(spark.read.parquet(f"{base}/{name}") for name in TABLES)
