"""Anything that saves a trace: a plain protocol over DataFrames."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from . import exports, wire


class Sink(Protocol):
    def save(self, traces: DataFrame, steps: DataFrame) -> None: ...


class WireSink:
    """Traces in the JSONL wire format.  ``layout='packed'`` (default) keeps
    the lines in a Parquet table keyed by trace id (no small files);
    ``layout='files'`` writes one logical file per trace, as trace
    directories of the reference are laid out."""

    def __init__(self, path: str, layout: str = "packed"):
        if layout not in ("packed", "files"):
            raise ValueError(f"unknown layout {layout!r}")
        self.path = path
        self.layout = layout

    def save(self, traces: DataFrame, steps: DataFrame) -> None:
        lines = wire.wire_lines(traces, steps)
        if self.layout == "packed":
            wire.save_wire_lines(lines, self.path, mode="append")
        else:
            wire.save_wire(lines, self.path, mode="append")


class FlatParquetSink:
    """The 23-column flat step export (ZSTD Parquet)."""

    def __init__(self, path: str):
        self.path = path

    def save(self, traces: DataFrame, steps: DataFrame) -> None:
        exports.save_flat_steps(exports.flat_steps(traces, steps), self.path, mode="append")
