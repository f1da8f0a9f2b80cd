"""agentrail — Spark-native analytics for recorded LLM-agent runs.

Traces (a header plus ordered steps with free-form JSON payloads) are read
from JSONL / JSON documents / HTTP call logs / Parquet and processed with
plain DataFrame -> DataFrame operators.  All heavy work is Spark SQL,
DataFrames and Structured Streaming; Python workers are used only where a
single row needs them (recursive JSON walks, difflib alignment, scorers).
"""

__version__ = "0.1.0"
