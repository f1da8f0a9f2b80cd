"""Numbered lines of text files that many tasks read at once.

A large file is cut into splits by the text reader, so no task holds a file.
Rows of a split come in file order: the running number of a row less the least
one of its split is its place there.  The lines of each split are counted, and
the counts of the splits before it in the file (one row a split) give the
number of its first line.

Defined results: lines end at ``\\n``, ``\\r\\n`` or ``\\r``; blank lines count
but are left out unless ``blank`` is set; an empty file or folder gives no
rows; a line longer than a split is one row, in the split where it starts; a
compressed file is one split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of the table of splits up to which it is broadcast.
MAX_BROADCAST_BYTES = 32 << 20
#: Bytes a row of that table takes besides the path.
ROW_BYTES = 96


def _bytes(text: str) -> int:
    """'128MB', '64k', '4194304b' or a plain number, as Spark settings have it."""
    digits = text.strip().lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(digits[-1:], 1)
    return int(digits.rstrip("kmgt")) * scale


def split_table_bytes(spark: SparkSession, path: str) -> int:
    """Upper bound of the size of the table of splits, from the listing of the
    files (their contents are not read): no split but a file's last is smaller
    than the smaller of the two settings."""
    least = max(1, min(_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes")))
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    row = F.length("path") + ROW_BYTES
    return files.agg(F.coalesce(F.sum((F.floor(F.col("length") / least) + 1) * row), F.lit(0)).alias("n")).first().n


def numbered_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """(file, line_no, line): the lines of all files under ``path`` (glob
    allowed) with their number in their file, from 1.  Lines are not shuffled
    while the table of splits is small by ``split_table_bytes``; beyond that
    they are joined with it on (file, split)."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if split_table_bytes(spark, path) <= MAX_BROADCAST_BYTES:
        splits = F.broadcast(splits)
    out = rows.join(splits, ["file", "_start"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")
    return out if blank else out.where(~F.col("line").rlike(r"^\s*$"))
