"""Annotation sidecars and the benchmark corpus file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered_lines

ANNOTATION_DDL = ("array<struct<trace_id:string, step_id:string, failure_category:string, notes:string, "
                  "mitigation:string, severity:string, annotator:string, tags:array<string>, "
                  "circuit_attribution:string>>")

CORPUS_KEYS = ["id", "step"]


def parse_annotations(files: DataFrame) -> DataFrame:
    """(file, text) with one JSON array of annotations per file -> one row
    per annotation with its position; an unreadable file yields nothing."""
    arr = F.from_json("text", ANNOTATION_DDL)
    return (files.select("file", F.posexplode_outer(arr).alias("pos", "a"))
            .filter(F.col("a").isNotNull())
            .select("file", "pos", "a.*"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    files = (spark.read.text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))
    return parse_annotations(files)


def check_corpus(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) -> the same with ``error`` for bad lines: not
    JSON, not an object, or missing ``id`` / ``step``."""
    from .wire import is_json_object
    v = F.try_parse_json("line")
    missing = F.filter(F.array(*[F.when(F.variant_get(v, f"$.{k}", "variant").isNull(), F.lit(k))
                                 for k in CORPUS_KEYS]), lambda x: x.isNotNull())
    err = (F.when(~is_json_object(F.col("line")), F.lit("not a JSON object"))
           .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))))
    return lines.select("file", "line_no", "line", err.alias("error"))


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of the corpus files with their 1-based line number
    inside their file; large files are read by many tasks."""
    return numbered_lines(spark, path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Strict corpus reader: the first bad line (or an empty corpus) raises
    an error naming the file and line.  One job looks at all lines; one row
    with their number and the first bad one reaches the driver."""
    lines = corpus_lines(spark, path)
    bad = F.when(F.col("error").isNotNull(), F.struct("file", "line_no", "error"))
    seen = check_corpus(lines).agg(F.count(F.lit(1)).alias("n"), F.min(bad).alias("bad")).first()
    if seen.bad:
        raise ValueError(f"{seen.bad.file}: line {seen.bad.line_no}: {seen.bad.error}")
    if not seen.n:
        raise ValueError("corpus is empty")
    r = F.from_json("line", "id string, framework string, license string")
    return lines.select("file", "line_no", r.alias("r"), "line").select("file", "line_no", "r.*", "line")
