"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing
and packing, each stage over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentrail.llm import jaccard_join, line_dedup, mixing, packing, quality_rules, tokens
from agentrail.llm.common import WORD, saved


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars of the text as it is now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines of later copies of a run of 50 words or more; a
    document that loses its last word goes."""
    out = line_dedup.dedup_lines(docs)
    return _counted(out.where((F.col("_n_deleted") == 0) | F.col("text").rlike(WORD)), docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates:
    five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document as often as it is taken, and the words of
    a partial take as a text of its own."""
    return _counted(mixing.mixed_documents(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return packing.pack(docs, tokens.vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The packing stage needs a tokenizer's ids, which SQL cannot make.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; every stage's rows are written to
    the shared folder and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
