"""Substring search over traces through an inverted index of trigrams.

A posting says that three characters in a row occur in a trace's header or in
its steps.  The postings lie in a bucketed table by trigram; a query reads the
buckets of its own trigrams, keeps the traces that hold all of them and runs the
plain search over those alone, so results are those of ``search_traces``.

New or changed traces are appended.  Postings of texts that a trace no longer has
stay until the index is built anew: they make a candidate that the search rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sinks.buckets import BucketTable
from .relational import header_hay, search_text, search_traces, step_hay

GRAM = 3
HEADER, STEPS = "header", "steps"
#: Buckets of a new index; a query of n characters reads n - 2 of them at most.
BUCKETS = 256


def grams(text: Column) -> Column:
    """Distinct trigrams of a text by code points, in time linear in its length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % GRAM), F.lit(1)))


def query_grams(query: str) -> list[str]:
    return sorted({query[i:i + GRAM] for i in range(len(query) - GRAM + 1)})


def postings(traces: DataFrame, steps: DataFrame) -> DataFrame:
    """(gram, trace_id, part), each once.  Rows without a trace id have none.
    Texts are dealt by trace before they are cut, so postings, which are many
    times as large, are not shuffled to find the repeated ones."""
    def of(df: DataFrame, hay: Column, part: str) -> DataFrame:
        texts = df.where(F.col("trace_id").isNotNull()).select("trace_id", hay.alias("hay")).repartition("trace_id")
        return (texts.select(F.explode(grams(F.col("hay"))).alias("gram"), "trace_id").distinct()
                .withColumn("part", F.lit(part)))

    return of(traces, header_hay(), HEADER).unionByName(of(steps, step_hay(), STEPS))


class TraceIndex:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark = spark
        self.table = BucketTable(spark, base, "gram", buckets)

    def add(self, traces: DataFrame, steps: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Index new or changed traces; ``stream`` = (stream, batch number) makes
        a replayed batch a no-op."""
        return self.table.append(postings(traces, steps), stream)

    def add_batch(self, traces: DataFrame, steps: DataFrame, batch_id: int) -> int:
        """``add`` inside ``foreachBatch``."""
        return self.add(traces, steps, self.table.batch_of(batch_id))

    def tidy(self) -> int:
        """Folders of all batches merged, repeated postings dropped."""
        return self.table.compact(distinct=True)

    def candidates(self, q: str) -> DataFrame | None:
        """Ids of the traces that may match: all trigrams of the query in the
        header, or all in the steps.  None for a query too short to have one,
        or before anything is indexed."""
        wanted = query_grams(search_text(q))
        if not wanted:
            return None
        asked = self.spark.createDataFrame([(g,) for g in wanted], "gram string")   # as long as the query
        found = self.table.lookup(asked)
        if found is None:
            return None
        return (found.where(F.col("gram").isin(wanted)).groupBy("trace_id", "part")
                .agg(F.countDistinct("gram").alias("_n")).where(F.col("_n") == len(wanted))
                .select("trace_id").distinct())

    def search(self, traces: DataFrame | BucketTable, steps: DataFrame | BucketTable,
               annotations: DataFrame | BucketTable, q: str) -> DataFrame:
        """``search_traces`` over the candidates.  Of a table bucketed by
        trace_id only the candidates' buckets are read.  A query of fewer than
        three characters reads everything."""
        tables = traces, steps, annotations
        ids = self.candidates(q)
        if ids is None:
            return search_traces(*[t.read() if isinstance(t, BucketTable) else t for t in tables], q)
        ids = materialize(ids, "search-candidates")
        return search_traces(*[t.lookup(ids) if isinstance(t, BucketTable) else t.join(ids, "trace_id", "left_semi")
                               for t in tables], q)
