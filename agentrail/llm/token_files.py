"""Token files: ids of whole documents in Parquet list columns.

Documents are range-partitioned and sorted by key before they are encoded, so
one shuffle of texts gives files in ascending key order.  Ids, places and
lengths are delta encoded (about 17 bits an id, at less work than a dictionary
of the vocabulary takes); row groups and pages are small enough that the page indexes let a
reader skip to a few documents, and a reader of lengths never touches ids.

Columns: the key, ``seq`` (file order; its upper bits number the file part),
``n_tokens``, ``ids`` and any metadata columns asked for.  Null texts are
empty, rows that repeat are rows of their own (equal keys in order of their
texts' hash), null keys come first, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .tokens import encoder, text_groups, vocabulary

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
#: Rows of a page at most: keys are small, and a reader of one document opens
#: the ids of all rows of its key's page.
PAGE_ROWS = 1000


def _encode(vocab: str, end_id: int, keep: list[str], schema):
    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        enc, out_schema = encoder(vocab), to_arrow_schema(schema)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in text_groups(texts):
                raw = [b + end for b in enc.encode(texts[lo:hi])]
                lens = np.array([len(b) // 4 for b in raw], np.int64)
                ids = np.frombuffer(b"".join(raw), "<i4")
                offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                cols = [batch.column(c).slice(lo, hi - lo) for c in keep]
                cols += [pa.array(lens), pa.ListArray.from_arrays(pa.array(offs), pa.array(ids))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
    return encode


def write_tokens(docs: DataFrame, path: str, vocab: str, key: str = "doc_id", text: str = "text",
                 meta: list[str] = (), end_id: int = END_ID) -> None:
    """Write the ids of every text, ``end_id`` after each, to ``path``.
    Metadata columns called like the file's own are refused."""
    clash = {m.lower() for m in meta} & {"seq", "n_tokens", "ids", "_h", "text"}
    if clash:
        raise ValueError(f"metadata columns clash with the file format: {sorted(clash)}")
    rows = docs.select(key, *meta, F.xxhash64(text).alias("_h"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(key, "_h").sortWithinPartitions(key, "_h").drop("_h")
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept]
                          + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = rows.mapInArrow(_encode(vocab, end_id, [f.name for f in kept], schema), schema)
    out = out.withColumn("seq", F.monotonically_increasing_id())
    (out.write.option("compression", "snappy").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "false").parquet(path))


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """Columns and rows of a token table; only their pages are read."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def _crc(schema, keep: list[str]):
    def crc(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        out_schema = to_arrow_schema(schema)
        for batch in batches:
            ids = batch.column("ids")
            offs = np.asarray(ids.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(ids.values), "<u4").view(np.uint8))
            sums = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.int64())
            n = pa.array(np.diff(offs).astype(np.int64))
            cols = [batch.column(c) for c in keep] + [n, sums]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
    return crc


def token_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start (ids before it), n_tokens and
    the CRC-32 of its ids.  Sums by file part give each part's start; there is
    one row a part, so they are broadcast."""
    df = read_tokens(spark, path, [key, "seq", "ids"])
    schema = T.StructType([df.schema[key], df.schema["seq"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    rows = df.mapInArrow(_crc(schema, [key, "seq"]), schema)
    part = F.shiftright("seq", 33)
    parts = read_tokens(spark, path, ["seq", "n_tokens"]).groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0).cast("long"))
    parts = parts.select("part", before.alias("before"))
    run = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", part)
    rows = rows.withColumn("upto", F.sum("n_tokens").over(run)).join(F.broadcast(parts), "part")
    return rows.select(key, (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document and returns each one's place, length
    and checksum as read back from the files."""
    path = scratch_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, vocabulary())
    return token_index(spark, path)
