"""Best-fit packing by a plan over lengths.

Documents become pieces of at most ``SEQUENCE`` tokens.  The plan needs only
how many pieces have each length: lengths from long to short take, all pieces
of one length at a time, the open sequences with the least room that fits.
Sequences that are filled alike are one range of numbers, so the plan is a
short list of slots (length, ranks, first sequence, offset), whatever the
number of documents.  A piece then takes the slot of its rank among the pieces
of its length.

Ranks are counted in ``BUCKETS`` parts of each length, so that no length meets
in one task; the counts by length and part, at most SEQUENCE x BUCKETS rows,
are all that the driver sees.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved
from .tokens import encoder, text_groups, vocabulary

SEQUENCE = 2048
SEPARATOR = 0
#: Pieces of one length are ranked in buckets of about so many.
BUCKET_PIECES = 200_000


def cut_points(n: int, most: int) -> list[int]:
    """Starts of a document's pieces: only a longer one is cut, and what its
    length has over whole pieces is the first."""
    first = n % most or most
    return [0, *range(first, n, most)]


def _pieces(vocab: str, most: int, separator: int, schema):
    def pieces(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        enc, out_schema = encoder(vocab), to_arrow_schema(schema)
        last = np.array([separator], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in text_groups(texts):
                row, nth, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(enc.encode(texts[lo:hi])):
                    raw = memoryview(raw + last)
                    n = len(raw) // 4
                    at = cut_points(n, most)
                    for j, (a, b) in enumerate(zip(at, at[1:] + [n])):
                        row.append(lo + i), nth.append(j), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a:4 * b]))
                cols = [batch.column("key").take(pa.array(row, pa.int64())), pa.array(nth), pa.array(start),
                        pa.array(length), pa.array(crc)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
    return pieces


def plan(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts by length.  Slots: (length, first
    rank, end rank, first sequence, offset); rank r of the length goes to
    sequence ``first + r - first rank`` at the offset."""
    room: dict[int, list[list[int]]] = {}  # room left -> ranges [first sequence, number]
    left: list[int] = []                   # the keys of room, ascending
    slots, n_seq = [], 0

    def put(space: int, first: int, number: int) -> None:
        if space:
            if space not in room:
                bisect.insort(left, space)
                room[space] = []
            room[space].append([first, number])

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            i = bisect.bisect_left(left, length)
            if i < len(left):
                space = left[i]
                first, number = room[space].pop()
                if not room[space]:
                    del room[space], left[i]
                k = min(number, count - rank)
                if k < number:
                    put(space, first + k, number - k)
                slots.append((length, rank, rank + k, first, most - space))
                put(space - length, first, k)
                rank += k
            else:                          # fill new sequences with this length alone
                each = most // length
                k = (count - rank) // each
                if k:
                    for j in range(each):
                        slots.append((length, rank + j * k, rank + (j + 1) * k, n_seq, j * length))
                    put(most - each * length, n_seq, k)
                    rank += k * each
                    n_seq += k
                if rank < count:           # too few for one more full sequence
                    for j in range(count - rank):
                        slots.append((length, rank + j, rank + j + 1, n_seq, j * length))
                    put(most - (count - rank) * length, n_seq, 1)
                    rank, n_seq = count, n_seq + 1
    return slots


def pack(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text",
         most: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id,
    offset.  Null texts are empty (one piece, the separator); rows that repeat
    are packed as rows of their own; other columns are left out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["key"], T.StructField("piece", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    pieces = rows.mapInArrow(_pieces(vocab, most, separator, schema), schema)
    pieces = saved(pieces.withColumn("h", F.xxhash64("key", "piece", "ids_crc32")), "pack-pieces")
    lengths = pieces.groupBy("length").count().select("length", F.ceil(F.col("count") / BUCKET_PIECES).alias("buckets"))
    lengths = spark.createDataFrame([tuple(r) for r in lengths.collect()], "length long, buckets long")  # ``most`` rows
    pieces = pieces.join(F.broadcast(lengths), "length").withColumn("bucket", F.pmod("h", "buckets").cast("int"))
    counted = pieces.groupBy("length", "bucket").count().collect()
    counts: dict[int, int] = {}
    bases = []
    for r in sorted(counted, key=lambda r: (r["length"], r["bucket"])):
        bases.append((r["length"], r["bucket"], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    base = spark.createDataFrame(bases, "length long, bucket int, base long")
    slots = spark.createDataFrame(plan(counts, most), "length long, lo long, hi long, first long, offset long")
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("nth", nth.cast("long") - 1).join(F.broadcast(base), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth"))
    out = ranked.alias("p").join(F.broadcast(slots).alias("s"), (F.col("p.length") == F.col("s.length"))
                                 & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(F.col("key").alias(key), "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
                      (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary())
