"""Helpers shared by the training-data operators: words, scratch tables and
Arrow batches as flat byte arrays."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space between words: space, tab, line feed, vertical tab, form feed,
#: carriage return.  A word is a maximal run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are handled in slices of about so many bytes inside a task.
SLICE_BYTES = 4 << 20


def word_array(text: Column) -> Column:
    """Words of ``text``; an empty array for null or blank text."""
    body = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(body, F.lit("")) == "", none).otherwise(F.split(body, SPLIT))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: The setting by which Spark removes a query's shuffle files when it ends, not
#: when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession, settings: dict[str, str] | None = None) -> Iterator[None]:
    """Queries made and run in here leave no shuffle files, and have these
    settings."""
    settings = {_TIDY: "true"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str, settings: dict[str, str] | None = None, **options: int) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: computed
    once, safe against lost executors, and with its lineage cut.  ``settings``
    hold while it is written, ``options`` are those of the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark, settings):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` gave.  Only for those that nothing reads any
    more: what was made of them is saved, too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def aside(docs: DataFrame, **named: str) -> DataFrame:
    """The columns of ``docs`` under names of the operator's own, all of them
    once more in a struct ``row``: no name of a user's column can clash."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    return docs.select(*[F.col(f"`{c}`").alias(name) for name, c in named.items()], row.alias("row"))


def back(docs: DataFrame, less: tuple[str, ...] = (), **new: str) -> list[Column]:
    """The columns of ``docs`` out of ``row``, without those called as in
    ``less``; ``new`` gives column by column what replaces it."""
    less = tuple(c.lower() for c in less)
    return [F.col(new[c]).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in less]


def keyed(keys, rows: list[tuple], schema, which: list[int] | None = None):
    """An Arrow batch of the key column as it came (for the rows ``which``) and
    of rows of Python values for the other columns."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(schema)
    keys = keys if which is None else keys.take(pa.array(which, pa.int64()))
    cols = list(zip(*rows)) if rows else [()] * (len(out) - 1)
    return pa.RecordBatch.from_arrays([keys.cast(out.field(0).type)] + [pa.array(c, f.type) for c, f in zip(cols, list(out)[1:])], schema=out)


def text_slices(batch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow batch into runs of rows of about ``most`` bytes of text.

    Yields (first row, end row, bytes, offsets): the UTF-8 bytes of the rows'
    texts one after the other, and each row's start in them plus the end.
    Null texts are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it belongs to."""
    blank = (data == 32) | ((data - np.uint8(9)) < 5)
    inside = ~blank
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True                      # a row's end also ends a word
    first, last = inside.copy(), inside.copy()
    first[1:] &= blank[:-1] | edge[1:-1]
    last[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap: each byte is weighed
    by a pseudo-random number for its place, the sum and the length mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    firsts = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(firsts, lens)
    at = place + np.repeat(starts, lens)
    weights = mix64(np.arange(int(lens.max()), dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(weights[place] * (data[at].astype(np.uint64) + np.uint64(1)), firsts)
        return mix64(sums + mix64(lens.astype(np.uint64)))
