"""Alignment of two tokenizers, with Arrow tables in the tasks.

Every text is encoded by both vocabularies.  In a run of documents the ids are
Arrow lists, flattened, with parent indices; cumulative sums of token sizes,
less the sum at the document's start, are the byte offsets where tokens end.  A
hash join of the two sides on (document, end) finds where both end; these ends
cut the tokens into groups, and tokens that share a group are linked.

Links come to one row an id pair and document (Table.group_by); a second
grouping gives each run's partial counts of documents, which Spark merges.  A
run's row in the written table holds its documents, its distinct pairs and,
document by document, which of these it has how often.  Merged counts go back
to the runs, not to the documents: a row for each pair of a run.

The space before a text and its bytes are what both sides have to spell.  Null
and empty texts, and texts that a side does not spell, have no tokens: zeros
and an empty column.  Rows that repeat are documents of their own, null keys
too; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import re
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, text_slices
from .tokens import byte_letters, encoder, vocabulary

#: Groups with more pairs than this are taken by their distinct ids.
MANY_PAIRS = 256
#: Segments that each encoder of a worker remembers, and bytes of text in a run
#: of documents and in what is aligned at once; they bound a worker's memory.
MOST_SEGMENTS = 150_000
RUN_BYTES = 1 << 20
PIECE_BYTES = 1 << 18
#: Bytes in a batch of texts, of which an executor holds one a task inside and
#: outside of its Python workers, and runs in a row group of their table, which
#: is read whole.
BATCH_BYTES = 8 << 20
GROUP_RUNS = 4
_ENDS = ",|;"
_ALONE = re.compile(r"(?<! ) ")


class PieceEncoder:
    """Ids of a sentence-piece model, as little-endian 32-bit numbers in bytes.

    If no piece has its space mark behind another character, no merge crosses
    from a word into the space before the next; a text may then be cut there,
    and every distinct segment is encoded once."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "ﬁ  a b "
        same = "".join(self.model.encode(probe, out_type=str)) == ("▁" + probe.replace(" ", "▁"))
        self.cuts = same and not any("▁" in n.lstrip("▁") for n in names) and "▁" in names
        self.known = {"": np.array([self.model.piece_to_id("▁")], "<i4").tobytes()} if self.cuts else {}
        byte = {f"<0x{b:02X}>": bytes([b]) for b in range(256)}
        self.spelt = [byte[n] if self.model.is_byte(i) else b"" if self.model.is_control(i) else n.replace("▁", " ").encode()
                      for i, n in enumerate(names)]

    def _cut(self, text: str) -> list[str]:
        if not self.cuts or "▁" in text:                 # a mark in the text itself counts as a space
            return [text]
        body = " " + text
        return _ALONE.split(body)[1:] if "  " in body else body.split(" ")[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, known = [self._cut(t) for t in texts], self.known
        new = list(set(itertools.chain.from_iterable(cut)).difference(known))
        for lo in range(0, len(new), 10_000):
            some = new[lo:lo + 10_000]
            known.update(zip(some, (array("i", ids).tobytes() for ids in self.model.encode(some, num_threads=1))))
        out = [b"".join(map(known.__getitem__, some)) for some in cut]
        if len(known) > MOST_SEGMENTS:
            for s in new:
                known.pop(s, None)
        return out


class Aligner:
    """Both vocabularies of one worker, and their tables."""

    def __init__(self, path_a: str, path_b: str):
        import pyarrow as pa
        self.a, self.b = encoder(path_a, special=False, most=MOST_SEGMENTS), PieceEncoder(path_b)
        back = {c: b for b, c in enumerate(byte_letters())}
        model = self.a.tokenizer
        names = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
        spelt_a = [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]
        self.spelt = [pa.array(s, pa.large_binary()) for s in (spelt_a, self.b.spelt)]
        self.sizes = [pa.array([len(x) for x in s], pa.int64()) for s in (spelt_a, self.b.spelt)]
        self.width = max(len(spelt_a), len(self.b.spelt))
        # every id with each separator behind it, and with none
        self.names = pa.array([f"{i}{end}" for end in (*_ENDS, "") for i in range(self.width)], pa.large_string())

    def tokens(self, texts: list[str], side: int):
        """Ids of the texts as one Arrow list each."""
        import pyarrow as pa
        raw = self.a.encode([" " + t if t else "" for t in texts]) if side == 0 else [
            b if t else b"" for t, b in zip(texts, self.b.encode(texts))]
        offs = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(raw), "<i4")))

    def spells(self, lists, side: int, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts the joined bytes of their tokens equal."""
        import pyarrow.compute as pc
        ids = np.asarray(lists.values)
        sizes = np.asarray(self.sizes[side].take(lists.values))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.asarray(lists.offsets)]
        joined = pc.take(self.spelt[side], lists.values).buffers()[2]
        joined = np.frombuffer(joined, np.uint8)[:ends[-1]] if len(ids) else np.zeros(0, np.uint8)
        n = np.diff(offs)
        ok = (n > 0) & (np.diff(ends) == n + 1)
        wide = np.zeros(int((n + 1).sum()), bool)            # where the space before each text goes
        wide[(offs[:-1] + np.arange(len(n)))] = True
        want = np.full(len(wide), 32, np.uint8)
        want[~wide] = data
        places = offs + np.arange(len(offs))
        if ok.all() and np.array_equal(joined, want):
            return ok
        for i in np.flatnonzero(ok):
            ok[i] = np.array_equal(joined[ends[i]:ends[i + 1]], want[places[i]:places[i + 1]])
        return ok


def _ends(lists, sizes):
    """(document, byte offset of its end) of every token, and both in one key."""
    import pyarrow as pa
    import pyarrow.compute as pc
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    total = pc.cumulative_sum(pc.take(sizes, flat))
    starts = np.concatenate([[0], np.asarray(total)])[np.asarray(lists.offsets)[:-1]]  # bytes before each document
    end = pc.subtract(total, pc.take(pa.array(starts, pa.int64()), parent))
    key = pc.add(pc.shift_left(parent, pa.scalar(36, pa.int64())), end)
    return np.asarray(flat), np.asarray(parent), key


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def align_run(aligner: Aligner, texts: list[str], data: np.ndarray, offs: np.ndarray, whole_groups: bool):
    """Per document n_a, n_b, n_groups, n_links and groups (digest or text), and
    a table (doc, pair, n) of linked id pairs: the ids, 32 bits each, in one
    number.  Documents are aligned about ``PIECE_BYTES`` of text at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc
    found, tables, lo = [], [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + PIECE_BYTES, "right")) - 1)
        hi = min(hi, len(texts))
        *counts, table = _align_piece(aligner, texts[lo:hi], data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], whole_groups)
        found.append(counts)
        tables.append(table.set_column(table.schema.get_field_index("doc"), "doc", pc.add(table["doc"], lo)))
        lo = hi
    n_a, n_b, groups, links, said = zip(*found)
    return *map(np.concatenate, (n_a, n_b, groups, links)), list(itertools.chain.from_iterable(said)), pa.concat_tables(tables)


def _align_piece(aligner: Aligner, texts: list[str], data: np.ndarray, offs: np.ndarray, whole_groups: bool):
    import pyarrow as pa
    n_docs = len(texts)
    lists = [aligner.tokens(texts, side) for side in (0, 1)]
    good = aligner.spells(lists[0], 0, data, offs) & aligner.spells(lists[1], 1, data, offs)
    if not good.all():
        lists = [_emptied(one, pa.array(good)) for one in lists]
    (id_a, doc_a, key_a), (id_b, doc_b, key_b) = (_ends(one, s) for one, s in zip(lists, aligner.sizes))
    left = pa.table({"key": key_a, "a": pa.array(np.arange(len(id_a)))})
    right = pa.table({"key": key_b, "b": pa.array(np.arange(len(id_b)))})
    both = left.join(right, "key", join_type="inner", use_threads=False)
    last_a, last_b = np.zeros(len(id_a), np.int64), np.zeros(len(id_b), np.int64)
    last_a[np.asarray(both["a"])] = 1
    last_b[np.asarray(both["b"])] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n_groups = int(last_a.sum())
    ca, cb = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    sa, sb = _starts(ca), _starts(cb)
    del left, right, both, key_a, key_b
    doc = doc_a[last_a > 0]
    groups = np.bincount(doc, minlength=n_docs)
    links = np.concatenate([[0], np.cumsum(ca * cb)])
    links = np.diff(links[np.concatenate([[0], np.cumsum(groups)])])
    n_a, n_b = np.bincount(doc_a, minlength=n_docs), np.bincount(doc_b, minlength=n_docs)

    # the groups, spelt: A's ids, then B's, of every group
    names = np.empty(len(id_a) + len(id_b), np.int64)
    names[np.arange(len(id_a)) + sb[group_a]] = id_a + last_a * aligner.width
    tail = last_b * 2
    tail[np.cumsum(n_b)[n_b > 0] - 1] = 3
    names[np.arange(len(id_b)) + (sa + ca)[group_b]] = id_b + tail * aligner.width
    spelt = aligner.names.take(pa.array(names))
    at = np.frombuffer(spelt.buffers()[1], np.int64, len(names) + 1)[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    body = memoryview(spelt.buffers()[2] or b"")
    said = [(bytes(body[x:y]).decode() if whole_groups else hashlib.sha256(body[x:y]).hexdigest()) if x < y else ""
            for x, y in zip(at[:-1], at[1:])]
    del lists, names, spelt, body, at, tail, last_a, last_b, group_a, group_b, doc_a, doc_b

    # links by id pair: common groups token by token, the others by distinct ids
    product = ca * cb
    some = np.flatnonzero(product <= MANY_PAIRS)
    of = np.repeat(some, product[some])
    k = np.arange(len(of)) - np.repeat(_starts(product[some]), product[some])
    wide_a, wide_b = id_a.astype(np.int64) << 32, id_b.astype(np.int64)
    del id_a, id_b
    pairs, docs, times = [wide_a[sa[of] + k // cb[of]] | wide_b[sb[of] + k % cb[of]]], [doc[of]], [np.ones(len(of), np.int64)]
    del of, k
    for g in np.flatnonzero(product > MANY_PAIRS):
        x, nx = np.unique(wide_a[sa[g]:sa[g] + ca[g]], return_counts=True)
        y, ny = np.unique(wide_b[sb[g]:sb[g] + cb[g]], return_counts=True)
        pairs.append((x[:, None] | y[None]).ravel())
        times.append((nx[:, None] * ny[None]).ravel())
        docs.append(np.full(len(pairs[-1]), doc[g]))
    table = pa.table({"doc": np.concatenate(docs), "pair": np.concatenate(pairs), "n": np.concatenate(times)})
    del pairs, docs, times, wide_a, wide_b
    table = table.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")])
    return n_a, n_b, groups, links, said, table


def _emptied(lists, keep):
    """Arrow lists, those not kept emptied."""
    import pyarrow as pa
    import pyarrow.compute as pc
    empty = pa.array([[]], lists.type)
    return pc.if_else(keep, lists, pc.take(empty, pa.array(np.zeros(len(lists), np.int64))))


def _runs(path_a: str, path_b: str, whole_groups: bool, schema):
    def runs(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema
        out_schema = to_arrow_schema(schema)
        store = sys.__dict__.setdefault("_llm_aligners", {})  # outlives one task's copy of this module
        if (path_a, path_b) not in store:
            store[path_a, path_b] = Aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch, most=RUN_BYTES):
                texts = [t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                n_a, n_b, groups, links, said, table = align_run(store[path_a, path_b], texts, data, offs, whole_groups)
                partial = table.group_by("pair", use_threads=False).aggregate([("pair", "count")]).sort_by("pair")
                distinct = np.asarray(partial["pair"].combine_chunks()) if len(partial) else np.zeros(0, np.int64)
                doc = np.asarray(table["doc"])
                order = np.argsort(doc, kind="stable")
                place = np.searchsorted(distinct, np.asarray(table["pair"])[order])
                cells = [number, batch.column(0).slice(lo, hi - lo), n_a, n_b, groups, links, said, distinct,
                         np.asarray(partial["pair_count"]), np.bincount(doc, minlength=hi - lo), place, np.asarray(table["n_sum"])[order]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64())] + [_one_list(c, f.type) for c, f in zip(cells[1:], list(out_schema)[1:])], schema=out_schema)
                number += 1
                del n_a, n_b, groups, links, said, table, partial, distinct, doc, order, place, cells
                pa.default_memory_pool().release_unused()     # or a worker keeps the pages of its largest run
    return runs


def _one_list(values, kind):
    import pyarrow as pa
    values = pa.array(values, kind.value_type) if not isinstance(values, pa.Array) else values.cast(kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)


def aligned_runs(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", whole_groups: bool = False) -> DataFrame:
    """One row a run of documents, written: run, lists over its documents (key,
    n_a, n_b, n_groups, n_links, groups, how many pairs), its distinct pairs and
    their documents, and pair (by place) and links of every document in turn."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("key", T.ArrayType(rows.schema["key"].dataType))]
                          + [T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")]
                          + [T.StructField("groups", T.ArrayType(T.StringType())), T.StructField("pair", long), T.StructField("docs", long),
                             T.StructField("pairs", long), T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("times", long)])
    return saved(rows.mapInArrow(_runs(path_a, path_b, whole_groups, schema), schema), "alignment-runs",
                 {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}, **{"parquet.block.row.count.limit": GROUP_RUNS})


def pair_counts(runs: DataFrame) -> DataFrame:
    """(pair, a, b, count, best): documents that hold ids a and b linked, and
    whether no other b has more with this a.  The greatest counts are one row an
    id of the vocabulary, so they are broadcast."""
    found = runs.select(F.explode(F.arrays_zip("pair", "docs")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(
        F.sum("x.docs").alias("count"))
    found = saved(found.withColumn("a", F.shiftright("pair", 32)), "alignment-pairs")
    top = found.groupBy("a").agg(F.max("count").alias("top"))
    return found.join(F.broadcast(top), "a").select(
        "pair", "a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "count", (F.col("count") == F.col("top")).alias("best"))


def _score(left, right):
    """Documents of one run, with the counts of its pairs."""
    import pyarrow as pa
    if sys.__dict__.pop("_llm_aligners", None):           # nothing is left to align: the worker's memory goes back
        sys.__dict__.pop("_llm_encoders", None)
        gc.collect()
    row = {c: left.column(c).combine_chunks().flatten() for c in left.column_names if c != "run"}
    n_pairs = np.asarray(row["pairs"])
    count, best = np.zeros(len(right), np.int64), np.zeros(len(right), bool)
    at = np.asarray(right["at"])
    count[at], best[at] = np.asarray(right["count"]), np.asarray(right["best"])
    place, times = np.asarray(row["place"]), np.asarray(row["times"])
    ends = np.concatenate([[0], np.cumsum(n_pairs)])
    each = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (np.where(best[place], times, 0), times * count[place])]
    return pa.table({"key": row["key"], **{c: row[c] for c in ("n_a", "n_b", "n_groups", "n_links")},
                     "n_best": pa.array(each[0], pa.int64()), "count_sum": pa.array(each[1], pa.int64()), "groups": row["groups"]})


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", whole_groups: bool = False) -> DataFrame:
    """One row a document: key, n_a, n_b, n_groups, n_links, n_best, count_sum
    and groups, as SHA-256 or, with ``whole_groups``, as text."""
    runs = aligned_runs(docs, path_a, path_b, key, text, whole_groups)
    counts = pair_counts(runs)
    asked = runs.select(F.col("run").alias("of"), F.posexplode("pair").alias("at", "pair")).join(counts.select("pair", "count", "best"), "pair").select(
        "of", "at", "count", "best")
    kind = runs.schema["key"].dataType.elementType
    schema = T.StructType([T.StructField("key", kind)] + [T.StructField(c, T.LongType()) for c in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups", T.StringType())])
    out = runs.drop("pair", "docs").groupBy("run").cogroup(asked.groupBy("of")).applyInArrow(_score, schema)
    return out.withColumnRenamed("key", key)


def piece_vocabulary() -> str:
    """The sentence-piece model that the registered query uses."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and pair counts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, vocabulary(), piece_vocabulary()).withColumnRenamed("groups", "groups_sha256")
