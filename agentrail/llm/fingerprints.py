"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

Leaves are phrases: runs of words inside a line that end where a hash of the
last word says so, so an edit moves no border but its own.  A paragraph is a
line, its digest is that of its phrases' digests; a section is a run of
paragraphs that ends where a paragraph's digest says so; the root is the digest
of the sections.  Digests cover all characters of the text.

A fingerprint is text: ``root:section,section,...`` where a section is its
digest and its leaves' codes.  Roots test equality.  Trees are compared from
the top: equal sections are equal in all their leaves, only differing ones are
opened, and what differs there are the edits.  The likeness of two is the
share of leaves that they have in common, 1 only for equal roots.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, saved

#: One word in so many ends a phrase; one paragraph in so many a section.
PHRASE, SECTION = 6, 4
#: A longer run of bytes without a space (script without spaces, tables, encoded
#: data) also ends a phrase inside, after one byte in about ``INSIDE``, where a
#: hash of the last four says so.
LONG_WORD, INSIDE = 64, 32
CODE_BYTES = 3  # of a leaf, in a fingerprint


def _digest(data: bytes, size: int = 16) -> bytes:
    return blake2b(data, digest_size=size).digest()


def _inside(word: bytes) -> list[bytes]:
    """A long run of bytes cut by what it holds."""
    x = np.frombuffer(word, np.uint8).astype(np.uint32)
    h = x[3:] + x[2:-1] * np.uint32(0x9E37) + x[1:-2] * np.uint32(0x85EBCA6B) + x[:-3] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    at = (np.flatnonzero((h >> np.uint32(12)) % np.uint32(INSIDE) == 0) + 4).tolist()
    return [p for p in (word[a:b] for a, b in zip([0, *at], [*at, len(word)])) if p]


def leaves(line: bytes, ends: dict[bytes, bool]) -> list[bytes]:
    """The phrases of a paragraph; ``ends`` remembers which words end one."""
    out, held = [], []
    for word in line.split(b" "):
        if len(word) > LONG_WORD:
            *firsts, word = _inside(word)
            for part in firsts:
                out.append(b" ".join([*held, part]))
                held = []
        held.append(word)
        end = ends.get(word)
        if end is None:
            if len(ends) > 200_000:
                ends.clear()
            end = ends[word] = _digest(word, 2)[0] % PHRASE == 0
        if end:
            out.append(b" ".join(held))
            held = []
    if held:
        out.append(b" ".join(held))
    return out


def fingerprint(text: str, ends: dict[bytes, bool] | None = None, known: dict | None = None) -> str:
    """The tree of a text as a string; equal texts give equal ones.  ``known``
    keeps paragraphs that a second text may share."""
    ends, known = {} if ends is None else ends, {} if known is None else known
    out, codes, paragraphs, digests = [], [], [], []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        got = known.get(line)
        if got is None:
            ds = [_digest(x, 8) for x in leaves(line, ends)]
            got = known[line] = _digest(b"".join(ds)), b"".join([d[:CODE_BYTES] for d in ds])
        paragraphs.append(got[0])
        codes.append(got[1])
        if got[0][0] % SECTION == 0:
            digests.append(_digest(b"".join(paragraphs)))
            out.append(digests[-1][:4].hex() + b"".join(codes).hex())
            codes, paragraphs = [], []
    if paragraphs:
        digests.append(_digest(b"".join(paragraphs)))
        out.append(digests[-1][:4].hex() + b"".join(codes).hex())
    return _digest(b"".join(digests)).hex() + ":" + ",".join(out)


def sections(fp: str) -> list[tuple[str, list[str]]]:
    """A fingerprint's sections: digest and leaf codes."""
    n = 2 * CODE_BYTES
    return [(s[:8], [s[i:i + n] for i in range(8, len(s), n)]) for s in fp.partition(":")[2].split(",")]


def differing(a: str, b: str) -> tuple[list[int], list[int]]:
    """Where two fingerprints differ: places of the leaves that the other has
    not, by opening the differing sections only."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return [], []
    sa, sb = sections(a), sections(b)
    found = []
    for mine, other in ((sa, sb), (sb, sa)):
        same = Counter((d, len(c)) for d, c in other)
        rest = Counter(x for d, c in other if (d, len(c)) not in {(d2, len(c2)) for d2, c2 in mine} for x in c)
        at, places = 0, []
        for d, c in mine:
            if same[(d, len(c))] > 0:
                same[(d, len(c))] -= 1
            else:
                for i, x in enumerate(c):
                    if rest[x] > 0:
                        rest[x] -= 1
                    else:
                        places.append(at + i)
            at += len(c)
        found.append(places)
    return found[0], found[1]


def likeness(a: str, b: str) -> float:
    """Share of leaves in common, from the two fingerprints alone."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    sa, sb = (Counter((d, tuple(c)) for d, c in sections(x)) for x in (a, b))
    total = sum(len(c) * n for x in (sa, sb) for (_, c), n in x.items())
    common = sum(len(c) * n for (_, c), n in (sa & sb).items())
    la, lb = (Counter(x for (_, c), n in (mine - other).items() for _ in range(n) for x in c)
              for mine, other in ((sa, sb), (sb, sa)))
    common += sum((la & lb).values())
    return min(2 * common / total, 0.999) if total else 0.0


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by the first as many (or all)
    of the following text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


_OUT = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
        ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _describe(schema):
    def describe(batches):
        """Rows of a part come in order, its guest first; each other row is
        described against the one before it."""
        ends: dict[bytes, bool] = {}
        held = None
        for batch in batches:
            rows, own = [], []
            for i, (part, guest, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "text")))):
                known: dict = {}
                fp = fingerprint(text, ends, known)
                if not guest:
                    _, following, next_fp = held
                    e = edited(text, following)
                    efp = fingerprint(e, ends, known)
                    own.append(i)
                    rows.append((len(text), sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), fp, efp,
                                 likeness(fp, efp), likeness(fp, next_fp)))
                held = part, text, fp
            yield keyed(batch.column("key"), rows, schema, own)
    return describe


def _sort_key(key, h):
    return (key is not None, 0 if key is None else key, h)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is the one with the next lower key, after the last the
    first; equal keys go by their text's hash, null keys are the lowest.  A
    sort of keys and hashes alone cuts the order into parts (the driver sees
    the first and last key of each); texts are then shuffled once, to their
    part, with the last document of each part going to the next one as well.
    Null texts are empty; rows equal in key and text follow each other; an
    empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("h"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # said outright: by the size of keys alone the parts would be few
    order = rows.select("key", "h").repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h")
    order = saved(order.withColumn("seq", F.monotonically_increasing_id()), "fingerprint-order")
    at = F.struct("seq", "key", "h")
    ends = order.groupBy(F.shiftright("seq", 33).alias("p")).agg(F.min(at).alias("a"), F.max(at).alias("z")).collect()
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *[T.StructField(*c) for c in _OUT]])
    if not ends:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    ends.sort(key=lambda r: r["p"])
    heads = [_sort_key(r["a"]["key"], r["a"]["h"]) for r in ends]
    tails = {_sort_key(r["z"]["key"], r["z"]["h"]): (i + 1) % len(ends) for i, r in enumerate(ends)}
    dealt = rows.withColumn("to", _places(heads, tails)("key", "h")).select("key", "h", "text", F.explode("to").alias("part"))
    dealt = dealt.select("key", "h", "text", F.abs("part").alias("part"), (F.col("part") < 0).alias("guest"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", F.col("guest").desc(), "key", "h")
    return dealt.mapInArrow(_describe(schema), schema).withColumnRenamed("key", key)


def _places(heads: list, tails: dict):
    """Parts (from 1) that a row goes to; negative as a guest."""
    import bisect

    @F.arrow_udf("array<int>")
    def places(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for k, h in zip(keys.to_pylist(), hashes.to_pylist()):
            me = _sort_key(k, h)
            to = [bisect.bisect_right(heads, me)]
            if me in tails:
                to.append(-(tails[me] + 1))
            out.append(to)
        return pa.array(out, pa.list_(pa.int32()))

    return places


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike
    they and the next document's are."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
