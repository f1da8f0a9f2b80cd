"""Line dedup: a suffix array over line IDs, built by prefix doubling.

A document is a sequence of line IDs (digests of its \\n-split lines).  Round
k sorts the suffixes by their first 2^k lines: the rank of a suffix comes from
the ranks that the round before gave to its two halves.  Ranks are the places
of the distinct pairs in a distributed sort, so they follow the order of the
array.  A suffix that is alone with its prefix lies in no interval of the
longest-common-prefix array and leaves the doubling; what stays is exactly the
inside of the intervals, and the rounds end when no interval is as deep as the
next power of two or no run needs a deeper one.

A run counts when its lines hold ``min_words`` words together.  The shortest
run from each line that does, and the shortest run up to each line, have their
place in an interval: (rank of the first 2^j lines, rank of the last 2^j
lines) with 2^j <= length.  Of the suffixes of one interval the first in
(doc_id, line) order stays; the lines of the others' runs are deleted.  These
runs cover every maximal repeated run that holds ``min_words`` words, no more
and no less.

Only DataFrame functions are used.  Lines travel as 16-byte digests, texts are
not shuffled before the last join.  Joins have one exchange a side, so that
adaptive execution can split a line that holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, aside, back, saved

MIN_WORDS = 50


def _digest(c: Column) -> Column:
    """The first 128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a line: document (key, hash of the text), place, digest, words.
    Null texts have no lines; texts under the least run have none that count."""
    t = F.col(text)
    one = docs.where(t.isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(t).alias("txt"), F.split(t, "\n").alias("ls"))
    return one.select("doc", "txt", F.posexplode("ls").alias("ln", "line")).select(
        "doc", "txt", F.col("ln").cast("long").alias("ln"), _digest(F.col("line")).alias("id"),
        F.regexp_count("line", F.lit(WORD)).cast("long").alias("w"))


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.txt") == F.col(f"{b}.txt"))


def _ranks(suffixes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys that two suffixes or more share, each with its place in a
    distributed sort; written once, so that places never change."""
    at = F.struct("doc", "txt", "ln")
    shared = suffixes.groupBy(*keys).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where(
        F.col("lo") != F.col("hi")).select(*keys)
    order = shared.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return saved(order.withColumn("rank", F.monotonically_increasing_id()), name)


def _first_round(lines: DataFrame, min_words: int) -> DataFrame:
    """Suffixes whose first line occurs elsewhere too, in stretches of such
    lines with ``min_words`` words: only these can hold a repeated run.
    ``seg`` names the stretch, ``before`` counts its words up to the line."""
    ranks = _ranks(lines, ["id"], "lines-rank-0")
    doc = Window.partitionBy("doc", "txt")
    active = lines.join(ranks, "id").groupBy("doc", "txt", "ln").agg(
        F.min("rank").alias("rank"), F.min("w").alias("w"))  # rows that repeat a document are one
    active = active.withColumn("seg", F.col("ln") - F.row_number().over(doc.orderBy("ln")))
    seg = Window.partitionBy("doc", "txt", "seg")
    active = active.withColumn("total", F.sum("w").over(seg)).where(F.col("total") >= min_words)
    return saved(active.withColumn("before", F.sum("w").over(seg.orderBy("ln")) - F.col("w")), "lines-suffixes-0")


def _runs(first: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of ``min_words`` words from each line and up to each
    line (doc, txt, ln, len).  Line starts and the word counts to look for are
    sorted together inside each stretch; the next line start after (before) a
    sought count ends (begins) the run."""
    seg = Window.partitionBy("doc", "txt", "seg")
    b, w, ln = F.col("before"), F.col("w"), F.col("ln")

    def event(v: Column, kind: int) -> Column:
        return F.struct(v.alias("v"), F.lit(kind).alias("kind"), ln.alias("ln"))

    closing = F.when(b + w == F.col("total"), F.struct((b + w).alias("v"), F.lit(0).alias("kind"), (ln + 1).alias("ln")))
    events = F.array_compact(F.array(event(b, 0), closing, event(b + min_words, 1), event(b + w - min_words, 2)))
    ev = first.select("doc", "txt", "seg", "total", F.explode(events).alias("e")).select("doc", "txt", "seg", "total", "e.*")
    ev = ev.where((F.col("kind") == 0) | F.col("v").between(0, F.col("total")))
    edge = F.when(F.col("kind") == 0, F.col("ln"))
    after = seg.orderBy(F.col("v").desc(), "kind", F.col("ln").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = seg.orderBy("v", "kind", "ln").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("end", F.last(edge, ignorenulls=True).over(after))
    ev = ev.withColumn("start", F.last(edge, ignorenulls=True).over(upto))
    kind = F.col("kind")
    runs = ev.where(kind > 0).select(
        "doc", "txt", F.when(kind == 1, ln).otherwise(F.col("start")).alias("ln"),
        F.when(kind == 1, F.col("end") - ln).otherwise(ln + 1 - F.col("start")).alias("len"))
    return runs.where("len > 0").distinct()


def _next_round(suffixes: DataFrame, k: int) -> DataFrame:
    """Ranks by 2^(k+1) lines from ranks by 2^k: both halves must be ranked."""
    a, b = suffixes.alias("a"), suffixes.alias("b")
    pairs = a.join(b, _same_doc("a", "b") & (F.col("b.ln") == F.col("a.ln") + 2 ** k)).select(
        "a.doc", "a.txt", "a.ln", F.col("a.rank").alias("r1"), F.col("b.rank").alias("r2"))
    ranks = _ranks(pairs, ["r1", "r2"], f"lines-rank-{k + 1}")
    return saved(pairs.join(ranks, ["r1", "r2"]).select("doc", "txt", "ln", "rank"), f"lines-suffixes-{k + 1}")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """The lines of later copies: doc (key), txt (hash of the text), lines
    (places from 0).  Runs cross no document's end.  Rows that repeat both key
    and text are one document; documents with one key are told apart by their
    text; null keys come first."""
    first = _first_round(_lines(docs, key, text), min_words)
    runs = saved(_runs(first, min_words).withColumn("k", F.length(F.bin("len")) - 1), "lines-runs")
    deepest = runs.agg(F.max("k")).first()[0] or 0
    suffixes = first.select("doc", "txt", "ln", "rank")
    levels = suffixes.withColumn("k", F.lit(0))
    for k in range(deepest):
        suffixes = _next_round(suffixes, k)
        levels = levels.unionByName(suffixes.withColumn("k", F.lit(k + 1)))
    head, tail = levels.alias("h"), levels.alias("t")
    power = F.pow(F.lit(2.0), F.col("r.k")).cast("long")
    placed = runs.alias("r").join(
        head, _same_doc("r", "h") & (F.col("h.k") == F.col("r.k")) & (F.col("h.ln") == F.col("r.ln"))).join(
        tail, _same_doc("r", "t") & (F.col("t.k") == F.col("r.k"))
        & (F.col("t.ln") == F.col("r.ln") + F.col("r.len") - power)).select(
        "r.doc", "r.txt", "r.ln", "r.len", F.col("h.rank").alias("r1"), F.col("t.rank").alias("r2"))
    placed = saved(placed, "lines-placed")
    at = F.struct("doc", "txt", "ln")
    interval = placed.groupBy("len", "r1", "r2").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where(
        F.col("lo") != F.col("hi")).drop("hi")
    later = placed.join(interval, ["len", "r1", "r2"]).where(at != F.col("lo"))
    gone = later.select("doc", "txt", F.explode(F.sequence("ln", F.col("ln") + F.col("len") - 1)).alias("line"))
    return gone.groupBy("doc", "txt").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` less the lines of later copies, and ``_n_lines``
    and ``_n_deleted`` (replaced if there).  All rows and columns stay; null
    texts stay null with no lines."""
    gone = repeated_lines(docs, key, text, min_words)
    out = aside(docs, key=key, text=text).withColumn("txt", F.xxhash64("text")).alias("d")
    out = out.join(gone.alias("g"), F.col("d.key").eqNullSafe(F.col("g.doc")) & (F.col("d.txt") == F.col("g.txt")), "left").select(
        "d.row", "d.text", F.col("g.lines").alias("gone"), F.split("d.text", "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("lines").cast("long") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i.cast("int"))), "\n")
    out = out.withColumns({"n_lines": F.coalesce(F.size("lines"), F.lit(0)).cast("long"),
                           "n_deleted": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
                           "left": F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)})
    return out.select(*back(docs, ("_n_lines", "_n_deleted"), **{text: "left"}),
                      F.col("n_lines").alias("_n_lines"), F.col("n_deleted").alias("_n_deleted"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, the lines that repeat an earlier run of 50 words
    or more, and the length and digest of what is left of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"),
        F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


# Extends every suffix line by line while two or more share it.
OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                            generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
l AS (SELECT doc_id, line, ln, len(regexp_extract_all(line, '[^ 	-
]+')) AS w,
             row_number() OVER (ORDER BY doc_id, ln) AS pos FROM d),
run AS (
  SELECT * FROM (SELECT 1 AS k, pos, doc_id, min(pos) OVER (PARTITION BY line) AS g,
                        count(*) OVER (PARTITION BY line) AS c, w FROM l) WHERE c > 1
  UNION ALL
  SELECT * FROM (SELECT r.k + 1 AS k, r.pos, r.doc_id, min(r.pos) OVER (PARTITION BY r.g, n.line) AS g,
                        count(*) OVER (PARTITION BY r.g, n.line) AS c, r.w + n.w AS w
                 FROM run r JOIN l n ON n.pos = r.pos + r.k AND n.doc_id = r.doc_id) WHERE c > 1),
longest AS (SELECT pos, max(k) AS k FROM run WHERE pos > g AND w >= 50 GROUP BY pos),
gone AS (SELECT DISTINCT unnest(range(pos, pos + k)) AS pos FROM longest),
left_ AS (SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_deleted,
                 string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE gone.pos IS NULL) AS kept
          FROM l LEFT JOIN gone USING (pos) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
       length(CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END)::BIGINT AS kept_chars,
       sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END) AS kept_sha256
FROM documents d LEFT JOIN left_ USING (doc_id)
"""
