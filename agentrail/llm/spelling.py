"""Spelling variants by k-d trees over letter-count vectors.

Words of a corpus, counted by Spark, are near when one letter inserted, deleted
or replaced turns one into the other.  An edit moves a word's vector of letter
counts by at most two (L1): a replaced letter takes one away and adds one, an
inserted letter adds one.

1. For each length with many words a k-d tree is planned from a bounded sample
   of vectors.  Every word is stored in one cell of its length's tree and sent
   as a query to the cells of its own and of the next length whose box is
   within reach: crossing a split uses up the letter taken away or added.
2. In a cell a finer tree of the same kind prunes the members again; where the
   vectors are near enough, the order of the letters decides.
3. A cell returns one row a word (its near words there, the most frequent of
   them), not the pairs.  Every near pair meets in exactly one cell, so sums
   and extremes over cells are exact, whatever the splits are.

A word's form is its near word of most occurrences, if it has ``RATIO`` times
its own or more; occurrences at least double along forms, so they lead to a
root in a few rounds of pointer doubling.

Null texts have no words, a null key counts as empty, rows that repeat count
each, ties go to the word smallest in code-point order, an empty table gives no
rows.  Other columns of the documents are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

# Fixed values of the contract: what a run of letters is, which runs lose a
# letter, and which words count.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPOILT, LEAST_LETTERS, LEAST_COUNT, RATIO = 97, 5, 3, 2
#: Letters are numbered a to z, then U+00C0 to U+00FF.
DIMS = 26 + 64
#: Members that a cell is planned for, vectors that the trees are planned from
#: (expected number, over all lengths; every word is stored and searched), and
#: members of a leaf inside a cell.
CELL, SAMPLE, LEAF = 8192, 200_000, 128
#: Pairs of vectors, or letters, compared in one step.
STEP = 1 << 22


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spoilt(key: Column, run: Column) -> Column:
    """``run``, less one letter where the checksum of key and run says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.pmod(h, F.lit(SPOILT)) == 0, less).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """word, n of every word of ``LEAST_LETTERS`` letters with ``least``
    occurrences; counted map-side first, so a frequent word is no hot key."""
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= LEAST_LETTERS).select(spoilt(F.col("key"), lower_ascii(F.col("run"))).alias("word"))
    return runs.where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def letter_codes(words: list[str], length: int) -> np.ndarray:
    """Numbers of the letters of words of one length, a row a word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, length)
    return np.where(points < 0xC0, points - np.uint32(97), points - np.uint32(0xC0 - 26)).astype(np.uint8)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    n = len(codes)
    at = (np.arange(n, dtype=np.int64)[:, None] * DIMS + codes).ravel()
    return np.bincount(at, minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)


class Tree:
    """Splits (dimension, greatest value on the left); leaves are numbered."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.nodes: list[tuple[int, int, int, int]] = []   # dim, cut, left, right; leaves: -1, number, 0, 0
        self.members: list[np.ndarray] = []
        todo = [(self._new(), np.arange(len(points)))]
        while todo:
            node, some = todo.pop()
            split = self._split(points[some]) if len(some) > leaf else None
            if split is None:
                self.nodes[node] = (-1, len(self.members), 0, 0)
                self.members.append(some)
                continue
            left = points[some, split[0]] <= split[1]
            a, b = self._new(), self._new()
            self.nodes[node] = (*split, a, b)
            todo += [(a, some[left]), (b, some[~left])]

    def _new(self) -> int:
        self.nodes.append((-1, 0, 0, 0))
        return len(self.nodes) - 1

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        """The cut that halves the points best; none if all are alike."""
        best = None
        for d in np.flatnonzero(points.min(0) < points.max(0)):
            values, n = np.unique(points[:, d], return_counts=True)
            below = np.cumsum(n)[:-1]
            i = int(np.abs(2 * below - len(points)).argmin())
            off = abs(2 * int(below[i]) - len(points))
            if best is None or off < best[0]:
                best = (off, int(d), int(values[i]))
        return best and best[1:]

    def reach(self, vectors: np.ndarray, less: int, more: int):
        """(leaf, rows) of the vectors that reach a leaf's box when ``less``
        letters may go and ``more`` may come (0 or 1 each)."""
        n = len(vectors)
        todo = [(0, np.arange(n), np.full(n, less, np.int8), np.full(n, more, np.int8))]
        while todo:
            node, rows, down, up = todo.pop()
            dim, cut, a, b = self.nodes[node]
            if dim < 0:
                yield cut, rows
                continue
            v = vectors[rows, dim]
            here, over = v <= cut, (v == cut + 1) & (down > 0)
            for child, own, paid, d, u in ((a, here, over, down - over, up), (b, ~here, (v == cut) & (up > 0), down, up - ((v == cut) & (up > 0)))):
                go = own | paid
                if go.any():
                    todo.append((child, rows[go], np.where(own, down, d)[go], np.where(own, up, u)[go]))


def shared_letters(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sum of the lesser counts for every pair of rows.  The lesser of two
    counts is how many steps 1, 2, ... both reach, so a product of matrices
    gives it, unless counts are very high."""
    dims = np.flatnonzero(m.max(0))
    tops = m[:, dims].max(0)
    if tops.sum() > 1024:
        return sum(np.minimum(q[:, d][:, None], m[:, d][None]) for d in dims)
    dim, step = np.repeat(dims, tops), np.concatenate([np.arange(1, t + 1) for t in tops])
    return (q[:, dim] >= step).astype(np.float32) @ (m[:, dim] >= step).astype(np.float32).T


def one_edit(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether rows of letters are one edit apart: as long, one letter
    replaced; or the second one letter longer."""
    length = q.shape[1]
    if m.shape[1] == length:
        return (q != m).sum(1) == 1
    apart, shifted = q != m[:, :-1], q != m[:, 1:]
    first = np.where(apart.any(1), apart.argmax(1), length)
    return ~(shifted & (np.arange(length) >= first[:, None])).any(1)


def near_pairs(members: list[str], queries: list[str], longer: bool):
    """(query rows, member rows) that are near; ``longer`` says that members
    have one letter more than queries."""
    if not members or not queries:
        return
    size = len(members[0])
    m_code, q_code = letter_codes(members, size), letter_codes(queries, size - longer)
    m_count, q_count = letter_counts(m_code), letter_counts(q_code)
    tree, least = Tree(m_count, LEAF), size - 1
    for leaf, rows in tree.reach(q_count, 0 if longer else 1, 1):
        at = tree.members[leaf]
        for lo in range(0, len(rows), step := max(1, STEP // len(at))):
            some = rows[lo:lo + step]
            i, j = np.nonzero(shared_letters(q_count[some], m_count[at]) >= least)
            i, j = some[i], at[j]
            for k in range(0, len(i), width := max(1, STEP // size)):
                a, b = i[k:k + width], j[k:k + width]
                ok = one_edit(q_code[a], m_code[b])
                yield a[ok], b[ok]


def plan_trees(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, list]:
    """Nodes of a tree for each length with more than ``cell`` words, planned
    from about ``sample`` vectors in all."""
    sizes = words.groupBy(F.char_length("word").alias("size")).count().where(F.col("count") > cell).collect()
    total = sum(r["count"] for r in sizes)
    if not total:
        return {}
    part = min(1.0, sample / total)
    some = words.where(F.char_length("word").isin([r["size"] for r in sizes]))
    some = some.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < part * float(1 << 30)).select("word")

    def vectors(batches):
        import pyarrow as pa
        for batch in batches:
            found = batch.column(0).to_pylist()
            counts = [np.minimum(letter_counts(letter_codes([w], len(w)))[0], 255).astype(np.uint8).tobytes() for w in found]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in found], pa.int32()), pa.array(counts, pa.binary())], ["size", "vector"])

    by: dict[int, list[bytes]] = {}
    for r in some.mapInArrow(vectors, "size int, vector binary").collect():
        by.setdefault(r["size"], []).append(bytes(r["vector"]))
    return {size: Tree(np.frombuffer(b"".join(sorted(v)), np.uint8).reshape(-1, DIMS).astype(np.int32), max(1, int(cell * part))).nodes
            for size, v in by.items()}


def _route(nodes: dict[int, list]):
    def route(batches):
        import pyarrow as pa
        trees = {}
        for size, some in nodes.items():
            trees[size] = Tree.__new__(Tree)
            trees[size].nodes = some
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = np.array([len(w) for w in words])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                counts = letter_counts(letter_codes([words[i] for i in at], size))
                own = np.zeros(len(at), np.int64)
                found = []
                if size in trees:
                    for leaf, rows in trees[size].reach(counts, 0, 0):
                        own[rows] = leaf
                    for leaf, rows in trees[size].reach(counts, 1, 1):
                        found.append((size, leaf, 1, rows[own[rows] != leaf]))  # members are queries of their own cell anyway
                found += [(size, leaf, 0, np.flatnonzero(own == leaf)) for leaf in np.unique(own).tolist()]
                if size + 1 in trees:
                    found += [(size + 1, leaf, 2, rows) for leaf, rows in trees[size + 1].reach(counts, 0, 1)]
                else:
                    found.append((size + 1, 0, 2, np.arange(len(at))))
                lens = [len(rows) for *_, rows in found]
                pick = at[np.concatenate([rows for *_, rows in found])]
                head = [pa.array(np.repeat(np.array([f[k] for f in found], np.int32), lens)) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*head, batch.column(0).take(pa.array(pick)).cast(pa.string()), pa.array(n[pick])],
                    ["size", "cell", "role", "word", "n"])
    return route


def _search(table):
    """Near words found in one cell: a row a word."""
    import pyarrow as pa
    words, role = table.column("word").to_pylist(), table.column("role").to_numpy()
    n = table.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    members = np.flatnonzero(role == 0)
    mine = [words[i] for i in members]
    for longer, queries in ((False, np.flatnonzero(role < 2)), (True, np.flatnonzero(role == 2))):
        for a, b in near_pairs(mine, [words[i] for i in queries], longer):
            a, b = queries[a], members[b]
            for x, y in ((a, b), (b, a))[:1 + longer]:
                count += np.bincount(x, minlength=len(words))
                np.minimum.at(best, x, rank[y])
    some = np.flatnonzero(count)
    to = [order[i] for i in best[some]]
    return pa.table({"word": pa.array([words[i] for i in some], pa.string()), "n_near": pa.array(count[some]),
                     "near": pa.array([words[i] for i in to], pa.string()), "near_n": pa.array(n[to], pa.int64())})


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, n_near, near (the near word of most occurrences), near_n, for
    words (word, n) that have one; each word occurs once in ``words``."""
    nodes = plan_trees(words, cell, sample)
    rows = words.select("word", "n").mapInArrow(_route(nodes), "size int, cell int, role int, word string, n long")
    found = rows.groupBy("size", "cell").applyInArrow(_search, "word string, n_near long, near string, near_n long")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("m"))
    return found.select("word", "n_near", F.col("m.near").alias("near"), (-F.col("m.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round takes every word to its
    form's form, so a chain's length halves; it has at most 63 links, as
    occurrences double along it."""
    hop = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = hop.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = hop.join(onward, "root", "left")
        step = saved(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        hop = step.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = saved(vocabulary(docs, key, text), "spelling-words")
    near = saved(near_words(words, cell, sample), "spelling-near")
    rows = words.join(near, "word", "left")
    takes = F.col("near_n") >= RATIO * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                       F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n"))
    rows = saved(rows, "spelling-forms")
    rows = rows.join(roots(rows.where("form is not null")), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of three occurrences or more."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: A CRC-32 as a fold over bytes; near words are found by the texts that a
#: deleted letter leaves.
OP13_SQL = r"""
WITH RECURSIVE table256 AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8],
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)
  WHERE length(w) >= 5 GROUP BY ALL
), coded AS (
  SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM coded, table256
), vocab AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
    FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), less AS (
  SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN vocab b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS near_n,
    min(near) FILTER (WHERE near_n = top) AS near
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * v.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 2 * v.n THEN b.near_n END AS form_n
  FROM vocab v LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL
  SELECT w.word, f.form, w.step + 1 FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN ends e USING (word)
"""
