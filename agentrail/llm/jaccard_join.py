"""N-gram Jaccard join with a token-group matrix.

A document's set is its distinct word shingles.  Two documents link when the
Jaccard similarity of their sets reaches ``PERCENT``; components of links are
returned.  Documents with equal sets are one class from the start.

1. Similar documents come together: sets linked at t differ in at most
   D = (1 - t) / (1 + t) (|A| + |B|) shingles.  With the shingle space cut into
   more than D parts, two linked sets agree on a whole part, so classes that
   share a part (for their size) are joined into clusters.  Passages that many
   documents share do not join them, as a part holds other shingles as well.
2. The class of each cluster that shares most is its pivot; every class is
   compared with its pivot only (a number of pairs linear in the classes).
3. Classes not linked to their pivot are queries.  Members and queries of a
   cluster meet in blocks with ``SIDE_TOKENS`` shingles a side; a class goes once
   to each block of its row and column.  In a block, members are taken in groups
   of ``GROUP``; a group's row of the matrix is the union of its shingles.  A
   query's overlap with the union bounds its overlap with every member, so a
   group is opened, and its members compared, only when the bound reaches the
   threshold.  A block returns spanning links, not all pairs.

Shingles are compared by 64-bit hashes of their words, sets by 128-bit sums.
Part hashes are dealt out in ``SLICES``, one shuffled at a time; tables that
nothing reads any more are deleted.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, back, discard, mix64, saved, span_hashes, text_slices, tidy, word_spans

SHINGLE = 3
PERCENT = 90
GROUP = 256
#: Shingles of a block's members, and of its queries, on average: about 8 MB each
#: in a worker.  A class of a cluster with s times as many is copied 2 s times.
SIDE_TOKENS = 1 << 20
#: Part hashes go by their upper bits to so many columns (a power of two).  Only
#: one column is shuffled at a time, which bounds the disk, and one filter holds
#: fewer of them.
SLICES = 4
#: A size class spans about so wide a ratio of sizes, in steps of the
#: threshold; only sets within one step of its upper end also count as the
#: smaller of a pair in the next.
CLASS_RATIO = 1.55
#: Shingles found ``HOT_COUNT`` times or more in one of ``HOT_SAMPLE`` texts
#: (the ``HOT_MOST`` most frequent) are left out of the parts.  Any choice is
#: exact, as sets differ no more without them; it keeps a line that many
#: documents share from bringing them together.  Sets with less than a share
#: ``COLD_LEAST`` of other shingles make parts of all their shingles instead.
HOT_SAMPLE, HOT_COUNT, HOT_MOST = 16, 6, 200_000
COLD_LEAST = 0.4
#: Bits of a filter of hashes that goes to all tasks: 2^18 numbers at most,
#: however many hashes there are.  It only spares rows a shuffle.
FILTER_BITS = 24
#: Parts beyond D: so many, and so many percent of D.  Linked sets agree on that
#: many parts at least, so only sets with as many empty ones may agree on empty
#: parts alone; see ``signatures``.  Parts hold some 4 shingles, so a set has
#: few empty ones unless most of its shingles are frequent.
SPARE_PARTS, SPARE_PERCENT = 3, 8
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; A-Z count as a-z.  Fewer
    words than a shingle has are one shingle, no words none."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    starts, ends, row = word_spans(data, offs)
    h = span_hashes(data, starts, ends)
    begin = np.searchsorted(row, np.arange(len(offs)))
    with np.errstate(over="ignore"):
        if len(h) >= words:
            total = sum((h[i:len(h) - words + 1 + i] * (_K[i % 4] + np.uint64(2 * i)) for i in range(words)),
                        np.zeros(len(h) - words + 1, np.uint64))
            total = mix64(total)
        out = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(total[a:b - words + 1]))
            elif b > a:
                few = sum((h[a + i:a + i + 1] * (_K[i % 4] + np.uint64(2 * i)) for i in range(b - a)), np.zeros(1, np.uint64))
                out.append(mix64(few + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def size_bounds(percent: int, most: int) -> list[tuple[int, int]]:
    """Size classes: (least size, least size of those that can link with the
    next class).  Sets that link lie in one class, or the larger is in the next
    one and the smaller at the upper end of its own."""
    bounds, n = [], 1
    steps = max(1, int(np.log(CLASS_RATIO) / np.log(100 / percent)))
    while n <= most:
        edges = [n]
        for _ in range(steps):
            edges.append(max(edges[-1] + 1, -(-100 * edges[-1] // percent)))
        bounds.append((n, edges[-2]))
        n = edges[-1]
    return bounds + [(n, n)]


def parts_of(bounds: list[tuple[int, int]], c: int, percent: int) -> int:
    """Parts for pairs whose larger set is of class c; 0 if only equal sets
    can link."""
    differ = (100 - percent) * 2 * (bounds[c + 1][0] - 1) // (100 + percent)
    return differ + SPARE_PARTS + differ * SPARE_PERCENT // 100 if differ else 0


def least_agreeing(bounds: list[tuple[int, int]], c: int, percent: int, n: int) -> int:
    """Parts on which a set of size ``n`` and any set that it links with, the
    larger of them of class c, agree at least."""
    other = min(100 * n // percent, bounds[c + 1][0] - 1)
    return parts_of(bounds, c, percent) - (100 - percent) * (n + other) // (100 + percent)


def signatures(u: np.ndarray, percent: int, bounds: list[tuple[int, int]], hot: np.ndarray) -> np.ndarray:
    """Hashes of a set's parts, without the hot shingles; with them (apart) if
    few others are left.  Of two linked sets both have the one or the other: if
    one has less than the least share of cold shingles, the other has less than
    ``least / t + (1 - t) / t``.

    Two linked sets that agree on empty parts only both have as many of them as
    linked sets agree on at least: such sets make parts of all their shingles as
    well, and where those leave as many empty, each empty part counts as one
    too."""
    if not len(hot) or not len(u):
        return part_hashes(u, len(u), percent, bounds, True)[0]
    cold = u[hot[np.minimum(np.searchsorted(hot, u), len(hot) - 1)] != u]
    share, t, out, bare = len(cold) / len(u), percent / 100, [], False
    if share >= COLD_LEAST:
        found, bare = part_hashes(cold, len(u), percent, bounds)
        out.append(found)
    if bare or share < COLD_LEAST / t + (1 - t) / t:
        out.append(mix64(part_hashes(u, len(u), percent, bounds, True)[0]))
    return np.concatenate(out)


def part_hashes(u: np.ndarray, n: int, percent: int, bounds: list[tuple[int, int]],
                empty: bool = False) -> tuple[np.ndarray, bool]:
    """A hash of each non-empty part of shingles of a set of size ``n``, in its
    size class and, at the upper end of that, in the next; and whether in a
    class as many parts are empty as linked sets agree on at least (with
    ``empty``, these have hashes too).  Hashes are uniform, so parts are ranges
    of them."""
    c = bisect.bisect_right(bounds, (n, 1 << 62)) - 1
    out, bare = [], False
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(u ^ _K[1]))])
        for k in (c, c + 1) if n >= bounds[c][1] else (c,):
            m = parts_of(bounds, k, percent)
            if m:
                step = np.uint64((1 << 64) // m)
                cuts = np.searchsorted(u, np.arange(1, m, dtype=np.uint64) * step)
                lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(u)]])
                full = np.flatnonzero(hi > lo)
                if m - len(full) >= least_agreeing(bounds, k, percent, n):
                    bare = True
                    full = np.arange(m) if empty else full
                out.append(mix64((sums[hi] - sums[lo])[full] + full.astype(np.uint64) * _K[2] + np.uint64(k) * _K[3]))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), bare


def _list(arrays: list[np.ndarray]):
    import pyarrow as pa
    offs = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))


def hot_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """The frequent shingles, from a sample of texts by their hash; sorted."""
    some = rows.where(F.pmod(F.col("txt"), F.lit(HOT_SAMPLE)) == 0).select("text")
    schema = T.StructType([T.StructField("tokens", T.ArrayType(T.LongType()))])
    with tidy(rows.sparkSession):
        found = some.mapInArrow(_tokens(words, schema), schema).select(F.explode("tokens").alias("t")).groupBy("t").count()
        top = found.where(F.col("count") >= HOT_COUNT).orderBy(F.col("count").desc(), "t").limit(HOT_MOST).select("t").collect()
    return np.sort(np.array([r["t"] for r in top], np.int64).view(np.uint64))


def _sketch(words: int, percent: int, schema, hot):
    def sketch(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        out_schema, bounds = to_arrow_schema(schema), size_bounds(percent, 1 << 12)
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch):
                sets = shingle_sets(data, offs, words)
                most = max(len(u) for u in sets)
                if most >= bounds[-3][0]:
                    bounds = size_bounds(percent, 4 * most)
                with np.errstate(over="ignore"):
                    d1 = np.array([mix64(u ^ _K[0]).sum(dtype=np.uint64) for u in sets], np.uint64).view(np.int64)
                    d2 = np.array([mix64(u ^ _K[3]).sum(dtype=np.uint64) for u in sets], np.uint64).view(np.int64)
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(2)]
                sigs = [signatures(u, percent, bounds, hot.value) if len(u) else u for u in sets]
                slices = [x >> np.uint64(65 - SLICES.bit_length()) for x in sigs] if SLICES > 1 else [x ^ x for x in sigs]
                cols += [pa.array(np.array([len(u) for u in sets], np.int64)), pa.array(d1), pa.array(d2),
                         *[_list([x[s == i] for x, s in zip(sigs, slices)]) for i in range(SLICES)]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
    return sketch


def _tokens(words: int, schema):
    def tokens(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        out_schema = to_arrow_schema(schema)
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch):
                cols = [batch.column(f.name).slice(lo, hi - lo) for f in out_schema if f.name != "tokens"]
                cols.append(_list(shingle_sets(data, offs, words)))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
    return tokens


def _maybe(rows: DataFrame, column: str, hashes: DataFrame, others: bool = False) -> DataFrame:
    """``rows`` less most of those whose ``column`` is not among the hashes
    (one column): a bit a hash, folded into at most 2^(FILTER_BITS - 6) numbers
    that are broadcast.  With very many hashes it lets more rows pass.  With
    ``others``, the rows that it does not let pass."""
    place = F.pmod(F.col(column), F.lit(1 << FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")
    bits = hashes.select(F.col(hashes.columns[0]).alias(column)).groupBy(
        F.shiftright(place, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    found = rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(bits), "_word", "left" if others else "inner")
    held = F.col("_bits").bitwiseAND(bit) != 0
    return found.where(~F.coalesce(held, F.lit(False)) if others else held).drop("_word", "_bits")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node in the undirected edges (a, b), root being
    the least node of its component: large and small stars in turn, until the
    edges stay as they are.  Edges are written each time."""
    star = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        ends = star.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
            star.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        if ends.where("out > 1 or (out = 1 and in = 1)").isEmpty():
            break                                          # every node has one edge, to a root
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, star = star, saved(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        discard(last)
    roots = star.select(F.col("b").alias("node")).distinct()
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))


def _same(x: str, y: str, percent: int) -> Column:
    common = F.size(F.array_intersect(f"{x}.tokens", f"{y}.tokens"))
    return 100 * common >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - common)


def _block(percent: int):
    def block(df):
        import pandas as pd
        members, queries = df[df["member"]], df[df["query"]]
        asked = [((d1, d2), np.asarray(t, np.int64)) for d1, d2, t in zip(queries["d1"], queries["d2"], queries["tokens"])]
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        links = []
        for lo in range(0, len(members), GROUP):
            group = members.iloc[lo:lo + GROUP]
            sets = [np.asarray(t, np.int64) for t in group["tokens"]]
            ids, settled = list(zip(group["d1"], group["d2"])), group["settled"].to_numpy()
            union, at = np.unique(np.concatenate(sets), return_inverse=True)  # the group's row of the matrix
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
            sizes = np.array([len(s) for s in sets])
            for own, q in asked:
                place = np.minimum(np.searchsorted(union, q), len(union) - 1)
                mark = np.zeros(len(union), bool)
                mark[place[union[place] == q]] = True
                if 100 * int(mark.sum()) < percent * len(q):
                    continue                                # bound too low: the group stays closed
                common = np.add.reduceat(mark[at], starts)
                for i in np.flatnonzero(100 * common >= percent * (sizes + len(q) - common)):
                    if ids[i] == own:
                        continue
                    a, b = find(own), find("pivot" if settled[i] else ids[i])
                    if a != b:                              # one link joins two parts of the block
                        root[a] = b
                        links.append((*own, *ids[i]))
        return pd.DataFrame(links, columns=["a1", "a2", "b1", "b2"])
    return block


def _key(a: str, b: str) -> Column:
    return F.concat(F.hex(a), F.lit("-"), F.hex(b))


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """One row a document: key, txt (hash of the text), n_shingles, rep (key
    and txt of the least document of its component, itself without shingles).

    Null and blank texts have no shingles and link with nothing.  Keys may
    repeat or be null: the least is then over the keys there are."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("txt"), F.col(text).alias("text"))
    long, many = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["key"], *[T.StructField(c, long) for c in ("txt", "n", "d1", "d2")],
                           *[T.StructField(f"sigs{i}", many) for i in range(SLICES)]])
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(rows, words))
    drawn = saved(rows.mapInArrow(_sketch(words, percent, schema, hot), schema), "jaccard-signatures")

    # 1. clusters of classes that agree on a part
    met = []
    for i in range(SLICES):
        parts = drawn.select("d1", F.explode(f"sigs{i}").alias("sig"))
        shared = saved(parts.groupBy("sig").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.count(F.lit(1)).alias("c")).where(
            "lo < hi").select("sig", "lo", "c"), "jaccard-shared")
        met.append(saved(_maybe(parts, "sig", shared.select("sig")).join(shared, "sig").groupBy("d1", "lo").agg(
            F.sum("c").alias("c")), "jaccard-meets"))
        discard(shared)
    meets = functools.reduce(DataFrame.unionByName, met)
    sets = saved(drawn.select("key", "txt", "n", "d1", "d2"), "jaccard-sets")
    discard(drawn)
    clusters = components(meets.select(F.col("d1").alias("a"), F.col("lo").alias("b")), "jaccard-clusters")
    clusters = meets.groupBy("d1").agg(F.sum("c").alias("weight")).join(
        clusters.select(F.col("node").alias("d1"), F.col("root").alias("cluster")), "d1")

    # 2. one text of each class in a cluster; its shingles, and the pivots
    rep = F.min(F.struct("key", "txt")).alias("r")
    classes = sets.select("key", "txt", "n", "d1", "d2").join(clusters, "d1").groupBy("cluster", "d1", "d2", "n").agg(
        rep, F.max("weight").alias("weight"))
    classes = saved(classes.withColumn("k", F.xxhash64("r.key", "r.txt")), "jaccard-classes")
    discard(*met)
    top = classes.groupBy("cluster").agg(F.max(F.struct("weight", "d1", "d2")).alias("t"))
    named = classes.join(top, "cluster").withColumn("pivot", (F.col("t.d1") == F.col("d1")) & (F.col("t.d2") == F.col("d2")))
    chosen = _maybe(rows.withColumn("k", F.xxhash64("key", "txt")), "k", classes.select("k"))
    chosen = chosen.join(named, "k").where(F.col("key").eqNullSafe(F.col("r.key")) & (F.col("txt") == F.col("r.txt")))
    chosen = chosen.select("k", "cluster", "d1", "d2", "n", "pivot", "text").dropDuplicates(["k", "d1", "d2"])  # rows that repeat
    schema = T.StructType([T.StructField(c, long) for c in ("cluster", "d1", "d2", "n")]
                          + [T.StructField("pivot", T.BooleanType()), T.StructField("tokens", many)])
    chosen = chosen.select("cluster", "d1", "d2", "n", "pivot", "text")
    members = saved(chosen.mapInArrow(_tokens(words, schema), schema), "jaccard-tokens")
    tested = members.alias("m").join(members.where("pivot").alias("p"), "cluster").select(
        "cluster", "m.d1", "m.d2", "m.n", F.col("p.d1").alias("p1"), F.col("p.d2").alias("p2"), _same("m", "p", percent).alias("settled"))
    tested = saved(tested, "jaccard-tested")
    edges = tested.where("settled").select(_key("d1", "d2").alias("a"), _key("p1", "p2").alias("b"))

    # 3. the others against all of their cluster: members by row g, queries by
    # column j; in the block where a class is both it is there once
    size = tested.groupBy("cluster").agg(F.sum("n").alias("size"), F.sum(F.when(~F.col("settled"), F.col("n")).otherwise(0)).alias("open"))
    size = size.where("open > 0").select("cluster", F.ceil(F.col("size") / SIDE_TOKENS).alias("rows"), F.ceil(F.col("open") / SIDE_TOKENS).alias("columns"))
    todo = members.select("cluster", "d1", "d2", "n", "tokens").join(tested.join(size, "cluster"), ["cluster", "d1", "d2", "n"])
    row, column = F.pmod("d1", "rows"), F.pmod("d2", "columns")
    last = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    to = lambda member, query, g, j: F.struct(member.alias("member"), query.alias("query"), g.alias("g"), j.alias("j"))
    member = F.transform(last("columns"), lambda j: to(F.lit(True), ~F.col("settled") & (j == column), row, j))
    query = F.transform(F.filter(last("rows"), lambda g: g != row), lambda g: to(F.lit(False), F.lit(True), g, column))
    to = F.when(F.col("settled"), member).otherwise(F.concat(member, query))
    links = todo.select("cluster", "d1", "d2", "tokens", "settled", F.explode(to).alias("to")).select(
        "cluster", "d1", "d2", "tokens", "settled", "to.*").groupBy("cluster", "g", "j").applyInPandas(
        _block(percent), "a1 long, a2 long, b1 long, b2 long")
    edges = edges.unionByName(links.select(_key("a1", "a2").alias("a"), _key("b1", "b2").alias("b")))
    joined = components(edges, "jaccard-links")
    discard(members, tested, classes)

    # documents take the least document of their component
    node = _key("d1", "d2")
    own = sets.where("n > 0").groupBy(node.alias("node"), "n").agg(rep).join(joined, "node", "left")
    best = own.where("root is not null").groupBy("root").agg(F.min("r").alias("best"))
    own = own.join(best, "root", "left").select("node", "n", F.coalesce("best", "r").alias("rep"))
    out = sets.select("key", "txt", F.col("n"), node.alias("node")).alias("s").join(
        own.alias("o"), (F.col("s.node") == F.col("o.node")) & (F.col("s.n") == F.col("o.n")), "left")
    return out.select(F.col("s.key").alias(key), F.col("s.txt").alias("txt"), F.col("s.n").alias("n_shingles"),
                      F.coalesce("rep", F.struct("s.key", "s.txt")).alias("rep"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with the least document of each component only; rows that
    repeat key and text count as one, documents without shingles all stay."""
    found = similar_components(docs, key, text, **kw).where("n_shingles > 0")
    # only documents that go or repeat, and those that share a bit with one, are
    # shuffled; the others stay where they are
    least = F.col("rep.key").eqNullSafe(F.col(key)) & (F.col("rep.txt") == F.col("txt"))
    odd = found.groupBy(F.col(key).alias("key"), "txt").agg(F.first(least).alias("least"), F.count(F.lit(1)).alias("c"))
    odd = saved(odd.where("c > 1 or not least").withColumn("k", F.xxhash64("key", "txt")), "jaccard-odd")
    rows = aside(docs, key=key).withColumn("txt", F.xxhash64(F.coalesce(F.col("row").getField(text), F.lit(""))))
    rows = rows.withColumn("k", F.xxhash64("key", "txt"))
    some = _maybe(rows, "k", odd.select("k")).alias("d").join(
        odd.alias("s"), F.col("d.key").eqNullSafe(F.col("s.key")) & (F.col("d.txt") == F.col("s.txt")), "left").select(
        "d.key", "d.txt", "d.row", "s.least")
    stay = [_maybe(rows, "k", odd.select("k"), others=True).select("row"), some.where("least is null").select("row"),
            some.where("least").dropDuplicates(["key", "txt"]).select("row")]
    return functools.reduce(DataFrame.unionByName, stay).select(*back(docs))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the least document that links
    of 90 % or more lead to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_components(docs).select("doc_id", "n_shingles", F.col("rep.key").alias("component_id"))
