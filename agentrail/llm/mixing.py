"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, ...; a
target stops at three times its source's size and the excess goes to the
others by weight.  The words of the mix are equal blocks of ``BLOCK_WORDS``;
the blocks go to the sources by highest quotients ``target / (2 k + 1)``, and
those of a source to its shards by ``size / (2 k + 1)``.  A shard holds its
documents in a seeded order, and its quota is a run of blocks from a seeded
start, round and round: no document is taken more than three times.

Shards hold about ``SHARD_WORDS`` words each, so a source with a third of all
rows is many shards.  Null texts have size 0 and are taken 0 times; null
sources are one source; rows that repeat are rows of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, aside, back, saved, word_count

BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
MOST_TIMES = 3
SEED = "mix-1"


def _long(c: Column) -> Column:
    return c.cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size: one row a source) with ``target``.
    The caps fill in order of size by weight; the share that is left after a
    source's smaller ones decides whether it is capped too."""
    everything = Window.partitionBy(F.lit(0))
    w = everything.orderBy(F.col("source").isNull(), "source")
    out = sizes.withColumn("weight", _long((F.row_number().over(w) - 1) % 3 + 1))
    out = out.withColumn("cap", F.col("source_size") * MOST_TIMES)
    fill = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    out = out.withColumns({
        "total": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything),
        "caps_before": F.sum("cap").over(fill) - F.col("cap"),
        "weights_before": F.sum("weight").over(fill) - F.col("weight")})
    out = out.withColumn("capped", (F.col("total") - F.col("caps_before")) * F.col("weight")
                         >= F.col("cap") * (F.col("weights") - F.col("weights_before")))
    capped = F.col("capped")
    out = out.withColumns({
        "caps": F.coalesce(F.sum(F.when(capped, F.col("cap"))).over(everything), _long(F.lit(0))),
        "open_weights": F.coalesce(F.sum(F.when(~capped, F.col("weight"))).over(everything), _long(F.lit(0)))})
    share = ((F.col("total") - F.col("caps")) * F.col("weight")).cast("double") / F.col("open_weights").cast("double")
    return out.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(share)).select(
        "source", "source_size", "target", "total")


def apportion(parties: DataFrame, group: list[str], order: list, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: ``seats`` of each group to its parties by highest
    quotients.  Rounding every party's share gives the right division of some
    number of seats close by; the seats missing (or too many) are then dealt by
    quotient among the few seats of each party that can be concerned."""
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumns({"_v": F.sum(votes).over(g).cast("double"), "_n": F.count(F.lit(1)).over(g),
                             "_i": F.row_number().over(g.orderBy(*order))})
    share = F.when(F.col("_v") > 0, F.col(votes).cast("double") * F.col(seats).cast("double") / F.col("_v")).otherwise(F.lit(0.0))
    p = p.withColumn("_s", _long(F.floor(share + 0.5)))
    p = p.withColumn("_e", F.when(F.col("_v") > 0, F.col(seats) - F.sum("_s").over(g)).otherwise(_long(F.lit(0))))
    part = F.when(F.col("_v") > 0, F.col(votes).cast("double") / F.col("_v")).otherwise(F.lit(0.0))
    most = _long(F.ceil(part * (F.abs("_e") + F.col("_n")).cast("double"))) + 1
    most = F.when(F.col("_e") < 0, F.least(most, F.col("_s"))).otherwise(most)
    none = F.expr("cast(array() as array<bigint>)")
    nth = F.when((F.col("_e") != 0) & (most > 0), F.sequence(_long(F.lit(1)), most)).otherwise(none)
    c = p.select(*group, "_i", "_e", "_s", votes, F.explode(nth).alias("_j"))
    seat = F.when(F.col("_e") > 0, F.col("_s") + F.col("_j")).otherwise(F.col("_s") - F.col("_j") + 1)
    c = c.withColumn("_q", F.col(votes).cast("double") / (2 * seat - 1).cast("double"))
    best = F.when(F.col("_e") > 0, -F.col("_q")).otherwise(F.col("_q"))
    last = F.when(F.col("_e") > 0, F.col("_i")).otherwise(-F.col("_i"))
    c = c.withColumn("_r", F.row_number().over(g.orderBy(best, last, "_j"))).where(F.col("_r") <= F.abs("_e"))
    c = c.groupBy(*group, "_i").agg(F.sum(F.signum("_e")).cast("long").alias("_d"))
    on = F.col("p._i") == F.col("c._i")
    for k in group:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    return p.alias("p").join(c.alias("c"), on, "left").select(
        *[F.col(f"p.{k}") for k in parties.columns], (F.col("_s") + F.coalesce("_d", _long(F.lit(0)))).alias(out))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED,
        extra: list[str] = ()) -> DataFrame:
    """What the mix takes of every row: key, size, source_size, target, taken;
    ``times`` whole copies plus the words [lo, hi) and [0, wrap) once more.
    ``extra`` columns ride along."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = saved(docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                              word_count(F.col(text)).alias("size"), h.alias("h"), *extra), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sources)
    sources = sources.withColumn("seats", _long(F.round(F.col("total") / block)))
    sources = apportion(sources, [], [F.col("source").isNull(), F.col("source")], "target", "seats", "blocks")
    shards = _long(F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)))
    sources = saved(sources.select("source", "source_size", "target", "blocks", shards.alias("shards")), "mix-sources")
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("shards")
    dealt = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.*", "source_size", "target", "blocks", place.alias("shard"))
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("cell"), F.max("blocks").alias("blocks"))
    cells = apportion(cells, ["source"], ["shard"], "cell", "blocks", "quota")
    begin = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("")), "shard")), 1, 8), 16, 10)
    n_blocks = F.greatest(_long(F.ceil(F.col("cell") / block)), _long(F.lit(1)))
    want = F.least(F.col("quota") * block, F.col("cell") * MOST_TIMES)
    cells = saved(cells.select("source", "shard", "cell", want.alias("want"),
                               (begin.cast("long") % n_blocks * block).alias("begin")), "mix-cells")
    shard = Window.partitionBy("source", "shard").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("upto", F.sum("size").over(shard)).alias("d").join(
        cells.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.shard") == F.col("c.shard"))).select(
        "d.*", "cell", "want", "begin")
    zero = _long(F.lit(0))
    rows = rows.withColumns({"at": F.col("upto") - F.col("size"),
                             "times": F.when(F.col("cell") > 0, F.expr("want div cell")).otherwise(zero)})
    rows = rows.withColumn("end", F.col("begin") + F.col("want") - F.col("times") * F.col("cell"))

    def within(x: Column) -> Column:
        return F.greatest(zero, F.least(x - F.col("at"), F.col("size")))

    rows = rows.withColumns({"lo": within(F.col("begin")), "hi": within(F.least("end", "cell")),
                             "wrap": within(F.greatest(F.col("end") - F.col("cell"), zero))})
    taken = F.col("times") * F.col("size") + F.greatest(F.col("hi") - F.col("lo"), zero) + F.col("wrap")
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"),
                       "times", "lo", "hi", "wrap", *extra)


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: whole documents as
    often as the mix takes them, and the words of a partial take as a text.
    Takes are joined to the rows on key and hash of the text; rows that repeat
    both share their takes out among themselves by number."""
    txt = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))
    copies = Window.partitionBy("key", "txt")
    rows = aside(docs, key=key, source=source, text=text).withColumn("txt", txt)
    takes = mix(rows.select("key", "source", "text", "txt"), "key", "source", "text", extra=["txt"])
    takes = takes.select("key", "txt", "times", "lo", "hi", "wrap", "taken")
    # rows alike in key, source and text are interchangeable: number both sides
    takes = takes.withColumn("nth", F.row_number().over(copies.orderBy("taken", "lo", "wrap")))
    rows = rows.withColumn("nth", F.row_number().over(copies.orderBy(F.lit(0))))
    out = rows.alias("d").join(takes.alias("t"), F.col("d.key").eqNullSafe(F.col("t.key"))
                               & (F.col("d.txt") == F.col("t.txt")) & (F.col("d.nth") == F.col("t.nth")))
    pieces = F.regexp_extract_all(F.col("d.text"), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), 1)
    whole = F.col("d.text")
    none = F.expr("cast(array() as array<string>)")

    def words(lo: Column, n: Column) -> Column:
        return F.when(n > 0, F.array(F.array_join(F.slice(pieces, lo.cast("int") + 1, n.cast("int")), ""))).otherwise(none)

    texts = F.concat(F.when(F.col("times") > 0, F.array_repeat(whole, F.col("times").cast("int"))).otherwise(none),
                     words(F.col("lo"), F.col("hi") - F.col("lo")), words(F.lit(0), F.col("wrap")))
    return out.select("d.row", F.explode(texts).alias("text")).select(*back(docs, **{text: "text"}))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that
    the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _apportion_sql(name: str, parties: str, group: str, order: str, votes: str, seats: str) -> str:
    """CTEs that end in ``name``: ``parties`` with ``won`` seats."""
    by = f"PARTITION BY {group}" if group else ""
    g = f"{group}, " if group else ""
    on = f"p.{group} IS NOT DISTINCT FROM c.{group} AND " if group else ""
    return f"""{name}_a AS (SELECT *, (sum({votes}) OVER ({by}))::DOUBLE AS v_, count(*) OVER ({by}) AS n_,
  row_number() OVER ({by} ORDER BY {order}) AS i_ FROM {parties}),
{name}_b AS (SELECT *, CASE WHEN v_ > 0 THEN floor({votes}::DOUBLE * {seats}::DOUBLE / v_ + 0.5)::BIGINT ELSE 0 END AS s_ FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN v_ > 0 THEN ({seats} - sum(s_) OVER ({by}))::BIGINT ELSE 0 END AS e_ FROM {name}_b),
{name}_d AS (SELECT *, ceil(CASE WHEN v_ > 0 THEN {votes}::DOUBLE / v_ ELSE 0 END * (abs(e_) + n_))::BIGINT + 1 AS m_ FROM {name}_c),
{name}_e AS (SELECT {g}i_, e_, s_, {votes}, unnest(range(1, CASE WHEN e_ < 0 THEN least(m_, s_) ELSE m_ END + 1)) AS j_
  FROM {name}_d WHERE e_ <> 0),
{name}_f AS (SELECT *, {votes}::DOUBLE / (2 * CASE WHEN e_ > 0 THEN s_ + j_ ELSE s_ - j_ + 1 END - 1) AS q_ FROM {name}_e),
{name}_g AS (SELECT * FROM {name}_f QUALIFY row_number() OVER ({by} ORDER BY CASE WHEN e_ > 0 THEN -q_ ELSE q_ END,
  CASE WHEN e_ > 0 THEN i_ ELSE -i_ END, j_) <= abs(e_)),
{name}_h AS (SELECT {g}i_, sum(sign(e_))::BIGINT AS d_ FROM {name}_g GROUP BY {g}i_),
{name} AS (SELECT p.*, p.s_ + coalesce(c.d_, 0) AS won FROM {name}_d p LEFT JOIN {name}_h c ON {on}p.i_ = c.i_)"""


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
                  md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight,
              {MOST_TIMES} * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights,
              (sum(cap) OVER f - cap)::BIGINT AS caps_before, (sum(weight) OVER f - weight)::BIGINT AS weights_before
       FROM s1 WINDOW f AS (ORDER BY cap / weight, source IS NULL, source)),
s3 AS (SELECT *, (total - caps_before) * weight >= cap * (weights - weights_before) AS capped FROM s2),
s4 AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)::BIGINT AS caps,
              coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 0)::BIGINT AS open_weights FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
              ELSE ((total - caps) * weight)::DOUBLE / open_weights::DOUBLE END AS target,
              round(total / {BLOCK_WORDS}.0)::BIGINT AS seats FROM s4),
{_apportion_sql("sa", "s5", "", "source IS NULL, source", "target", "seats")},
s6 AS (SELECT source, source_size, target, won AS blocks,
              greatest(ceil(source_size / {SHARD_WORDS}.0)::BIGINT, 1) AS shards FROM sa),
e AS (SELECT d.*, s6.source_size, s6.target, s6.blocks, ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
c0 AS (SELECT source, shard, sum(size)::BIGINT AS cell, max(blocks) AS blocks FROM e GROUP BY source, shard),
{_apportion_sql("ca", "c0", "source", "shard", "cell", "blocks")},
c1 AS (SELECT source, shard, cell, least(won * {BLOCK_WORDS}, {MOST_TIMES} * cell) AS want,
              ('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(source, ''), shard::VARCHAR)), 1, 8))::BIGINT
              % greatest(ceil(cell / {BLOCK_WORDS}.0)::BIGINT, 1) * {BLOCK_WORDS} AS begin_ FROM ca),
p AS (SELECT e.*, cell, want, begin_, CASE WHEN cell > 0 THEN want // cell ELSE 0 END AS times,
             sum(size) OVER (PARTITION BY e.source, e.shard ORDER BY h, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS at_
      FROM e JOIN c1 ON e.source IS NOT DISTINCT FROM c1.source AND e.shard = c1.shard),
q AS (SELECT *, begin_ + want - times * cell AS end_ FROM p)
SELECT doc_id, size, source_size, target,
       (times * size + greatest(0, greatest(0, least(least(end_, cell) - at_, size)) - greatest(0, least(begin_ - at_, size)))
        + greatest(0, least(greatest(end_ - cell, 0) - at_, size)))::BIGINT AS taken
FROM q
"""
