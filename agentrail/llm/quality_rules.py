"""Quality rules: a threshold table compiled into Spark column expressions.

Every measure is a built-in function over the whole text; a document is kept
when each measure of ``RULES`` lies in its range.  A null text counts as an
empty one (no words, so it fails); rows are never dropped, repeated rows are
judged alike, and columns whose names clash with the measures are replaced
by them in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, back, word_array

# Frequent function words of the four languages of the corpus.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of",
    "on", "or", "that", "the", "this", "to", "was", "were", "with",
    "au", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les",
    "ou", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "aus", "das", "dem", "den", "der", "die", "ein", "eine", "im", "ist", "mit", "nicht",
    "sich", "und", "von", "zu",
    "como", "con", "del", "el", "los", "las", "más", "no", "para", "por", "se", "su", "una", "y",
]

#: (measure, least, most); None: open.
BASE_RULES = [
    ("n_words", 50, None),
    ("repeat_share", None, 0.5),
]
RULES = [
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.10),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.50),
]

WINDOW = 3


def _lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"),
                    lambda ln: ln.rlike(r"[^\x20\x09-\x0D]"))


def _windows(words: Column, n: Column) -> Column:
    full = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(full, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))


def _with_covered(df: DataFrame) -> DataFrame:
    """Adds ``_n_repeat_words``: words inside windows that occur more than
    once.  Equal windows are neighbours after a sort, and the starts of those
    found cover three words each, less what the next start already covers.
    Each step is a column of its own, so that it is computed once a row."""
    some = F.size(F.array_distinct("_wins")) < F.size("_wins")
    pair = F.transform("_wins", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    df = df.withColumn("_some", some)
    df = df.withColumn("_order", F.when(F.col("_some"), F.array_sort(pair)))
    order = F.col("_order")
    df = df.withColumn("_same", F.zip_with(order, F.slice(order, 2, F.greatest(F.size(order), F.lit(1))),
                                           lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))))
    same = F.col("_same")
    df = df.withColumn("_starts", F.array_sort(F.transform(
        F.filter(order, lambda x, k: F.get(same, k) | F.coalesce(F.get(same, k - 1), F.lit(False))),
        lambda x: x["i"])))
    starts = F.col("_starts")
    steps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))),
                       lambda p, q: F.least(F.coalesce(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return df.withColumn("_n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts and ratios that the rules read."""
    out = aside(docs, text=text)
    out = out.withColumn("_words", word_array(F.col("text")))
    out = out.withColumn("_wins", _windows(F.col("_words"), F.size("_words")))
    out = _with_covered(out).withColumn("_lines", _lines(F.col("text")))
    out = out.select(
        "row", F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        # the second term is 0; as it is not deterministic to the optimizer, a
        # filter on the verdict stays above this projection, where it would
        # otherwise be rewritten into the nested expressions below
        (F.col("_n_repeat_words") + F.floor(F.rand(0))).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop"),
    )
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    out = out.withColumns({
        "mean_word_chars": F.col("word_chars") / w,
        "symbol_ratio": F.col("n_symbols") / w,
        "stop_ratio": F.col("n_stop") / w,
        "repeat_share": F.col("n_repeat_words") / w,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    })
    found = [c for c in out.columns if c != "row"]
    return out.select(*back(docs, (*found, "base_failed", "kept")), *found)


def compile_rules(rules: list[tuple]) -> Column:
    """One boolean expression: every measure lies in its range."""
    ok = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            ok = ok & (F.col(name) >= F.lit(least))
        if most is not None:
            ok = ok & (F.col(name) <= F.lit(most))
    return ok


def judge(docs: DataFrame, text: str = "text", rules: list[tuple] | None = None) -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``."""
    m = measures(docs, text)
    return m.withColumn("base_failed", ~compile_rules(BASE_RULES)).withColumn(
        "kept", ~F.col("base_failed") & compile_rules(RULES if rules is None else rules))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                              "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d),
win AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws || [''], 'string_agg', ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({_STOP_SQL}))) AS n_stop
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS k FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / k >= 2.0 AND word_chars / k <= 20.0 AND n_symbols / k <= 0.10
       AND n_stop / k >= 0.02 AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.50 AS kept
FROM b
"""
